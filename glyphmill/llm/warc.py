"""Operator 6, WARC archives and the external merge of their index.

Writing: each task writes its captures as gzip members of one archive and, beside it, a run: its index
entries (URL key, timestamp, offset, length, archive) sorted by key and timestamp, with a sparse key table.
Merging: the key space is cut at sampled keys, and each task merges its slice of every run with a
loser tree, one comparison a level for each entry, holding one block of each run.  Where there are
more runs than ``fan_in``, groups of runs are merged into longer runs first.  Slice after slice the
result is the globally ordered history of captures, from which archives are read back.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, store, table

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
BLOCK = 512  # index entries in a block
ENTRY = re.compile(rb"\n")
SHAPE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, place long, slice long, payload_intact boolean"


def url_key(url: str) -> str:
    """Host labels reversed, without scheme, user, ``www`` and default port; path and query after ``)``."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip(), flags=re.I).split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower()
    host = re.sub(r":(80|443)$", "", re.sub(r"^www\d*\.", "", host))
    return ",".join(reversed(host.split("."))) + ")/" + (path if slash else "")


def stamp(page_id: int | None) -> str:
    """Pages carry no time of capture; their number gives one, a second apart."""
    return (EPOCH + timedelta(seconds=int(page_id or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with an HTTP response; a revisit has the headers without the payload."""
    rid = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(n))}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": rid(page_id),
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Date": stamp(page_id),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Capture": json.dumps(page_id),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": rid(refers_to), "X-Refers-To-Capture": json.dumps(refers_to), "X-Payload-Length": str(len(payload))}
    head["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


class Run:
    """A sorted run of index entries on disk: lines of JSON in gzip blocks, a table of first keys at the end."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        at = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.blocks = json.loads(zlib.decompress(self.file.read_at(size - 8 - at, at)))  # [first key, offset, length]

    @staticmethod
    def write(fs, path: str, entries) -> None:
        """``entries`` in order; one block at a time is held."""
        with fs.open_output_stream(path) as out:
            blocks, held, at = [], [], 0

            def flush():
                nonlocal at, held
                if held:
                    raw = zlib.compress("\n".join(map(json.dumps, held)).encode(), 1)
                    blocks.append([held[0][:2], at, len(raw)])
                    out.write(raw)
                    at += len(raw)
                    held = []

            for e in entries:
                held.append(e)
                if len(held) == BLOCK:
                    flush()
            flush()
            out.write(zlib.compress(json.dumps(blocks).encode(), 1) + at.to_bytes(8, "little"))

    def between(self, low, high):
        """Entries with low <= (key, stamp) < high; None is open."""
        firsts = [b[0] for b in self.blocks]
        k = max(0, bisect.bisect_left(firsts, low) - 1) if low else 0
        for first, at, length in self.blocks[k:]:
            if high and first >= high:
                return
            for line in ENTRY.split(zlib.decompress(self.file.read_at(length, at))):
                e = json.loads(line)
                if (not low or e[:2] >= low) and (not high or e[:2] < high):
                    yield e


def merged(sources: list):
    """k-way merge by a loser tree: inner nodes hold the loser of their match, the root the winner."""
    k = len(sources)
    if not k:
        return
    its = [iter(s) for s in sources]
    heads = [next(i, None) for i in its]
    tree = [-1] * k

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a], a) < (heads[b], b)

    def play(i: int) -> None:
        """Source i climbs from its leaf; an empty node waits for the other half of its tree."""
        node = (i + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = i
                return
            if beats(tree[node], i):
                tree[node], i = i, tree[node]
            node //= 2
        tree[0] = i

    for i in range(k):
        play(i)
    while heads[tree[0]] is not None:
        i = tree[0]
        yield heads[i]
        heads[i] = next(its[i], None)
        node = (i + k) // 2
        while node:
            if beats(tree[node], i):
                tree[node], i = i, tree[node]
            node //= 2
        tree[0] = i


def write_archives(pages: DataFrame, folder: str, least_payload: int = 0) -> DataFrame:
    """Writes archives and runs; one row for each task: run (path), and a sample of keys."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    own = own.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("row", F.xxhash64("url", "html"))
    # of equal payloads the largest page_id is the response; a row is told from its repeats by its number
    first = own.where(F.octet_length("html") >= least_payload).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1")
    rows = own.drop("row").join(first, "sha1", "left").select("page_id", "url", "html", "holder", F.col("copies").isNotNull().alias("shared"))

    def write(batches):
        fs, at = store(folder)
        fs.create_dir(at, recursive=True)
        name = f"{at}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        entries, offset, out = [], 0, None
        for batch in batches:
            for page_id, url, html, holder, shared in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{name}.warc.gz", compression=None)
                payload = html.encode("utf-8", "replace")
                kind = "revisit" if shared and holder is not None and page_id != holder else "response"
                raw = gzip.compress(record(page_id, url, payload, sha1_base32(payload), kind, holder if kind == "revisit" else None), 1, mtime=0)
                out.write(raw)
                entries.append([url_key(url), stamp(page_id), offset, len(raw), f"{name}.warc.gz"])
                offset += len(raw)
        if out is not None:
            out.close()
            entries.sort()
            Run.write(fs, f"{name}.run", entries)
            step = max(1, len(entries) // 32)
            yield pa.RecordBatch.from_pydict({"run": [f"{name}.run"], "sample": [json.dumps([e[:2] for e in entries[step // 2 :: step]])], "entries": [len(entries)]})

    return rows.mapInArrow(write, "run string, sample string, entries long")


def merge_runs(spark: SparkSession, folder: str, runs: list[str], fan_in: int) -> list[str]:
    """While there are more runs than ``fan_in``: groups of them become one each, in parallel."""
    while len(runs) > fan_in:
        groups = [(runs[i : i + fan_in],) for i in range(0, len(runs), fan_in)]

        def longer(batches):
            fs, at = store(folder)
            for batch in batches:
                for group in batch.column(0).to_pylist():
                    path = f"{at}/merged-{uuid.uuid4().hex}.run"
                    Run.write(fs, path, merged([Run(fs, p).between(None, None) for p in group]))
                    yield pa.RecordBatch.from_pydict({"run": [path]})

        todo = spark.createDataFrame(groups, "runs array<string>").repartition(min(len(groups), 4 * partitions(spark)))
        runs = [r["run"] for r in todo.mapInArrow(longer, "run string").collect()]
    return runs


def read_history(spark: SparkSession, folder: str, runs: list[str], cuts: list) -> DataFrame:
    """Each slice of the key space: merges the runs and reads each capture from its archive."""
    edges = [None, *cuts, None]
    slices = [(i, json.dumps([edges[i], edges[i + 1]])) for i in range(len(edges) - 1)]

    def read(batches):
        fs, _ = store(folder)
        for batch in batches:
            for k, span in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = json.loads(span)
                files, rows = {}, []
                for place, (key, when, offset, length, path) in enumerate(merged([Run(fs, p).between(low, high) for p in runs])):
                    if path not in files:
                        files[path] = fs.open_input_file(path)
                    head, block = parsed(gzip.GzipFile(fileobj=io.BytesIO(files[path].read_at(length, offset))).read())
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = len(payload) if kind == "response" else int(head["X-Payload-Length"])
                    refers = json.loads(head["X-Refers-To-Capture"]) if kind == "revisit" else None
                    intact = sha1_base32(payload) == digest if kind == "response" else not payload
                    rows.append((json.loads(head["X-Capture"]), size, digest, kind, refers, key, when, place, k, intact))
                    if len(rows) == 4096:
                        yield arrow(rows)
                        rows = []
                if rows:
                    yield arrow(rows)

    def arrow(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in SHAPE.split(", ")])

    return spark.createDataFrame(slices, "slice int, span string").repartition(len(slices)).mapInArrow(read, SHAPE)


def warc_history(pages: DataFrame, folder: str | None = None, least_payload: int = 0, fan_in: int = 64) -> DataFrame:
    """Writes a record per page, merges the index and reads the archives back in its order.

    One row per page: page_id, payload_bytes, payload_digest (base32 SHA-1 of the whole payload), record_type,
    refers_to, and url_key, captured, (slice, place) that number the history.  Null html is an empty payload, null
    url an empty one.  Of equal payloads the row with the largest page_id is the response, and rows repeated with
    that page_id are responses too; a group without any page_id has only responses.  Ties in key and time keep
    the order of archive and offset.  What is gathered is a path and 32 keys for each task.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    made = write_archives(pages, folder, least_payload).collect()
    if not made:
        return spark.createDataFrame([], SHAPE)
    sample = sorted(k for r in made for k in json.loads(r["sample"]))
    n = partitions(spark)
    cuts = sorted({tuple(sample[i * len(sample) // n]) for i in range(1, n)}) if len(sample) >= n else []
    runs = merge_runs(spark, folder, sorted(r["run"] for r in made), fan_in)
    return read_history(spark, folder, runs, [list(c) for c in cuts])


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_history(table(spark, sf_dir, "pages"))
