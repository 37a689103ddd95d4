"""Checking a stream of document events: the latest text of each document, kept as state and checked per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LARGEST = 4 << 20


def latest(events: DataFrame) -> DataFrame:
    """(uri, version, text) of the last event of each document; a closed document has a null text."""
    last = events.groupBy("uri").agg(F.max_by(F.struct("version", "event", "text"), "version").alias("e"))
    return last.select("uri", "e.version", F.when(F.col("e.event") != "close", F.col("e.text")).alias("text"))


def spliced(text: str, start: tuple[int, int], end: tuple[int, int], new: str) -> str:
    """One edit by (line, UTF-16 column) positions; positions outside the text raise ValueError."""

    def at(pos: tuple[int, int]) -> int:
        lines = text.split("\n")
        if not 0 <= pos[0] < len(lines):
            raise ValueError("line out of range")
        units = lines[pos[0]].encode("utf-16-le")
        if not 0 <= 2 * pos[1] <= len(units):
            raise ValueError("column out of range")
        return sum(len(x) + 1 for x in lines[: pos[0]]) + len(units[: 2 * pos[1]].decode("utf-16-le"))

    a, b = at(start), at(end)
    if a > b:
        raise ValueError("range ends before it starts")
    return text[:a] + new + text[b:]


EDITS = "array<struct<start_line:int,start_col:int,end_line:int,end_col:int,text:string>>"
EVENTS = f"uri string, version long, event string, text string, edits {EDITS}"


RULES = ""  # the uri of events that say that rules have changed


def millis(span: str) -> int:
    import pandas as pd

    return int(pd.Timedelta(span).total_seconds() * 1000)


def edited(events: DataFrame, largest: int = LARGEST, keep_closed: str | None = None, quiet: str | None = None, longest: str = "5 seconds") -> DataFrame:
    """(uri, version, text, problem) after every micro-batch for each document with events; a stateful stream.

    Events (``EVENTS``) of a document are applied in order of version: open, change and save set a whole text where they have one,
    and change applies its edits one after another, by ranges of lines and UTF-16 columns.  An edit outside of the text, or of a
    document that is not open, leaves the text as it was and is told in ``problem``, as is once a text of more than ``largest`` bytes.
    close forgets the document, whose text is then null; its version is kept for ``keep_closed`` (such as "1 hour") and then leaves
    the state, which takes batches without events, or for ever without that.  Events whose version is not larger than the last one
    seen are late and change nothing.

    With ``quiet`` (such as "150 milliseconds", five seconds at most) a document whose events are changes only gets its row from a timer of its own, when no event has come for
    that long, or ``longest`` after the first change that waits: a burst of edits gives one row, and one that does not end a row each
    ``longest``.  Any other event gives the row at once, with what waited.  Timers go by the time of the micro-batch, so they are no finer
    than the trigger, and a batch that is run again decides alike."""
    import pandas as pd

    wait = millis(keep_closed) if keep_closed else None
    still, most = (min(millis(quiet), 5000), millis(longest)) if quiet else (None, None)

    def step(key: tuple, parts: Iterator, state) -> Iterator:
        version, text, warned, since, problem = state.get if state.exists else (-1, None, False, None, None)
        timed = bool(wait or still)
        now = state.getCurrentProcessingTimeMs() if timed else 0
        at_once = still is None or state.hasTimedOut
        if state.hasTimedOut and since is None:  # it was closed long ago
            state.remove()
            return
        rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.version) if not state.hasTimedOut else []
        for r in rows:
            if r.version <= version:
                continue
            version = r.version
            at_once |= r.event != "change"
            since = now if since is None else since
            if r.event == "close":
                text, warned = None, False
                continue
            if isinstance(r.text, str):
                text = r.text
            edits = [] if r.edits is None else list(r.edits)
            if edits and text is None:
                problem = "not open"
                continue
            for e in edits:
                try:
                    text = spliced(text, (e["start_line"], e["start_col"]), (e["end_line"], e["end_col"]), e["text"] or "")
                except ValueError as error:
                    problem = str(error)
        waits = still is not None and since is not None
        left = min(still, since + most - now) if waits else 0  # late events alone start the pause anew, too
        if waits and not at_once and left > 0:
            state.update((int(version), text, bool(warned), int(since), problem))
            state.setTimeoutDuration(left)
            return
        large = text is not None and len(text.encode("utf-8")) > largest
        if large and not warned:
            problem = "too large to check"
        state.update((int(version), text, bool(large or warned), None, None))
        if text is None and wait:
            state.setTimeoutDuration(wait)
        if still is None or waits:
            yield pd.DataFrame({"uri": [key[0]], "version": [int(version)], "text": [text], "problem": [problem]})

    kept = "version long, text string, warned boolean, since long, problem string"
    return events.groupBy("uri").applyInPandasWithState(step, "uri string, version long, text string, problem string", kept, "update", "ProcessingTimeTimeout" if wait or still else "NoTimeout")


def open_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, version, text): the documents that are open by the batches that ``watch_edits`` has written to ``folder``."""
    rows = spark.read.schema("doc_id string, version long, text string").option("recursiveFileLookup", True).parquet(folder)
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("version", "text"), "version").alias("e"))
    return last.select("doc_id", "e.version", "e.text").where("text is not null")


def watch_edits(events: DataFrame, load: Callable[[], Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, DataFrame, int], None], interval: str = "150 milliseconds", most_findings: int = 1000, largest: int = LARGEST, folder: str | None = None, keep_closed: str | None = None, quiet: str | None = None, longest: str = "5 seconds") -> StreamingQuery:
    """``watch`` for events with edits.  ``load`` gives the check and is asked again for every micro-batch, so changed rule
    tables and word lists hold from the next one on.

    With a ``folder`` (in a store that all executors reach) an event with the uri ``RULES`` has all open documents checked again,
    those without events of their own, too.  Every batch writes the texts it changed there, under its number, so that a batch that
    is run again replaces its own; a batch with such an event brings the folder down to what is open.

    ``quiet`` and ``longest`` are the pauses of ``edited``; without the first each batch checks all documents with events."""
    spark = events.sparkSession

    def wanted(batch: DataFrame, number: int) -> DataFrame:
        docs = batch.where(F.col("uri") != RULES)
        if folder is None:
            return docs
        docs = docs.persist()
        changed = batch.where(F.col("uri") == RULES)
        if docs.isEmpty() and changed.isEmpty():
            return docs
        rows = docs.select(F.col("uri").alias("doc_id"), "version", "text")
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{number:012d}")
        if changed.isEmpty():
            return docs
        every = open_documents(spark, folder)
        every.write.mode("overwrite").parquet(f"{folder}/open-{number:012d}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in store.listStatus(path):
            # the versions of closed documents are needed no longer than the state keeps them, so older batches can go
            if s.getPath().getName()[-12:] < f"{number:012d}":
                store.delete(s.getPath(), True)
        silent = spark.read.schema("doc_id string, version long, text string").parquet(f"{folder}/open-{number:012d}").withColumnRenamed("doc_id", "uri")
        return docs.unionByName(silent.join(docs.select("uri"), "uri", "left_anti").withColumn("problem", F.lit(None).cast("string")))

    return _each(edited(events, largest, keep_closed, quiet, longest), load, sink, interval, most_findings, largest, wanted)


def watch(events: DataFrame, check: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None], interval: str = "150 milliseconds", most_findings: int = 1000) -> StreamingQuery:
    """Checks every micro-batch's latest texts; the last write in a batch wins, as with a debounce.

    ``check`` gets (doc_id, text) and returns findings with doc_id and offset; at most ``most_findings`` of
    a document are reported.  ``sink`` gets the documents of the batch (those over 4 MiB and closed ones
    have no findings), the findings, and the batch's number."""
    return _each(events, lambda: check, sink, interval, most_findings, LARGEST, lambda batch, number: latest(batch))



def _each(rows: DataFrame, load: Callable, sink: Callable, interval: str, most_findings: int, largest: int, texts: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    from pyspark.sql import Window

    def run(batch: DataFrame, number: int) -> None:
        docs = texts(batch, number).withColumnRenamed("uri", "doc_id").persist()
        found = load()(docs.where(F.octet_length("text") <= largest).select("doc_id", "text"))
        w = Window.partitionBy("doc_id").orderBy("offset")
        sink(docs, found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_findings).drop("k"), number)
        docs.unpersist()

    return rows.writeStream.outputMode("update").foreachBatch(run).trigger(processingTime=interval).start()
