"""Japanese notation: widths, compatibility characters, variants, and consistency within a document.

Every function takes documents (doc_id, text) or their lines (doc_id, line, line_offset, b, and skip for lines that a
directive takes out); what is found never spans lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_of_fullwidth, byte_view, compatibility_form, from_bytes, full_of_halfwidth, mapping
from .lines import bound, lines, running

# Character classes, units of numbers, and kanji digits from zero to nine.
KATAKANA = "ァ-ヺーヽヾ"
FULL_ALNUM = "０-９Ａ-Ｚａ-ｚ"
HALF_KANA = "｡-ﾟ"
COMPATIBLE = "℀-⅏㌀-㏿"
MARKS = "、。，．"
UNITS = "円人件年月日時分秒"
KANJI_DIGITS = "〇零一二三四五六七八九"

# Kanji spellings, the first form of a pair is replaced by the second where both occur equally often.
KANJI_PAIRS = [
    ("お問合せ", "お問い合わせ"),
    ("取扱い", "取り扱い"),
    ("子供", "子ども"),
    ("引続き", "引き続き"),
    ("行なう", "行う"),
    ("表わす", "表す"),
    ("読替える", "読み替える"),
    ("問い合せ", "問い合わせ"),
]

# Katakana words without and with a long vowel at their end.
KATAKANA_PAIRS = [
    ("サーバ", "サーバー"),
    ("ユーザ", "ユーザー"),
    ("コンピュータ", "コンピューター"),
    ("プリンタ", "プリンター"),
    ("ブラウザ", "ブラウザー"),
    ("フォルダ", "フォルダー"),
    ("ドライバ", "ドライバー"),
    ("ルータ", "ルーター"),
    ("プロセッサ", "プロセッサー"),
    ("マネージャ", "マネージャー"),
    ("コントローラ", "コントローラー"),
    ("スケジューラ", "スケジューラー"),
    ("パラメータ", "パラメーター"),
    ("エディタ", "エディター"),
    ("モニタ", "モニター"),
    ("レイヤ", "レイヤー"),
    ("タイマ", "タイマー"),
    ("ヘッダ", "ヘッダー"),
    ("フッタ", "フッター"),
    ("センサ", "センサー"),
    ("モータ", "モーター"),
    ("フィルタ", "フィルター"),
    ("マスタ", "マスター"),
    ("クラスタ", "クラスター"),
    ("メンバ", "メンバー"),
    ("カレンダ", "カレンダー"),
    ("アダプタ", "アダプター"),
    ("コネクタ", "コネクター"),
    ("セレクタ", "セレクター"),
    ("デバッガ", "デバッガー"),
    ("ビルダ", "ビルダー"),
    ("リーダ", "リーダー"),
    ("ライタ", "ライター"),
    ("プログラマ", "プログラマー"),
    ("デザイナ", "デザイナー"),
    ("ハンドラ", "ハンドラー"),
    ("リスナ", "リスナー"),
    ("ワーカ", "ワーカー"),
    ("プロバイダ", "プロバイダー"),
    ("トリガ", "トリガー"),
    ("スピーカ", "スピーカー"),
    ("エレベータ", "エレベーター"),
    ("エスカレータ", "エスカレーター"),
    ("カウンタ", "カウンター"),
    ("イテレータ", "イテレーター"),
    ("ジェネレータ", "ジェネレーター"),
    ("デコレータ", "デコレーター"),
    ("バリデータ", "バリデーター"),
    ("シミュレータ", "シミュレーター"),
    ("エミュレータ", "エミュレーター"),
    ("コンバータ", "コンバーター"),
    ("ポインタ", "ポインター"),
    ("インジケータ", "インジケーター"),
    ("セパレータ", "セパレーター"),
    ("アクセラレータ", "アクセラレーター"),
    ("ナビゲータ", "ナビゲーター"),
    ("コンデンサ", "コンデンサー"),
]


def katakana_pairs(style: str | None) -> list[tuple[str, str]]:
    """(variant, preferred) of style 'long' or 'short'; any other style has none."""
    return {"long": KATAKANA_PAIRS, "short": [(b, a) for a, b in KATAKANA_PAIRS]}.get(style, [])


def katakana_table(spark: SparkSession, style: str) -> DataFrame:
    return spark.createDataFrame(katakana_pairs(style), "variant string, preferred string")


def lines_of(rows: DataFrame) -> DataFrame:
    rows = rows if "b" in rows.columns else lines(rows, keep=tuple(c for c in ("prose",) if c in rows.columns))
    return rows if "skip" in rows.columns else rows.withColumn("skip", F.lit(False))


def occurrences(rows: DataFrame, run: str, other: str, hit: str | None = None) -> DataFrame:
    """(lines' columns, word, offset, col): every match of ``run`` with its byte position.

    ``other`` matches what lies between; ``hit`` tells matches of ``run`` from it where ``run`` alone does not."""
    rows = lines_of(rows)
    keep = [c for c in rows.columns if c != "b"]
    text = from_bytes(F.col("b"))
    parts = rows.select(*keep, text.alias("t")).where(F.col("t").rlike(run)).select(*keep, F.regexp_extract_all("t", F.lit(f"{run}|{other}"), F.lit(0)).alias("parts"))
    zipped = F.arrays_zip(F.col("parts").alias("w"), running(F.col("parts"), F.octet_length).alias("o"))
    found = parts.select(*keep, F.explode(zipped).alias("z")).where(F.col("z.w").rlike(hit or f"^(?:{run})$"))
    col = F.col("z.o")
    return found.select(*keep, F.col("z.w").alias("word"), col.alias("col"), (F.col("line_offset") + col).alias("offset"))


def finding(rows: DataFrame, kind: str | Column, suggestion: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select("doc_id", "line", "col", "offset", F.octet_length("word").cast("long").alias("len"), "word", kind.alias("kind"), F.array(suggestion).alias("suggestions"))


def fullwidth_alnum(rows: DataFrame) -> DataFrame:
    return finding(occurrences(rows, f"[{FULL_ALNUM}]+", f"[^{FULL_ALNUM}]+"), "fullwidth-alnum", ascii_of_fullwidth(F.col("word")))


def halfwidth_kana(rows: DataFrame) -> DataFrame:
    return finding(occurrences(rows, f"[{HALF_KANA}]+", f"[^{HALF_KANA}]+"), "halfwidth-kana", full_of_halfwidth(F.col("word")))


def space_allowed(policy: str) -> Column:
    """``policy``: always, never, or code (only where ``prose`` is false)."""
    return ~F.col("prose") if policy == "code" else F.lit(policy == "always")


def fullwidth_space(rows: DataFrame, policy: str = "code") -> DataFrame:
    return finding(occurrences(lines_of(rows).where(space_allowed(policy)), "　", "[^　]+"), "fullwidth-space", F.lit(" "))


def compatibility(rows: DataFrame) -> DataFrame:
    found = occurrences(rows, f"[{COMPATIBLE}]", f"[^{COMPATIBLE}]+").withColumn("to", compatibility_form(F.col("word"))).where("to is not null")
    return finding(found, "ja-compatibility", F.col("to"))


def katakana_runs(rows: DataFrame) -> DataFrame:
    return occurrences(rows, f"[{KATAKANA}]+", f"[^{KATAKANA}]+")


def variants(rows: DataFrame, table: DataFrame) -> DataFrame:
    """A whole maximal katakana run that is a variant."""
    found = katakana_runs(rows).join(table.select(F.col("variant").alias("word"), "preferred"), "word").where("word <> preferred")
    return finding(found, "ja-variant", F.col("preferred"))


def katakana_consistency(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Words with and without a final long vowel in one document: all but the most frequent form."""
    runs = katakana_runs(rows)
    if table is not None:
        runs = runs.join(table.select(F.col("variant").alias("word")), "word", "left_anti")
    return _inconsistent(runs)


def _inconsistent(runs: DataFrame) -> DataFrame:
    runs = runs.where(F.char_length("word") >= 3).withColumn("key", F.regexp_replace("word", "ー+$", "")).where(F.char_length("key") >= 2)
    of_key, of_form = Window.partitionBy("doc_id", "key"), Window.partitionBy("doc_id", "key", "word")
    best = F.max(F.struct("n", F.col("word").endswith("ー").alias("long"), F.octet_length("word").alias("bytes"), "word")).over(of_key)
    runs = runs.withColumn("n", F.count("*").over(of_form)).withColumn("winner", best["word"])
    return finding(runs.where("word <> winner"), "ja-variant", F.col("winner"))


def _minority_marks(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id")
    western = F.col("word").isin("，", "．")
    both = found.withColumn("we", F.count_if(western).over(w)).withColumn("ja", F.count_if(~western).over(w)).where("ja > 0 and we > 0")
    to = F.when(western, F.translate("word", "，．", "、。")).otherwise(F.translate("word", "、。", "，．"))
    return finding(both.where(western == (F.col("ja") >= F.col("we"))), "ja-punctuation", to)


def punctuation_style(rows: DataFrame) -> DataFrame:
    """、。 and ，． in one document: the rarer kind; the Japanese marks win ties."""
    return _minority_marks(occurrences(rows, f"[{MARKS}]", f"[^{MARKS}]+"))


def kanji_consistency(rows: DataFrame) -> DataFrame:
    """Both spellings of a pair in one document: the rarer one, of equal ones the first of the pair."""
    forms = [F.struct(F.lit(i).alias("pair"), F.lit(left).alias("left"), F.lit(form).alias("form"), F.lit(other).alias("other")) for i, (a, b) in enumerate(KANJI_PAIRS) for left, form, other in ((True, a, b), (False, b, a))]
    rows = lines_of(rows).withColumn("text", from_bytes(F.col("b"))).where(F.col("text").rlike("|".join(f for p in KANJI_PAIRS for f in p)))
    rows = rows.select("doc_id", "line", "line_offset", "text", F.explode(F.array(*forms)).alias("z")).select("*", "z.*").where(F.contains("text", "form"))
    parts = rows.withColumn("parts", F.split("text", F.col("form"), -1))
    starts = running(F.col("parts"), lambda x: F.octet_length(x) + F.octet_length("form"))
    # the parts after the first begin behind an occurrence
    at = parts.select("doc_id", "line", "line_offset", "pair", "left", "form", "other", F.explode(F.slice(starts, F.lit(2), F.size("parts"))).alias("end"))
    w = Window.partitionBy("doc_id", "pair")
    at = at.withColumn("a", F.count_if("left").over(w)).withColumn("b", F.count_if(~F.col("left")).over(w)).where("a > 0 and b > 0 and left = (a <= b)")
    col = F.col("end") - F.octet_length("form")
    return finding(at.select("doc_id", "line", col.alias("col"), (F.col("line_offset") + col).alias("offset"), F.col("form").alias("word"), "other"), "ja-variant", F.col("other"))


def numbers(rows: DataFrame) -> DataFrame:
    """(.., canonical, kanji) of numbers with a unit: commas dropped, kanji digits by position."""
    run = f"(?:[0-9][0-9,]*|[{KANJI_DIGITS}]+)[{UNITS}]"
    digits = f"0-9,{KANJI_DIGITS}"
    found = occurrences(rows, run, f"[0-9][0-9,]*|[{KANJI_DIGITS}]+|[^{digits}]+|,")
    plain = F.translate(F.replace("word", F.lit(","), F.lit("")), KANJI_DIGITS, "00123456789")
    return found.select("*", plain.alias("canonical"), F.col("word").rlike(f"^[{KANJI_DIGITS}]").alias("kanji"))


def number_style(rows: DataFrame) -> DataFrame:
    """A number in both styles: those in the rarer style; arabic wins ties, its first form is suggested."""
    w = Window.partitionBy("doc_id", "canonical")
    first = lambda c: F.min(F.when(c, F.struct("offset", "word"))).over(w)["word"]
    found = numbers(rows).withColumn("k", F.count_if("kanji").over(w)).withColumn("a", F.count_if(~F.col("kanji")).over(w))
    found = found.withColumn("first_k", first(F.col("kanji"))).withColumn("first_a", first(~F.col("kanji"))).where("k > 0 and a > 0 and kanji = (a >= k)")
    return finding(found, "ja-number-style", F.when(F.col("kanji"), F.col("first_a")).otherwise(F.col("first_k")))


def matches(pattern: str) -> tuple[str, str, str]:
    """Patterns for the matches of a rule, for what lies between them, and for telling the two apart.  A match is not empty: it
    does not end where the one before it, or what lies between, has ended."""
    some = f"(?:{pattern})(?!\\G)"
    return some, f"[\\s\\S]+?(?={some}|\\z)", f"^(?:{pattern})$"


def regex_rules(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame | None:
    """Every non-empty match of a (pattern, replacement) rule that the replacement changes."""
    out = None
    for pattern, to in rules:
        found = occurrences(rows, *matches(pattern)).withColumn("to", F.regexp_replace("word", pattern, to)).where("to <> word and word <> ''")
        part = finding(found, "ja-variant", F.col("to"))
        out = part if out is None else out.unionByName(part)
    return out


GRAM = 3  # characters of a factor that are looked up
IN_PLAN = 8  # rules that are expressions of their own; more are looked up


def factor(pattern: str) -> str:
    """The longest text that every match of a regular expression surely contains, or an empty one.

    Only plain characters outside of groups and classes are looked at; alternatives at the top, flags that change letters or spaces, and quoted or
    numbered escapes give an empty text."""
    import re

    if re.search(r"\(\?[a-zA-Z]*[ix]|\\[^\WdDsSwWbBAzZGhHvVRrntf]|\[\^?\]", pattern):
        return ""
    piece = re.compile(r"\\(?P<escaped>\W)|(?P<class>\\\w|[.^$])|(?P<open>[\[(])|(?P<close>[\])])|(?P<most>\+[+?]?)|(?P<count>[?*][+?]?|\{[^}]*\}[+?]?)|(?P<either>\|)|(?P<plain>.)", re.DOTALL)
    runs, nested = [""], []
    for m in piece.finditer(pattern):
        kind = m.lastgroup
        in_class = bool(nested) and nested[-1] == "["
        if kind == "open" and not (in_class and m[0] == "("):
            nested.append(m[0])
            runs.append("")
        elif kind == "close" and not (in_class and m[0] == ")"):
            if not nested:
                return ""
            nested.pop()
        elif nested:
            continue
        elif kind == "either":
            return ""
        elif kind in ("plain", "escaped"):
            runs[-1] += m["escaped"] or m["plain"]
        else:
            if kind == "count":
                runs[-1] = runs[-1][:-1]
            runs.append("")
    return max(runs, key=len)


def indexed_rules(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``regex_rules`` in a plan that does not grow with the number of rules.

    Each rule stands under the first ``GRAM`` characters (or fewer) of its ``factor``; a line asks for the rules of its own runs of so many characters and
    runs those whose factor it contains, and all rules without one.  A line is copied for each rule that it asks for, so short runs, which most lines have, cost
    more than the matches.  The table of rules is as long as the list that was handed in."""
    rows = lines_of(rows)
    known = [(factor(p), p, to) for p, to in rules]
    sure = [k for k in known if k[0] and "\\G" not in k[1]]
    rest = [k for k in known if k not in sure]
    out = _matched(rows, sure, _of_sure)
    return out.unionByName(_matched(rows, rest, _of_any)) if rest else out


def _of_sure() -> Column:
    """Matches (w, o) of a rule whose matches are never empty: what lies between them is what they cut the line into."""
    t, pattern = F.col("t"), F.col("pattern")
    pairs = bound(F.regexp_extract_all(t, pattern, F.lit(0)), lambda w: F.arrays_zip(w.alias("w"), F.slice(F.split(t, pattern, -1), F.lit(1), F.size(w)).alias("gap")))
    size = lambda z: F.octet_length(z["w"]) + F.octet_length(z["gap"])
    return bound(pairs, lambda p: F.zip_with(p, running(p, size), lambda z, o: F.struct(z["w"].alias("w"), (o + F.octet_length(z["gap"])).alias("o"))))


def _of_any() -> Column:
    parts = F.regexp_extract_all("t", F.col("run"), F.lit(0))
    zipped = bound(parts, lambda p: F.arrays_zip(p.alias("w"), running(p, F.octet_length).alias("o")))
    return F.filter(zipped, lambda z: F.regexp_like(z["w"], F.col("hit")))


def _matched(rows: DataFrame, known: list[tuple[str, str, str]], places: Callable[[], Column]) -> DataFrame:
    """Findings of rules (factor, pattern, replacement); ``places`` are a rule's matches (w, o) in a line."""
    import json

    keyed = [(f[:GRAM], f, f"{run}|{other}", hit, p, to) for f, p, to in known for run, other, hit in [matches(p)]]
    table = rows.sparkSession.createDataFrame(keyed, "gram string, factor string, run string, hit string, pattern string, to string")
    literal = lambda n: F.from_json(F.lit(json.dumps(sorted({k[0] for k in keyed if len(k[0]) == n}))), "array<string>")
    keep = [c for c in rows.columns if c != "b"]
    lengths = {len(k[0]) for k in keyed}
    grams = {n: F.array_intersect(F.regexp_extract_all(F.col("t"), F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1)), literal(n)) for n in lengths - {0}} | {0: F.array(F.lit(""))}
    asked = rows.withColumn("t", from_bytes(F.col("b"))).select(*keep, "t", F.explode(F.concat(F.array().cast("array<string>"), *[grams[n] for n in sorted(lengths)])).alias("gram"))
    met = asked.join(F.broadcast(table), "gram").where(F.contains("t", "factor"))
    found = met.select(*keep, "pattern", "to", F.explode(places()).alias("z"))
    found = found.select(*keep, F.col("z.w").alias("word"), F.col("z.o").alias("col"), (F.col("line_offset") + F.col("z.o")).alias("offset"), F.regexp_replace("z.w", F.col("pattern"), F.col("to")).alias("to"))
    return finding(found.where("to <> word and word <> ''"), "ja-variant", F.col("to"))


NUMBER = f"(?:[0-9][0-9,]*|[{KANJI_DIGITS}]+)[{UNITS}]"
NOT_NUMBER = f"[0-9][0-9,]*|[{KANJI_DIGITS}]+|[^0-9,{KANJI_DIGITS}]+|,"
CANDIDATE = "array<struct<phase:int,word:string,col:bigint,place:int,to:string>>"


def candidates(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Everything in a line that can become a finding, as an array of (phase, word, col, place, to): matches of rules (1, with
    their replacement), runs and characters of the classes (2), kanji forms (4, with their pair and the other form), and
    numbers with a unit (5)."""
    none = F.array().cast(CANDIDATE)

    def row(phase: int, word: Column, col: Column, place: Column | None = None, to: Column | None = None) -> Column:
        empty = F.lit(None)
        return F.struct(F.lit(phase).alias("phase"), word.alias("word"), col.alias("col"), (empty if place is None else place).cast("int").alias("place"), (empty if to is None else to).cast("string").alias("to"))

    def hits(phase: int, run: str, other: str, hit: str, to=lambda w: None) -> Column:
        parts = F.regexp_extract_all(text, F.lit(f"{run}|{other}"), F.lit(0))
        zipped = F.arrays_zip(parts.alias("w"), running(parts, F.octet_length).alias("o"))
        found = F.transform(F.filter(zipped, lambda z: z["w"].rlike(hit)), lambda z: row(phase, z["w"], z["o"], to=to(z["w"])))
        return F.when(text.rlike(run), found).otherwise(none)

    every = KATAKANA + FULL_ALNUM + HALF_KANA + COMPATIBLE + "　" + MARKS
    classes = f"[{KATAKANA}]+|[{FULL_ALNUM}]+|[{HALF_KANA}]+|[{COMPATIBLE}　{MARKS}]"
    out = [hits(1, *matches(p), lambda w, p=p, to=to: F.regexp_replace(w, p, to)) for p, to in rules]
    out += [hits(2, classes, f"[^{every}]+", f"^[{every}]"), hits(5, NUMBER, NOT_NUMBER, f"^{NUMBER}$")]
    forms = F.array(*[F.struct(F.lit(2 * i + j).alias("place"), F.lit(p[j]).alias("form"), F.lit(p[1 - j]).alias("other")) for i, p in enumerate(KANJI_PAIRS) for j in (0, 1)])

    def of_form(f: Column) -> Column:
        parts = F.split(text, f["form"], -1)  # those after the first begin behind an occurrence
        ends = F.slice(running(parts, lambda x: F.octet_length(x) + F.octet_length(f["form"])), F.lit(2), F.size(parts))
        return F.transform(ends, lambda e: row(4, f["form"], e - F.octet_length(f["form"]), f["place"], f["other"]))

    some = F.filter(forms, lambda f: F.contains(text, f["form"]))
    out.append(F.when(text.rlike("|".join(f for p in KANJI_PAIRS for f in p)), F.flatten(F.transform(some, of_form))).otherwise(none))
    return F.concat(*out)


def document_findings(rows: DataFrame, table: dict[str, str], space: str, rules: tuple[tuple[str, str], ...] = (), consistency: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """All Japanese findings with their phase, from one pass over lines (with prose and skip) and one shuffle: rules 1,
    characters and variants 2, katakana forms 3, kanji forms 4, numbers 5, marks 6.

    ``consistency`` asks for katakana forms, ``without`` names checks to leave out: fullwidth, halfwidth, compatibility, kanji,
    numbers, punctuation.  Groups are the katakana words, pairs, numbers and marks of a document.  A group of two sides (arabic or kanji
    digits, one form or the other, western or Japanese marks) reports its lesser one."""
    text = from_bytes(F.col("b"))
    asked = F.col("b").rlike("[\\xE2-\\xEF]")
    for p, _ in rules:
        asked = asked | text.rlike(p)
    found = rows.where(asked).withColumn("t", text).select("doc_id", "line", "line_offset", "prose", "skip", F.explode(candidates(F.col("t"), rules)).alias("z"))
    found = found.select("doc_id", "line", "prose", "skip", (F.col("line_offset") + F.col("z.col")).alias("offset"), "z.*")
    w = F.col("word")
    fixed = mapping(table)[w] if table else F.lit(None).cast("string")
    kata, mark = w.rlike(f"^[{KATAKANA}]"), w.rlike(f"^[{MARKS}]")
    run_to = (
        F.when(kata, F.when(fixed != w, fixed))
        .when(w.rlike(f"^[{FULL_ALNUM}]"), ascii_of_fullwidth(w))
        .when(w.rlike(f"^[{HALF_KANA}]"), full_of_halfwidth(w))
        .when(w == "　", F.when(space_allowed(space), F.lit(" ")))
        .otherwise(compatibility_form(w))
    )
    found = found.withColumn("to", F.when((F.col("phase") == 2) & ~mark, run_to).otherwise(F.col("to")))
    stem = F.regexp_replace(w, "ー+$", "")
    free = kata & F.col("to").isNull() & (F.char_length(w) >= 3) & (F.char_length(stem) >= 2) & F.lit(consistency)
    phase = F.when(F.col("phase") != 2, F.col("phase")).when(mark, 6).when(free & ~F.col("skip"), 3).otherwise(2)
    found = found.withColumn("phase", phase).where("(phase = 1 and to <> word and word <> '' and not skip) or (phase = 2 and to is not null and not skip) or phase > 2")
    of = {"kanji": F.col("phase") == 4, "numbers": F.col("phase") == 5, "punctuation": F.col("phase") == 6}
    of |= {n: (F.col("phase") == 2) & w.rlike(f"^[{c}]") for n, c in (("fullwidth", FULL_ALNUM), ("halfwidth", HALF_KANA), ("compatibility", COMPATIBLE))}
    for name in without:
        found = found.where(~of[name])
    key = F.when(F.col("phase") == 3, stem).when(F.col("phase") == 4, F.floor(F.col("place") / 2).cast("string")).when(F.col("phase") == 5, F.translate(F.replace(w, F.lit(","), F.lit("")), KANJI_DIGITS, "00123456789")).otherwise(F.lit(""))
    side = F.when(F.col("phase") == 4, F.col("place") % 2 == 0).when(F.col("phase") == 5, w.rlike(f"^[{KANJI_DIGITS}]")).otherwise(w.isin("，", "．"))
    grouped = found.withColumn("key", key).withColumn("side", side).repartition("doc_id", "phase", "key")
    of_key, of_form = Window.partitionBy("doc_id", "phase", "key"), Window.partitionBy("doc_id", "phase", "key", "word")
    first = lambda c: F.min(F.when(c, F.struct("offset", "word"))).over(of_key)["word"]
    grouped = grouped.withColumn("n", F.count("*").over(of_form))
    best = F.max(F.struct("n", w.endswith("ー").alias("long"), F.octet_length(w).alias("bytes"), "word")).over(of_key)["word"]
    grouped = grouped.select("*", best.alias("winner"), F.count_if("side").over(of_key).alias("a"), F.count_if(~F.col("side")).over(of_key).alias("b"), first(F.col("side")).alias("first_a"), first(~F.col("side")).alias("first_b"))
    grouped = grouped.where("phase <= 2 or (phase = 3 and word <> winner) or (phase > 3 and a > 0 and b > 0 and side = (b >= a))")
    fix = (
        F.when(F.col("phase") == 3, F.col("winner"))
        .when(F.col("phase") == 5, F.when(F.col("side"), F.col("first_b")).otherwise(F.col("first_a")))
        .when(F.col("phase") == 6, F.when(F.col("side"), F.translate(w, "，．", "、。")).otherwise(F.translate(w, "、。", "，．")))
        .otherwise(F.col("to"))
    )
    kind = (
        F.when(F.col("phase") == 5, "ja-number-style")
        .when(F.col("phase") == 6, "ja-punctuation")
        .when((F.col("phase") != 2) | kata, "ja-variant")
        .when(w.rlike(f"^[{FULL_ALNUM}]"), "fullwidth-alnum")
        .when(w.rlike(f"^[{HALF_KANA}]"), "halfwidth-kana")
        .when(w == "　", "fullwidth-space")
        .otherwise("ja-compatibility")
    )
    return grouped.select("doc_id", "line", F.col("col"), "offset", F.octet_length(w).cast("long").alias("len"), "word", kind.alias("kind"), F.array(fix).alias("suggestions"), "phase")
