"""Quality rules: lines that too many documents of a host share are removed, depleted documents rejected.

DataFrame functions only. What is counted within a text is counted in its own row, over
arrays; only the lines' hashes are shuffled, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import bound, columns

WHITE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1


def word_array(text: Column) -> Column:
    """The words of a text; a null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP, -1))


def _equal_neighbours(sorted_array: Column, key) -> Column:
    """Elements of a sorted array whose key occurs twice or more."""
    def same(x, i):
        return key(x).eqNullSafe(key(F.get(sorted_array, i - 1))) | key(x).eqNullSafe(key(F.get(sorted_array, i + 1)))

    return F.filter(sorted_array, same)


def with_repeated_words(df: DataFrame, words: str, out: str, window: int = 3) -> DataFrame:
    """Add how many words lie in a sequence of ``window`` words that the text has twice or more.

    Sequences are hashed and sorted within the row. Leading bits of the hash and the place
    share one long, so that a plain sort finds the few candidates; only these are compared
    by whole hash. Each step reads the column of the step before more than once, which keeps
    the optimiser from working it out anew for every element.
    """
    n = F.size(words)
    parts = [F.slice("__h", i + 1, F.greatest(n - (window - 1), F.lit(0))) for i in range(window)]
    df = df.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("__w", F.transform(F.arrays_zip(*[p.alias(f"p{i}") for i, p in enumerate(parts)]),
                                          lambda s: F.xxhash64(*[s[f"p{i}"] for i in range(window)])))
    packed = F.transform("__w", lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long")))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.sort_array(packed))
                       .otherwise(F.array().cast("array<long>")))
    df = df.withColumn("__c", _equal_neighbours(F.col("__s"), lambda x: F.shiftright(x, _PLACE_BITS)))
    df = df.withColumn("__d", F.array_sort(F.transform("__c", lambda x: F.struct(
        F.get("__w", x.bitwiseAND(F.lit(_PLACE)).cast("int")).alias("h"),
        x.bitwiseAND(F.lit(_PLACE)).cast("int").alias("i")))))
    df = df.withColumn("__e", _equal_neighbours(F.col("__d"), lambda x: x["h"]))
    covered = F.flatten(F.transform("__e", lambda x: F.transform(
        F.sequence(F.lit(0), F.lit(window - 1)), lambda k: x["i"] + k)))
    return (df.withColumn(out, F.size(F.array_distinct(covered)).cast("long"))
            .drop("__h", "__w", "__s", "__c", "__d", "__e"))


def text_measures(docs: DataFrame, window: int = 3) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long, for column ``text``."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("__words", word_array(F.col("text"))).withColumn(
        "__lines", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    counted = with_repeated_words(counted, "__words", "n_repeat_words", window)
    return counted.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__words", "__lines")


def normal_line(line: Column) -> Column:
    """Lower case, digits as one zero, single spaces: the form in which lines are compared."""
    spaced = F.regexp_replace(F.btrim(line, F.lit(WHITE)), GAP, " ")
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[n])
    return on


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with a word: host, line hash, document, text hash, place, words."""
    lines = docs.select("doc_id", "host", F.xxhash64("text").alias("text_hash"),
                        F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.filter(F.btrim("line", F.lit(WHITE)) != "")
    return lines.select("host", F.xxhash64(normal_line(F.col("line"))).alias("line_hash"), "doc_id",
                        "text_hash", "place", F.size(F.split(F.btrim("line", F.lit(WHITE)), GAP, -1)).alias("words"))


def frequent_lines(lines: DataFrame, least: int) -> DataFrame:
    """Lines of a host in more than ``least`` of its documents, however many these are."""
    return (lines.select("host", "line_hash", "doc_id").distinct().groupBy("host", "line_hash")
            .agg(F.count("doc_id").alias("n_docs")).filter(F.col("n_docs") > least))


def removed_lines(named: DataFrame, least: int) -> DataFrame:
    """Per document with any: the places of its frequent lines, and their words."""
    lines = lines_of(named)
    frequent = frequent_lines(lines, least).select(*[F.col(c).alias(f"f_{c}") for c in ("host", "line_hash")])
    # rows that repeat id and text give the same lines again
    hit = lines.join(frequent, lines["host"].eqNullSafe(frequent["f_host"])
                     & (lines["line_hash"] == frequent["f_line_hash"]))
    return hit.select("host", "doc_id", "text_hash", "place", "words").distinct().groupBy(
        "host", "doc_id", "text_hash").agg(F.sum("words").alias("line_words"), F.collect_list("place").alias("places")).toDF(
        "r_host", "r_doc_id", "r_text_hash", "line_words", "places")


def _with_removed(named: DataFrame, removed: DataFrame) -> DataFrame:
    return named.join(removed, named["doc_id"].eqNullSafe(removed["r_doc_id"])
                      & (named["text_hash"] == removed["r_text_hash"])
                      & named["host"].eqNullSafe(removed["r_host"]), "left")


def without_frequent_lines(docs: DataFrame, least: int = 5, id_col: str = "doc_id", text_col: str = "text",
                           host_col: str = "source") -> DataFrame:
    """``doc_id, host, text``: the texts without the lines that too many documents of their host have.

    A null text stays null; a text of such lines alone is empty.
    """
    named = columns(docs, id_col, text_col, host_col).toDF("doc_id", "text", "host")
    hashed = named.withColumn("text_hash", F.xxhash64("text"))
    joined = _with_removed(hashed, removed_lines(named, least).drop("line_words"))
    kept = bound(F.split("text", "\n", -1), lambda lines: F.concat_ws("\n", F.transform(
        F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")), lambda i: F.get(lines, i))))
    return joined.select("doc_id", "host", F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("text"))


def judge(docs: DataFrame, least: int = 5, min_left: float = 0.7, min_words: int = 50,
          max_repeat: float = 0.5, window: int = 3, id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source") -> DataFrame:
    """One row per input row: the measures, ``base_failed``, ``n_line_words`` and ``kept``.

    ``n_line_words``: words on lines that more than ``least`` documents of the same host have. ``kept`` is false if the base rules
    fail (under ``min_words`` words, or more than ``max_repeat`` of them in repeated
    sequences) or if less than ``min_left`` of the words are left without those lines.

    A null text has no words and fails; a null host is a host of its own; a line that a
    document has several times counts once; rows that repeat id and text count as one
    document but each gives a row; rows without an id are judged but not counted. No rows
    give no rows.
    """
    named = columns(docs, id_col, text_col, host_col).toDF("doc_id", "text", "host")
    base = text_measures(named.withColumn("text_hash", F.xxhash64("text")), window).select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    joined = _with_removed(base, removed_lines(named, least).drop("places"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    gone = F.coalesce("line_words", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("n_line_words"),
        (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept"))
