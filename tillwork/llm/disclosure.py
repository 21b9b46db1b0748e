"""Personal data and the words that give it away, found with DataFrame functions only.

Spans of e-mail and IP addresses, card and phone numbers are found by pattern. Information-theoretic
sanitisation then asks of each word near such a value how much it reveals: over the corpus, the
pointwise mutual information of word and value is weighed against the information of the value itself.
A word that leaves less than ``remove_bits`` of it unknown is removed where it stands near the value,
one that leaves less than ``generalise_bits`` is put in general terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import bound, columns, stash

# Starts inside a run of such characters match if and only if its first start does, unless a match has taken that.
_MAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
LETTERS = r"\p{L}++"
_BLOCK = 256


def sums_before(values: Column) -> Column:
    """For each place of an array, the sum of the elements before it.

    Blocks are summed first, so that long arrays cost little more than a pass.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v)

    def blocks(v: Column) -> Column:
        n = F.ceil(F.size(v) / F.lit(_BLOCK)).cast("int")
        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        of = F.transform(numbers, lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.transform(of, lambda x: F.struct(x.alias("of"), total(x).alias("sum")))

    def spread(parts: Column) -> Column:
        based = F.transform(parts, lambda x, b: F.struct(x["of"].alias("of"), F.aggregate(
            F.slice(parts, F.lit(1), b), F.lit(0).cast("long"), lambda a, y: a + y["sum"]).alias("base")))
        return F.flatten(F.transform(based, lambda x: F.transform(
            x["of"], lambda _, i: x["base"] + total(F.slice(x["of"], F.lit(1), i)))))

    return bound(bound(values, blocks), spread)


def places(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of a pattern and the texts between them, from which their places follow."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)
    doubled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def normal(kind: Column, match: Column) -> Column:
    """The value without its spelling, behind its kind."""
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(match)).when(kind == "ip", match).otherwise(_digits(match)))


def accepted(kind: Column, match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(match)
    card = F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == "ip", small).when(kind == "card", card).when(
        kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True))


def numbered(runs: Column, gaps: Column) -> Column:
    """Matches with the texts before and behind them and their start: run, before, after, start."""
    n = F.size(runs)
    sizes = F.zip_with(runs, F.slice(gaps, F.lit(1), n), lambda r, g: F.length(g) + F.length(r))
    around = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    placed = F.zip_with(around, sums_before(sizes), lambda g, at: F.struct(
        g["before"].alias("before"), g["after"].alias("after"), (at + F.length(g["before"])).alias("start")))
    return F.zip_with(runs, placed, lambda r, p: F.struct(
        r.alias("run"), p["before"].alias("before"), p["after"].alias("after"), p["start"].alias("start")))


def words_in(context: Column) -> Column:
    """Runs of three or more letters of a context (value, from, text, is_left), in lower case, with their places.

    A run that touches the outer edge of the context, its left or its right one, may be cut and is left out.
    """
    text = context["text"]
    runs, gaps = places(text, LETTERS)
    found = bound(F.struct(runs.alias("runs"), gaps.alias("gaps")), lambda x: numbered(x["runs"], x["gaps"]))
    whole = F.filter(found, lambda x: (F.length(x["run"]) >= 3) & F.when(context["is_left"], x["start"] > 0).otherwise(
        x["start"] + F.length(x["run"]) < F.length(text)))
    return F.transform(whole, lambda x: F.struct(
        context["value"].alias("value"), F.lower(x["run"]).alias("term"), (context["from"] + x["start"]).alias("start"),
        (context["from"] + x["start"] + F.length(x["run"])).alias("end")))


def personal_data(docs: DataFrame, reach: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written to the shared folder: ``doc_id, text_hash, base, values, near``.

    ``base``: spans (kind, start, end) by kind, then start. ``near``: words (value, term, start, end) within
    ``reach`` characters of a value and not beyond the next match of its kind.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    named = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    may = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]")}
    found = {k: places(text, p) for k, p in PATTERNS.items()}
    matched = named.select("doc_id", "text", *[F.when(may[k], found[k][0]).otherwise(none).alias(k) for k in KINDS])
    # the texts between are cut out only where something was found
    cut = matched.select("doc_id", F.xxhash64("text").alias("text_hash"), F.array(*[F.struct(
        F.lit(k).alias("kind"), F.col(k).alias("runs"), F.when(F.size(k) > 0, found[k][1]).otherwise(none).alias("gaps"))
        for k in KINDS]).alias("matches"))
    placed = F.flatten(F.transform("matches", lambda m: F.transform(numbered(m["runs"], m["gaps"]), lambda x: F.struct(
        m["kind"].alias("kind"), x["run"].alias("run"), x["start"].alias("start"), (x["start"] + F.length(x["run"])).alias("end"),
        F.substring(x["before"], F.lit(-reach), F.lit(reach)).alias("left"),
        F.substring(x["after"], F.lit(1), F.lit(reach)).alias("right")))))
    good = cut.select("doc_id", "text_hash", F.filter(placed, lambda x: accepted(x["kind"], x["run"])).alias("good"))
    contexts = F.flatten(F.transform("good", lambda x: bound(normal(x["kind"], x["run"]), lambda value: F.array(
        F.struct(value.alias("value"), (x["start"] - F.length(x["left"])).alias("from"), x["left"].alias("text"),
                 F.lit(True).alias("is_left")),
        F.struct(value.alias("value"), x["end"].alias("from"), x["right"].alias("text"), F.lit(False).alias("is_left"))))))
    with_contexts = good.select("doc_id", "text_hash", F.transform("good", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"), contexts.alias("contexts"))
    return stash(with_contexts.select(
        "doc_id", "text_hash", "base", F.array_distinct(F.transform("contexts", lambda c: c["value"])).alias("values"),
        F.flatten(F.transform("contexts", words_in)).alias("near")), "personal")


def disclosures(docs: DataFrame, found: DataFrame, support: int = 2, min_pmi: int = 3, remove_bits: int = 1,
                generalise_bits: int = 2, text_col: str = "text") -> DataFrame:
    """``value, term, kind, pmi, information``: the words that reveal a value too well.

    Counted are documents: with the value, with the word anywhere, with the word near the value (``support``
    at least), over all texts. ``pmi``, at least ``min_pmi`` bits, is their pointwise mutual information,
    ``information`` that of the value. The word is removed if information - pmi <= ``remove_bits``, and
    generalised if it is <= ``generalise_bits``. Compared are whole numbers, without rounding.
    """
    together = found.select(F.explode(F.array_distinct(F.transform(
        "near", lambda w: F.struct(w["value"].alias("value"), w["term"].alias("term"))))).alias("x")).groupBy(
        "x.value", "x.term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    words = F.array_distinct(F.transform(
        F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}{3,}+"), F.lit(0)), lambda w: F.lower(w)))
    terms = columns(docs, text_col).toDF("text").filter("text is not null").select(F.explode(words).alias("t")).groupBy(
        "t").agg(F.count("*").alias("n_term"))
    values = found.select(F.explode("values").alias("v")).groupBy("v").agg(F.count("*").alias("n_value"))
    joined = together.join(terms, F.col("term") == F.col("t")).join(values, F.col("value") == F.col("v"))
    joined = joined.withColumn("n", found.agg(F.count("*")).scalar())
    both, term, value, n = (F.col(c).cast("decimal(38,0)") for c in ("n_both", "n_term", "n_value", "n"))
    telling = joined.filter((both * n >= 2**min_pmi * value * term) & (both * 2**generalise_bits >= term))
    return telling.select(
        "value", "term", F.when(both * 2**remove_bits >= term, "remove").otherwise("generalise").alias("kind"),
        F.log2(F.col("n_both") / F.col("n_term") * (F.col("n") / F.col("n_value"))).alias("pmi"),
        F.log2(F.col("n") / F.col("n_value")).alias("information"))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))


def find(docs: DataFrame, reach: int = 100, support: int = 2, min_pmi: int = 3, remove_bits: int = 1, generalise_bits: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, text_hash, found``: one row per input row.

    Places count code points, the end is not part of a span. ``found`` has the spans, those of the patterns first, then
    the revealing words near a value, as kinds generalise and remove; ``spans`` is their text. Null texts are empty; rows that
    repeat id and text are documents of their own with equal results; a word that several values reach has
    one span, the stronger; no rows give none.
    """
    personal = personal_data(docs, reach, id_col, text_col)
    telling = disclosures(docs, personal, support, min_pmi, remove_bits, generalise_bits, text_col)
    near = personal.select("doc_id", "text_hash", F.explode("near").alias("w")).select(
        "doc_id", "text_hash", F.col("w.value").alias("near_value"), F.col("w.term").alias("near_term"), "w.start", "w.end").distinct()
    hits = near.join(telling, (F.col("near_value") == F.col("value")) & (F.col("near_term") == F.col("term")))
    spans = hits.groupBy("doc_id", "text_hash", "start", "end").agg(F.max("kind").alias("kind")).groupBy(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    joined = personal.join(spans, personal["doc_id"].eqNullSafe(spans["d"]) & (personal["text_hash"] == spans["h"]), "left")
    empty = F.array().cast(joined.schema["more"].dataType)
    joined = joined.withColumn("found", F.concat("base", F.coalesce("more", empty)))
    return joined.select("doc_id", *map(_count_of, KINDS), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
                         _text_of(F.col("found")).alias("spans"), "text_hash", "found")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``doc_id, text``: personal data as its kind in brackets, revealing words removed or as ``[word]``.

    Of spans that overlap the first in the text decides how the whole is written. A null text stays null.
    """
    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    spans = find(named, **limits).select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.array_sort(F.transform("found", lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("of")).distinct()
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = named.join(spans, named["doc_id"].eqNullSafe(F.col("d")) & (hashed == F.col("h")), "left")
    label = lambda k: F.when(k == "remove", "").when(k == "generalise", "[word]").otherwise(F.concat(F.lit("["), k, F.lit("]")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct(
        x["end"].alias("at"), F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")),
                                       label(x["kind"])).alias("out"))).otherwise(
        F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))
    rest = lambda a: F.concat(a["out"], F.substring("text", (a["at"] + 1).cast("int"), F.length("text")))
    return joined.select("doc_id", F.when(F.col("text").isNotNull(), F.aggregate("of", start, step, rest)).alias("text"))
