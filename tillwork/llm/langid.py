"""Language identification, family first.

Languages are grouped into families of close relatives. Linear support vector machines, one for
each two families, vote for the family; within it, one for each two of its languages vote for
the language. Their features are hashed words, word beginnings and word endings, so a score is
a mean of weights over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import columns, fraction_of
from tillwork.llm.hashedtext import (
    Bags, descend, folded_words, from_blob, places, prefix, segment_sums, sigmoid, suffix, to_blob,
)
from tillwork.llm.words import Words, pieces

# Families of related languages, by ISO 639-1 code. A language not named is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
}
DIM = 1 << 16
PER_LANGUAGE = 2000  # documents of each language on which machines are fitted
UNKNOWN = "und"
SCALE = 40.0  # means of weights are small numbers; machines see them times this
STEEP = 4.0  # of the sigmoid that turns a margin into a share
ROUNDS = 120


def family_of(lang: str, families: dict[str, tuple[str, ...]]) -> str:
    return next((f for f, members in families.items() if lang in members), f"only-{lang}")


def _places(words: Words) -> np.ndarray:
    return places([words.hashes(), prefix(words, 3).hashes(), suffix(words, 3).hashes()], DIM)


def fit_machine(texts: list[pa.Array], side: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss; ``side``: 1 or -1 for each text."""
    parts = []
    for piece in texts:
        words = folded_words(piece)
        parts.append((_places(words), words.first))
    bags = Bags.of(parts, DIM)
    per_row = segment_sums(bags.value, bags.first)
    bags.value *= (SCALE / np.maximum(per_row, 1))[bags.row].astype(np.float32)
    weight = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum()))

    def slope(w):
        gap = np.maximum(0, 1 - side * (bags.times(w[:-1]) + w[-1]))
        g = -2 * weight * side * gap
        return np.r_[bags.back(g) + 1e-5 * w[:-1], g.sum()]

    w = descend(slope, np.zeros(DIM + 1), 0.05, ROUNDS)
    return w[:-1], float(w[-1])


class Model:
    """Languages by family and the weights of all machines."""

    def __init__(self, langs: list[str], families: dict[str, tuple[str, ...]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(langs):
            self.families.setdefault(family_of(lang, families), []).append(lang)
        self.duels = list(combinations(sorted(self.families), 2))
        self.duels += [d for f in sorted(self.families) for d in combinations(self.families[f], 2)]
        self.weights = np.zeros((DIM, len(self.duels)))
        self.bias = np.zeros(len(self.duels))

    def sides(self, lang: str) -> list[tuple[int, int]]:
        """The machines that learn from a language, and on which side it stands."""
        family = next(f for f, members in self.families.items() if lang in members)
        return [(i, 1 if duel[0] in (lang, family) else -1) for i, duel in enumerate(self.duels)
                if family in duel or lang in duel]

    def _vote(self, margins: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each row, which of the names wins, and its mean share in its own duels: as high for two names as for many."""
        wins, share = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        for i, duel in enumerate(self.duels):
            if duel[0] in names and duel[1] in names:
                for name, sign in ((duel[0], 1), (duel[1], -1)):
                    at = names.index(name)
                    wins[:, at] += sign * margins[:, i] > 0
                    share[:, at] += sigmoid(STEEP * sign * margins[:, i])
        if len(names) == 1:
            share += 1
        best = np.argmax(wins + share / (2 * len(names)), axis=1)
        return best, np.take_along_axis(share, best[:, None], 1)[:, 0] / max(1, len(names) - 1)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and share of each text."""
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        letters = np.asarray(pc.match_substring_regex(texts.fill_null(""), r"\pL"))
        if not self.families:
            return lang, score
        words = folded_words(texts)
        at = _places(words) if len(words.starts) else np.empty((3, 0), np.int32)
        value = sum(self.weights[a] for a in at)
        margins = segment_sums(value, words.first) * SCALE / np.maximum(3 * words.counts, 1)[:, None] + self.bias
        names = sorted(self.families)
        family, of_family = self._vote(margins, names)
        for i, name in enumerate(names):
            rows = np.flatnonzero((family == i) & letters)
            best, share = self._vote(margins[rows], self.families[name])
            lang[rows] = np.array(self.families[name], object)[best]
            score[rows] = of_family[rows] * share
        return lang, score


def fit(docs: DataFrame, eligible: Column, per_language: int = PER_LANGUAGE,
        families: dict[str, tuple[str, ...]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """The model; each machine is fitted in a task of its own on at most ``per_language`` documents a language.

    ``eligible``: condition on ``doc_id`` that a row to learn from meets. Languages are few, their
    counts are read by the driver.
    """
    named = columns(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    known = named.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & eligible)
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    model = Model(list(count), families)
    if not model.duels:
        return model
    share = F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, 1.3 * per_language / n))])
    sides = F.create_map(*[x for lang in count for x in (
        F.lit(lang), F.array(*[F.struct(F.lit(i).alias("machine"), F.lit(s).alias("side")) for i, s in model.sides(lang)]))])
    taken = known.filter(fraction_of("doc_id", 5) < share[F.col("lang")])
    learned = taken.select("doc_id", "text", "lang", F.explode(sides[F.col("lang")]).alias("s")).select(
        "doc_id", "text", "lang", "s.machine", "s.side")

    def train(table: pa.Table) -> pa.Table:
        ids, langs = np.asarray(table.column("doc_id")), np.array(table.column("lang").to_pylist())
        order = np.lexsort((ids, langs))
        run = np.r_[True, langs[order][1:] != langs[order][:-1]]
        place = np.arange(len(order)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        table = table.take(pa.array(np.sort(order[place < per_language])))
        batches = [p for b in table.combine_chunks().to_batches() for p in pieces(b, "text")]
        side = np.concatenate([np.asarray(b.column("side")) for b in batches])
        w, b = fit_machine([p.column("text") for p in batches], side)
        return pa.table([pa.array([table.column("machine")[0].as_py()], pa.int32()), pa.array([to_blob(w)]),
                         pa.array([b])], ["machine", "weights", "bias"])

    rows = learned.groupBy("machine").applyInArrow(train, "machine int, weights binary, bias double")
    for r in rows.collect():  # one row per machine
        model.weights[:, r["machine"]], model.bias[r["machine"]] = from_blob(r["weights"]), r["bias"]
    return model


def identify(docs: DataFrame, buckets: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE,
             families: dict[str, tuple[str, ...]] = FAMILIES, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``: one row per input row; columns in ``keep`` follow.

    Learns from documents with a language whose crc32 of the id as text, modulo ``buckets``, is
    not ``held_out``; nothing but text enters a prediction. A null text, or one without a
    letter, is ``und`` with score 0; without anything to learn from all are. A null id is not
    held out and not learned from; repeated rows each give a row. No rows give no rows.

    ``score``: mean share of the family in its duels with the other families, times that of the
    language in its duels within the family. Neither shrinks with the number of classes.
    """
    bucket = F.crc32(F.col("doc_id").cast("string")) % buckets
    model = fit(docs, bucket != held_out, per_language, families, id_col, text_col, lang_col)
    return _predicted(docs, model, bucket == held_out, id_col, text_col, keep)


def _predicted(docs: DataFrame, fitted: Model, held: Column, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    more = [f"keep_{c}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                lang, score = model.value.predict(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()),
                                       pa.array(score), *[part.column(c) for c in more]],
                                      ["doc_id", "held_out", "lang_pred", "score", *more])

    named = columns(docs, id_col, text_col, *keep).toDF("doc_id", "text", *more).withColumn(
        "held_out", F.coalesce(held, F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, lang_pred string, score double"
    return named.mapInArrow(run, schema + "".join(f", `{c}` {kinds[c]}" for c in more))


def in_a_language(docs: DataFrame, min_score: float = 0.3, buckets: int = 4, held_out: int = 2,
                  per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, but those without a letter or with a score under ``min_score``.

    Without anything to learn from no score is known, and only documents without a letter go.
    """
    bucket = F.crc32(F.col("doc_id").cast("string")) % buckets
    model = fit(docs, bucket != held_out, per_language, families, id_col, text_col, lang_col)
    if not model.families:
        return docs.filter(docs[f"`{text_col}`"].rlike(r"\p{L}"))
    rest = tuple(c for c in docs.columns if c != id_col)
    found = _predicted(docs, model, bucket == held_out, id_col, text_col, rest)
    found = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return found.select(*[F.col("doc_id" if c == id_col else f"`keep_{c}`").alias(c) for c in docs.columns])
