"""Learned operators: held-out accuracy, and that held-out labels do not enter."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwork.llm import langid, ordinal, toxicity
from tillwork.llm.common import table

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, BIG, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, BIG, "labels")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_language_on_held_out(docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_languages_do_not_enter(docs):
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    one, two = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(d).collect()} for d in (docs, changed))
    assert one == two


def test_families_and_single_members(spark):
    rows = [(i, f"{w} {w}s {w}ing word{i}", lang) for i in range(80) for lang, w in
            [(("fr", "alpha"), ("es", "beta"), ("en", "gamma"), ("zz", "delta"))[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) == 1
    alone = langid.identify(docs.filter("lang = 'zz'")).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("zz", 1.0)}
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_score_does_not_shrink_with_the_number_of_classes(spark):
    """Eight families, one of five languages, and five stray labels on texts of another language."""
    langs = ["de", "en", "nl", "sv", "da", "fr", "ru", "hi", "tr", "fi", "ar", "zz"]
    rows = [(i, " ".join(f"{lang}{w}{lang}" for w in ("a", "b", "c")) + f" word{i}", lang) for i, lang in enumerate(langs * 20)]
    rows += [(300 + i, f"enaen enben encen word{i}", f"stray{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clear = {i for i, _, lang in rows[:240] if lang != "en"}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert np.mean([got[i].lang_pred == rows[i][2] and got[i].score > 0.8 for i in clear]) > 0.95
    assert {r.doc_id for r in langid.in_a_language(docs).collect()} == {r[0] for r in rows}


def test_without_labels_documents_with_a_letter_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "\u00e9", None)],
                                 "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.in_a_language(docs).collect()} == {1, 4}


def test_language_of_awkward_rows(awkward, nothing):
    got = langid.identify(awkward).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 10))
    assert langid.identify(nothing).count() == 0
    kept = langid.in_a_language(awkward)
    assert kept.dtypes == awkward.dtypes and not {1, 2, 3, 10} & {r.doc_id for r in kept.collect()}


def test_toxicity_on_held_out(docs, labels):
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i) % 5 == 0}
    auc = np.mean([a.score > b.score for a in held if truth[a.doc_id] for b in held if not truth[b.doc_id]])
    assert auc > 0.8  # some 40 toxic documents in four languages to learn from
    assert all((r.sentence is not None) == bool(r.predicted) for r in got)


def test_noisy_or_finds_the_words():
    rng = np.random.default_rng(2)
    texts, toxic = [], []
    for i in range(1200):
        sentences = [" ".join(f"w{x}" for x in rng.integers(0, 300, 8)) for _ in range(rng.integers(1, 12))]
        if i % 5 == 0:
            k = rng.integers(len(sentences))
            sentences[k] += f" VILE{rng.integers(5)}x"
        texts.append(". ".join(sentences) + ".")
        toxic.append(i % 5 == 0)
    w, b = toxicity.fit_weights([pa.array(texts[:500]), pa.array(texts[500:1000])], np.array(toxic[:1000]))
    score, worst, top = toxicity.score_texts(pa.array(texts[1000:]), w, b)
    assert np.mean((score >= 0.5) == np.array(toxic[1000:])) > 0.99
    assert all("VILE" in s for s, t in zip(worst, toxic[1000:]) if t)
    assert np.all(top <= score + 1e-9)


def test_toxicity_of_awkward_rows(awkward, nothing, spark):
    labels = spark.createDataFrame([(4, 0, 1), (4, 0, 0), (7, 0, 0), (None, 0, 1), (9, 0, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == 12
    assert {r.score for r in got if r.doc_id in (1, 2, 3, 10)} == {[r.score for r in got if r.doc_id == 2][0]}
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert all(r.score < 0.01 for r in toxicity.toxicity(awkward, labels.filter("false")).collect())


def ratings(labels):
    return labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))


def test_quality_on_held_out(docs, labels):
    truth = {r.doc_id: r.grade for r in ratings(labels).collect()}
    got = ordinal.grade(docs, ratings(labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    good = [r.kept for r in held if truth[r.doc_id] >= 1]
    poor = [r.kept for r in held if truth[r.doc_id] == 0]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.5


def test_ordered_thresholds():
    rng = np.random.default_rng(0)
    level = rng.random(900)
    texts = [" ".join("up" if rng.random() < x else "down" for _ in range(30)) for x in level]
    grade = np.minimum((level * 5).astype(int), 4)
    w, cuts = ordinal.fit_weights([pa.array(texts)], grade, 5)
    assert np.all(np.diff(cuts) > 0)
    tails = ordinal.reach(pa.array(texts), w, cuts)
    assert np.all(np.diff(tails, axis=1) <= 0)
    assert np.corrcoef(tails.sum(1), grade)[0, 1] > 0.9 and abs(tails.sum(1).mean() - grade.mean()) < 0.1


def test_slope_of_the_ordinal_loss(monkeypatch):
    """The gradient that is followed is that of the likelihood."""
    caught = {}
    monkeypatch.setattr(ordinal, "descend", lambda f, start, *_: caught.update(f=f) or start)
    monkeypatch.setattr(ordinal, "MIN_DOCS", 0)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "B!", "c3"], 6)) for _ in range(40)]
    grade = rng.integers(0, 3, 40)
    w, _ = ordinal.fit_weights([pa.array(texts)], grade, 3)
    p = np.r_[rng.normal(size=len(w)) * 0.05, -0.4, 0.3]

    def loss(p):
        t = ordinal.reach(pa.array(texts), p[:-2], ordinal.thresholds(p[-2:]))
        mass = np.c_[np.ones(40), t] - np.c_[t, np.zeros(40)]
        return -np.log(mass[np.arange(40), grade]).mean() + ordinal.RIDGE / 2 * (p[:-2] ** 2).sum()

    slope, places = caught["f"](p), np.r_[np.flatnonzero(np.abs(caught["f"](p)[:-2]) > 1e-3)[:6], len(p) - 2, len(p) - 1]
    for i in places:
        step = np.zeros(len(p))
        step[i] = 1e-5
        assert abs((loss(p + step) - loss(p - step)) / 2e-5 - slope[i]) < 1e-5


def test_quality_of_awkward_rows(awkward, nothing, spark):
    rated = spark.createDataFrame([(4, 2), (7, 0), (None, 1), (9, None), (9, 1)], "doc_id long, grade int")
    assert ordinal.grade(awkward, rated).count() == 12
    assert ordinal.grade(nothing, rated).count() == 0
    even = ordinal.grade(awkward, rated.filter("false")).collect()
    assert all(abs(r.tail - 2 / 3) < 1e-9 and abs(r.expected_grade - 1) < 1e-9 for r in even)
