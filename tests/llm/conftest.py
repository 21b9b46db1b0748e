"""Awkward documents that every text operator has to take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 5003}x{i % 89}" for i in range(60_000))


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]); extra columns clash with operators' own names."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:
            for name in ("fp", "root", "node", "words", "size", "rank", "score", "block", "start", "n_words", "key"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture
def awkward(make_docs):
    """Nulls in any column, empty and very long texts, repeated rows, ties."""
    return make_docs([
        (1, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "en", None), (4, LONG, "en", "a"),
        (5, "One two three. Four five!", "en", "a"), (5, "One two three. Four five!", "en", "a"),
        (6, "One two three. Four five!", None, "a"), (7, "été où l'œuvre   naïve\n\nété", "fr", "b"),
        (None, "no identity here", "en", "a"), (8, "🙂 🙂 𝔘nicode <|endoftext|> x", "de", None),
        (9, "a\x0bb\x0cc\rd\te", "es", "a"), (10, "#" * 50, "en", "a")])


@pytest.fixture
def nothing(make_docs):
    return make_docs([(1, "x")]).filter("false")
