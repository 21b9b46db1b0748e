"""The stages against plain versions of what they decide, and the queries that have SQL against DuckDB."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from test_packing import PATH, brute
from test_simhash import near_texts, plain_classes, plain_fingerprint
from test_substrings import plain as plain_repeats

import __spark_entry__ as entry_point
import corpus_pipeline
from tillwork.llm import mixing, queries


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def corpus():
    """Near copies, a passage that several documents hold, rows without letters, nulls."""
    rnd = random.Random(11)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, t, "en", f"s{i % 3}") for i, t in near_texts(25, 9).items()]
    fresh = lambda n: " ".join(f"{rnd.choice('abcdef')}w{rnd.randrange(4000)}" for _ in range(n))
    rows += [(500 + i, f"{fresh(40)}\n{passage}\n{fresh(30)}", "fr", None if i % 2 else "s9") for i in range(8)]
    rows += [(600, passage, "en", "s9"), (601, "1234 !!", "en", "s0"), (602, None, "en", "s0"), (603, "", None, None)]
    return rows


def test_each_stage_does_what_it_says(spark, make_docs, library, tmp_path):
    docs, rows = make_docs(corpus(), extra=False), {r[0]: r for r in corpus()}
    kept, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = steps[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packed_sequences":
            assert kept.dtypes == docs.dtypes
    language = {r.doc_id: r for r in steps["language"].collect()}
    assert set(language) == set(rows) - {601, 602, 603}
    classes = plain_classes({i: plain_fingerprint(r.text) for i, r in language.items()})
    alone = {r.doc_id: r.text for r in steps["near_duplicates"].collect()}
    assert set(alone) == set(classes.values()) and len(alone) < len(language)
    assert all(alone[i] == rows[i][1] for i in alone)
    expected = {i: (n, gone, sha) for i, n, gone, sha in plain_repeats(list(alone.items()))}
    left = {r.doc_id: r for r in steps["repeated_passages"].collect()}
    assert set(left) == {i for i, (n, gone, _) in expected.items() if gone < n}
    assert 600 not in left and sum("shared1 " in r.text for r in left.values()) == 1
    for i, r in left.items():
        assert len(r.text.split()) == expected[i][0] - expected[i][1] and r.n_chars == len(r.text)
    mixed = [(r.doc_id, r.text) for r in steps["source_mix"].collect()]
    copies = {r.doc_id: r.copies for r in mixing.mix(steps["repeated_passages"]).collect()}
    assert Counter(i for i, _ in mixed) == Counter({i: c for i, c in copies.items() if c})
    pieces = steps["packed_sequences"].collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == brute(library, mixed, 4096)


def test_run_writes_all_stages(spark, make_docs, tmp_path):
    make_docs(corpus(), extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 4096


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_result_in_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, sf_dir)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def test_all_operators_are_registered():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in entry_point.queries() and set(queries.ORACLES) <= set(entry_point.oracle_sql())


def test_stages_take_odd_columns_and_ids(spark, make_docs):
    """Clashing, spaced and dotted columns; repeated rows; one id with two texts; no id; no rows."""
    long = " ".join(f"word{i % 4001}x{i % 83}" for i in range(30_000))
    one, two = "the first text speaks of ships and harbours at sea.", "quite another one tells how bread is baked by hand."
    rows = corpus() + [(700, one, "en", "s0"), (700, two, "en", "s0"), (701, two + " Also late.", "en", "s1"), (701, two + " Also late.", "en", "s1"),
                       (None, one + " It has no id.", "en", "s0"), (702, long, "en", None)]
    docs = make_docs(rows).selectExpr("*", "1 AS `my col`", "2 AS `a.b`", "array(3) AS __m")
    alone = corpus_pipeline.near_duplicates(spark, docs, "")
    assert alone.filter("doc_id = 700").count() == 2 and alone.filter("doc_id = 701").count() == 1
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        kept = stage(spark, kept, "")
        if name != "packed_sequences":
            assert kept.dtypes == docs.dtypes
    assert kept.count() > 0
    nothing = docs.filter("false")
    assert all(stage(spark, nothing, "").count() == 0 for _, stage in corpus_pipeline.STAGES)
