import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwork.operators import clean
from tillwork.params import BUSINESS_COLUMNS


def annulled(df, **kw):
    return sorted(r.rid for r in clean.annulled_sales(df, **kw).collect())


def brute_force(rows):
    """Every pair, then the latest earlier sale per cancellation, largest rid on ties."""
    out = set()
    for c in rows:
        if not c[1].startswith("C") or c[6] is None:
            continue
        fits = [s for s in rows if not s[1].startswith("C") and (s[6], s[2], s[5]) == (c[6], c[2], c[5])
                and s[3] == -c[3] and s[4] <= c[4]]
        if fits:
            out.add(max(fits, key=lambda s: (s[4], s[0]))[0])
    return sorted(out)


CASES = {
    "simple": ([(1, "1", "10000", 5, "2000-01-01T10:00", 2.0, 7), (2, "C2", "10000", -5, "2000-01-03T10:00", 2.0, 7)], [1]),
    "two cancellations of one sale": (
        [(1, "1", "10000", 5, "2000-01-01T09:00", 2.0, 7), (2, "2", "10000", 5, "2000-01-02T09:00", 2.0, 7),
         (3, "C3", "10000", -5, "2000-01-03T09:00", 2.0, 7), (4, "C4", "10000", -5, "2000-01-04T09:00", 2.0, 7)], [2]),
    "same instant counts": ([(1, "1", "10000", 5, "2000-01-01T10:00", 2.0, 7), (2, "C2", "10000", -5, "2000-01-01T10:00", 2.0, 7)], [1]),
    "tie goes to the largest row id": (
        [(1, "1", "10000", 5, "2000-01-01T10:00", 2.0, 7), (2, "2", "10000", 5, "2000-01-01T10:00", 2.0, 7),
         (3, "C3", "10000", -5, "2000-01-01T12:00", 2.0, 7)], [2]),
    "cancellation before the sale": ([(1, "1", "10000", 5, "2000-01-05T10:00", 2.0, 7), (2, "C2", "10000", -5, "2000-01-03T10:00", 2.0, 7)], []),
    "unknown customer": ([(1, "1", "10000", 5, "2000-01-01T10:00", 2.0, None), (2, "C2", "10000", -5, "2000-01-03T10:00", 2.0, None)], []),
    "other quantity": ([(1, "1", "10000", 5, "2000-01-01T10:00", 2.0, 7), (2, "C2", "10000", -4, "2000-01-03T10:00", 2.0, 7)], []),
    "negative line without C": ([(1, "1", "10000", -5, "2000-01-01T10:00", 2.0, 7), (2, "C2", "10000", -5, "2000-01-03T10:00", 2.0, 7)], []),
    "other price": ([(1, "1", "10000", 5, "2000-01-01T10:00", 2.0, 7), (2, "C2", "10000", -5, "2000-01-03T10:00", 2.01, 7)], []),
    "sale many buckets before": (
        [(1, "1", "10000", 5, "1999-01-01T10:00", 2.0, 7), (2, "2", "10000", 5, "1999-03-01T10:00", 2.0, 7),
         (3, "C3", "10000", -5, "2000-01-03T10:00", 2.0, 7), (4, "4", "10000", 5, "2000-01-03T11:00", 2.0, 7)], [2]),
}


@pytest.mark.parametrize("name", CASES)
def test_annulled_cases(sales, name):
    rows, expected = CASES[name]
    assert annulled(sales(*rows)) == expected


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_annulled_random_with_hot_key(sales, bucket):
    rng = random.Random(3)
    start, rows = datetime(2000, 1, 1), []
    for rid in range(700):
        cancel = rng.random() < 0.3
        hot = rng.random() < 0.4  # one customer, code, price and quantity holds much of the table
        quantity = 1 if hot else rng.choice([1, 2])
        rows.append((rid, ("C" if cancel else "") + str(rid), "10000" if hot else rng.choice(["10000", "10001"]),
                     -quantity if cancel else quantity,
                     (start + timedelta(hours=rng.randrange(24 * 40))).isoformat(),
                     2.0 if hot else rng.choice([2.0, 2.5]), 1 if hot else rng.choice([1, 2, None])))
    assert annulled(sales(*rows), bucket=bucket) == brute_force(rows)


def test_duplicates_keep_the_first(sales):
    line = ("1", "10000", 5, "2000-01-01T10:00", 2.0, None)
    df = sales((3, *line), (1, *line), (2, *line), (4, "1", "10000", 6, "2000-01-01T10:00", 2.0, None))
    kept = {r.rid: r.copies for r in clean.drop_exact_duplicates(df).collect()}
    assert kept == {1: 3, 4: 1}


def test_rules_apply_in_order(sales):
    df = sales(
        (1, "1", " 10000a ", 5, "2000-01-01T10:00", 2.0, 7),
        (2, "1", "10000A", 5, "2000-01-01T10:00", 2.0, 7),       # duplicate once the code is normal
        (3, "C2", "POST", -1, "2000-01-01T10:00", 0.0, 7),       # cancellation before anything else
        (4, "3", "POST", 1, "2000-01-01T10:00", 0.0, 8),         # price before code
        (5, "4", "POST", 1, "2000-01-01T10:00", 1.0, 7),
        (6, "5", "DCGS0058", 1, "2000-01-01T10:00", 1.0, 7),
        (7, "6", "10000AB", 1, "2000-01-01T10:00", 1.0, 7, "  name  "))
    audited = clean.audit_sales(df)
    assert {r.rid: r.rule for r in audited.collect()} == {
        1: "kept", 3: "cancellation", 4: "non_positive", 5: "non_product", 6: "kept", 7: "kept"}
    ledger = {r.rule: r.rows for r in clean.cleaning_ledger(audited).collect()}
    assert ledger == {"rows_in": 7, "exact_duplicate": 1, "annulled_sale": 0, "cancellation": 1,
                      "non_positive": 1, "non_product": 1, "rows_out": 3}
    assert clean.clean_sales(audited).where("rid = 7").first().description == "name"


def test_cleaning_is_stable(tables):
    """Row order does not matter, and clean rows stay clean."""
    raw = tables.raw()
    ledger = lambda df: [tuple(r) for r in clean.cleaning_ledger(clean.audit_sales(df)).collect()]
    assert ledger(raw) == ledger(raw.orderBy(F.rand(5)).repartition(5))
    again = {r.rule: r.rows for r in clean.cleaning_ledger(
        clean.audit_sales(tables.clean().select("rid", *BUSINESS_COLUMNS))).collect()}
    # Trimming descriptions may make two lines equal; no other rule may fire.
    assert again["rows_in"] - again["exact_duplicate"] == again["rows_out"]


def test_code_audit(sales):
    df = sales(
        (1, "1", "POST", 1, "2000-01-01T10:00", 4.0, 7, None), (2, "2", "POST", 1, "2000-01-01T10:00", 1.0, 7, "b"),
        (3, "3", "POST", 1, "2000-01-01T10:00", 2.0, 7, "a"), (4, "4", "SP1002", 1, "2000-01-01T10:00", 2.0, 7, "x"))
    rows = [tuple(r) for r in clean.code_audit(clean.audit_sales(df)).collect()]
    assert rows == [("POST", 3, "b", 2.0, "drop"), ("SP1002", 1, "x", 2.0, "keep")]


def test_prefixes(sales):
    df = sales(*[(i, inv, "10000", 1, "2000-01-01T10:00", 1.0, 1) for i, inv in enumerate(["1", "2", "C3", "A4"])])
    assert {r.prefix: r.lines for r in clean.invoice_prefixes(df).collect()} == {"(numeric)": 2, "C": 1, "A": 1}


def test_shuffles_are_shared(tables):
    """De-duplication is shuffled once, and nothing is compared pair by pair."""
    df = clean.audit_sales(tables.raw())
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 2 and plan.count("FileScan") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_large_quantities_and_fractional_prices(sales):
    df = sales((1, "1", "10000", 80995, "2000-01-01T10:00", 2.08, 7), (2, "2", "10000", 3, "2000-01-01T10:00", 0.001, 7))
    head = clean.sales_headline(clean.clean_sales(clean.audit_sales(df))).first()
    assert head.revenue == pytest.approx(80995 * 2.08 + 0.003, abs=1e-9)
    assert pd.notna(head.invoices)


def test_rows_are_judged_as_by_brute_force(sales):
    """Only rows that a cancellation names are searched; nulls in keys and copies change nothing."""
    rng = random.Random(8)
    start, rows = datetime(2000, 1, 1), []
    for rid in range(600):
        cancel = rng.random() < 0.2
        quantity, price = rng.choice([1, 2]), rng.choice([0.0, -0.0, 2.0, None])
        rows.append((rid, ("C" if cancel else "") + str(rid), rng.choice(["10000", None]), -quantity if cancel else quantity,
                     (start + timedelta(hours=rng.randrange(24 * 20))).isoformat(), price, rng.choice([1, 2, 3, None])))
    copies = [(1000 + r[0], *r[1:]) for r in rows[::7]]
    audited = clean.audit_sales(sales(*rows, *copies))
    assert sorted(r.rid for r in audited.where("rule = 'annulled_sale'").collect()) == brute_force(rows)
    assert audited.count() == len(rows)


def test_few_rows_are_searched(sales):
    """Rows whose keys no cancellation has are neither searched nor joined by row id."""
    lines = [(i, str(i), f"{10000 + i}", 1, "2000-01-01T10:00", 2.0, 7) for i in range(500)]
    cancels = [(900 + i, f"C{i}", f"{10000 + i}", -1, "2000-01-02T10:00", 2.0, 7) for i in range(5)]
    unknown = [(950, "C950", "10300", -1, "2000-01-02T10:00", 2.0, None)]
    named = {r.rid for r in clean.with_named(sales(*lines, *cancels, *unknown)).where("named").collect()}
    assert named == {*range(5), *range(900, 905)}
