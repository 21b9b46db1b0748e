import pytest

from pyspark.sql import functions as F

from tillwork.params import Params
from tillwork.plans.reports import write_reports
from tillwork.plans.stages import from_exports
from tillwork.sources import load, parts
from tillwork.sources.sinks import write_table

CSV = """Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country
489434,85048,15CM BALL,12,2009-12-01 07:45:00,6.95,13085,Here
C489449,22087,"PAPER, SET",-12,2010-12-01 10:33:00,2.95,,There
489450,85123A,,6,2010-12-02 10:33:00,2.55,17850,Here
"""


@pytest.fixture
def files(tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_text(CSV)
    body = CSV.splitlines()
    new.write_text("\n".join([body[0], *body[2:], "489451,85123A,HEART,6,2011-01-02 10:33:00,2.55,17850,Here"]) + "\n")
    return {"old": str(old), "new": str(new)}


def loaded(spark, path, number=0, **kw):
    """The whole way of a part: scan, check, write, number."""
    import tempfile
    folder = tempfile.mkdtemp()
    load.checked(load.scan_export(spark, str(path)), **kw).write.mode("overwrite").parquet(folder)
    return load.with_delivery_ids(spark.read.parquet(folder), number)


def test_scan_keeps_ids_as_text(spark, files):
    rows = loaded(spark, files["old"]).orderBy("rid").collect()
    assert [r.invoice for r in rows] == ["489434", "C489449", "489450"] and [r.rid for r in rows] == [0, 1, 2]
    assert [r.customer_id for r in rows] == [13085, None, 17850]
    assert rows[1].description == "PAPER, SET" and rows[2].description is None
    assert dict(loaded(spark, files["old"]).dtypes)["invoice_ts"] == "timestamp_ntz"


HARD = """Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country
1,A,"SET OF ""6"", RED",1,2009-12-01 07:45:00,1.0,13085.0,Here
2,A,x,1 000,2009-12-01 07:45:00,1.0,,Here
3,A,x,1,31.31.2009,1.0,,Here
4,A,x,1,,1.0,,Here
5,A,x,,2009-12-01 07:45:00,1.0,,Here
6,A,x,1,2009-12-01 07:45:00,free,13x,Here
7,A,x,1,2009-12-01 07:45:00,1.0
8,A,x,1,2009-12-01T07:45:00,1e0,7,"Here, there"
9,A,x,1,2009-12-01 07:45:00,NaN,,Here
"""


def test_every_delivered_row_is_accounted_for(spark, tmp_path):
    (tmp_path / "hard.csv").write_text(HARD)
    rows = {r.invoice: r for r in loaded(spark, tmp_path / "hard.csv").collect()}
    assert len(rows) == 9
    assert {i for i, r in rows.items() if r.reject_reason is None} == {"1", "8"}
    assert rows["1"].description == 'SET OF "6", RED' and rows["1"].customer_id == 13085
    assert rows["8"].country == "Here, there" and rows["8"].price == 1.0
    assert rows["2"].reject_reason == "unreadable quantity" and "1 000" in rows["2"].delivered
    assert rows["3"].reject_reason == "unreadable invoice_ts" and rows["4"].reject_reason == "missing invoice_ts"
    assert rows["5"].reject_reason == "missing quantity"
    assert rows["6"].reject_reason == "unreadable price, unreadable customer_id"
    assert "broken line" in rows["7"].reject_reason and rows["9"].reject_reason == "unreadable price"


def test_other_time_formats(spark, tmp_path):
    (tmp_path / "us.csv").write_text(HARD.splitlines()[0] + "\n1,A,x,1,12/1/2009 8:26,1.0,,Here\n")
    assert loaded(spark, tmp_path / "us.csv").first().reject_reason == "unreadable invoice_ts"
    row = loaded(spark, tmp_path / "us.csv", formats=("M/d/yyyy H:mm",)).first()
    assert str(row.invoice_ts) == "2009-12-01 08:26:00" and row.reject_reason is None


def test_another_header_stops_the_scan(spark, tmp_path):
    (tmp_path / "odd.csv").write_text(HARD.replace("Quantity,InvoiceDate", "InvoiceDate,Quantity"))
    with pytest.raises(Exception, match="(?i)header"):
        loaded(spark, tmp_path / "odd.csv").count()


def test_ids_follow_path_and_row(spark, tmp_path):
    """Files of different sizes and with equal names, as CSV."""
    line = "{i},A,x,1,2009-12-01 07:45:00,1.0,,Here"
    for folder, name, first, n in (("a", "x.csv", 0, 3), ("b", "x.csv", 3, 400), ("c", "y.csv", 403, 20)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        body = "\n".join(line.format(i=i) for i in range(first, first + n))
        (tmp_path / "in" / folder / name).write_text(HARD.splitlines()[0] + "\n" + body + "\n")
    rows = loaded(spark, tmp_path / "in" / "*", number=2).collect()
    assert sorted((r.rid - (2 << 56), int(r.invoice)) for r in rows) == [(i, i) for i in range(423)]


def test_reconciliation(spark, tmp_path):
    body = HARD.splitlines()
    (tmp_path / "1.csv").write_text(HARD)
    (tmp_path / "2.csv").write_text("\n".join([body[0], body[8], body[4], body[8].replace("2009", "2010")]) + "\n")
    found = {"old": loaded(spark, tmp_path / "1.csv"), "new": loaded(spark, tmp_path / "2.csv", 1)}
    got = {r.part: (r.delivered, r.rejected, r.overlap, r.loaded) for r in load.reconciliation(found).collect()}
    assert got == {"old": (9, 7, 2, 0), "new": (3, 1, 0, 2)}
    good = {n: load.good_rows(df) for n, df in found.items()}
    load.assert_nothing_lost(*good.values(), parts.union_parts(*good.values()))
    with pytest.raises(ValueError, match="would be loaded"):
        load.assert_nothing_lost(*good.values(), good["new"].limit(1))


def test_rows_without_a_time_stay(sales):
    first, second = _lines(sales, 1, 2), _lines(sales, 3)
    timeless = first.withColumn("invoice_ts", F.when(F.col("quantity") == 1, F.col("invoice_ts")))
    assert parts.union_parts(timeless, second).count() == 2  # one cut as overlap, the timeless one kept


def test_profile_and_union(spark, files):
    found = {n: load.good_rows(loaded(spark, path)) for n, path in files.items()}
    assert {r.part: r.rows for r in parts.part_profile(found).collect()} == {"old": 3, "new": 3}
    report = parts.overlap_report(*found.values()).first()
    assert (report.rows_first, report.rows_second, report.identical_rows) == (2, 2, 2)  # null equals null
    assert str(report.range_start) == "2010-12-01 10:33:00" and str(report.range_end) == "2010-12-02 10:33:00"
    parts.assert_overlap_identical(*found.values())
    assert parts.union_parts(*found.values()).count() == 4


def _lines(sales, *quantities):
    return sales(*[(i, "1", "10000", q, "2000-01-01T10:00", 1.0, None) for i, q in enumerate(quantities)]).drop("rid")


def test_overlap_is_compared_as_a_multiset(sales):
    first, second = _lines(sales, 1, 1, 2), _lines(sales, 1, 2, 3)
    report = parts.overlap_report(first, second).first()
    # All three rows of the first part exist in the second, and yet the parts differ.
    assert (report.identical_rows, report.only_first, report.only_second) == (3, 1, 1)
    with pytest.raises(ValueError, match="differ"):
        parts.assert_overlap_identical(first, second)


def test_missing_overlap_row_stops_the_load(sales):
    with pytest.raises(ValueError):
        parts.assert_overlap_identical(_lines(sales, 1), _lines(sales, 1, 2))


def test_file_order_follows_path_and_row(spark, tmp_path):
    """Large files before small ones, equal names in two folders."""
    import shutil
    for name, start, n in (("b", 100, 900), ("a", 0, 50)):
        spark.range(start, start + n, 1, 1).write.parquet(str(tmp_path / "w" / name))
        (tmp_path / "in" / name).mkdir(parents=True)
        shutil.copy(next((tmp_path / "w" / name).glob("*.parquet")), tmp_path / "in" / name / "x.parquet")
    numbered = parts.with_file_order(spark.read.parquet(str(tmp_path / "in" / "*"))).orderBy("rid").collect()
    assert [r.id for r in numbered] == [*range(50), *range(100, 1000)]


def test_whole_run_from_exports(spark, files, tmp_path):
    s = from_exports(spark, files, Params("Here", (2010, 2011), "2011-12-01", "2011-01-01"),
                     folder=str(tmp_path / "tables"))
    write_reports(s, str(tmp_path / "reports"), ["ingest", "cleaning"])
    ledger = {r.rule: r.rows for r in spark.read.json(str(tmp_path / "reports/cleaning/cleaning_ledger")).collect()}
    assert ledger["rows_in"] == 4 and ledger["cancellation"] == 1 and ledger["rows_out"] == 3
    assert spark.read.parquet(f"{s.folder}/audited").count() == 4


def test_file_order_sends_no_rows_by_file(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = parts.with_file_order(df)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # rows of a file never gather in one task
    assert numbered.select("rid").distinct().count() == 40


def test_tables_are_written_without_moving_rows(spark, tmp_path):
    """Each file holds rows of one task, in the order of the cluster columns."""
    df = spark.range(0, 4000, 1, 4).select(
        "id", (F.col("id") % 2).alias("kind"), (F.col("id") * 7 % 100).alias("month"), F.spark_partition_id().alias("task"))
    write_table(df, str(tmp_path / "t"), ["kind"], ["month"])
    rows = spark.read.parquet(str(tmp_path / "t")).withColumns(
        {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    tasks = rows.groupBy("file").agg(F.countDistinct("task").alias("n"), F.array_agg("row"))
    assert {r.n for r in tasks.collect()} == {1}
    for file in {r.file for r in rows.select("file").collect()}:
        months = [r.month for r in rows.where(F.col("file") == file).orderBy("row").collect()]
        assert months == sorted(months)


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import time

    from tillwork.session import shuffles_released

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    counted = lambda n: spark.range(n).groupBy((F.col("id") % 7).alias("k")).count()
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(conf, None)
    write_table(counted(1000), f"{tmp_path}/counted")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.read.parquet(f"{tmp_path}/counted").agg(F.sum("count")).first()[0] == 1000
    with shuffles_released(spark):
        write_table(counted(10), f"{tmp_path}/few")
        assert spark.conf.get(conf) == "true"  # of writes side by side the last one to end restores the setting
    assert spark.conf.get(conf, None) == setting
