"""Cleaning rules, as-of matching of cancellations, and the audit of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwork.functions.columns import (
    invoice_prefix, is_cancellation, is_non_positive, is_product, is_standard_code,
    month_start, normal_code, ratio, starts_with_any, strip_text, sum_money,
)
from tillwork.operators.quantiles import exact_quantiles
from tillwork.params import BUSINESS_COLUMNS, PRODUCT_EXCEPTIONS
from tillwork.session import shared_folder

# Rules in the order they are applied; a row carries the first one it fails.
RULES = ("exact_duplicate", "annulled_sale", "cancellation", "non_positive", "non_product")
KEPT = "kept"
MATCH_KEYS = ("customer_id", "stock_code", "match_price", "match_quantity")
KEY_BITS = 1 << 28


def invoice_prefixes(raw: DataFrame) -> DataFrame:
    return (
        raw.groupBy(invoice_prefix(F.col("invoice")).alias("prefix"))
        .agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "prefix")
    )


def normalize_codes(raw: DataFrame) -> DataFrame:
    return raw.withColumn("stock_code", normal_code(F.col("stock_code")))


def code_normalization_audit(raw: DataFrame) -> DataFrame:
    code, stripped = F.col("stock_code"), strip_text(F.col("stock_code"))
    return raw.agg(
        F.count_if(code != stripped).alias("lines_with_spaces"),
        F.count_if(stripped != F.upper(stripped)).alias("lines_with_lower_case"),
        F.countDistinct(code).alias("codes_before"),
        F.countDistinct(normal_code(code)).alias("codes_after"),
    )


def drop_exact_duplicates(df: DataFrame, *derived: str) -> DataFrame:
    """Keep the first of identical rows, with the number of copies.

    A grouped minimum instead of a window: copies collapse on the map side, so a row
    repeated any number of times never gathers in one task. ``derived`` columns, which
    follow from the others, are kept too.
    """
    return df.groupBy(*BUSINESS_COLUMNS, *derived).agg(
        F.min("rid").alias("rid"), F.count("*").alias("copies"))


def _match_keys() -> dict[str, Column]:
    """What a cancellation and its sale share, by name."""
    quantity = F.col("quantity")
    return {
        "customer_id": F.col("customer_id"), "stock_code": F.col("stock_code"),
        # Equal prices have equal text. A floating key would be normalised anew by
        # every window and grouping, each with a shuffle of its own.
        "match_price": (F.col("price") + 0.0).cast("string"),
        "match_quantity": F.when(is_cancellation(F.col("invoice")), -quantity).otherwise(quantity)}


def with_named(df: DataFrame) -> DataFrame:
    """Add ``named``: whether a cancellation of a known customer may have the keys of the row.

    One bit per hash of a cancellation's keys, in at most ``KEY_BITS`` bits (32 MB), so the
    table of bits is broadcast whatever the input. True for every cancellation and every sale
    that one can reverse, and for the few rows whose hash meets a set bit by chance; the
    search decides. A checkpoint, so that the plans that use it stay short.
    """
    shared_folder(df.sparkSession)
    place = F.pmod(F.xxhash64(*_match_keys().values()), F.lit(KEY_BITS))
    cancels = df.where(F.col("customer_id").isNotNull() & is_cancellation(F.col("invoice")))
    bits = cancels.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")).checkpoint()
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    named = F.getbit(byte, (position % 8).cast("int")) == 1
    return (
        df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
        .withColumn("named", F.coalesce(named, F.lit(False))).drop("_bucket", "_bits"))


def annulled_sales(df: DataFrame, bucket: str = "day") -> DataFrame:
    """Row ids of sales that a later cancellation reverses.

    Every cancellation of a known customer takes the latest sale, not after it, of the
    same customer, code, price and opposite quantity; the largest row id wins a tie.

    One (key, instant) holds at most one answer, so rows are first reduced to that
    grain. The search then runs inside time buckets, and a second, much smaller search
    over the buckets serves cancellations whose sale lies in an earlier bucket. A key
    holding a third of all lines is thus spread over its buckets instead of one task.
    """
    cancel = is_cancellation(F.col("invoice"))
    # Null customers stay in as groups that can never match: filtering them out here
    # would give this branch another scan and shuffle than the de-duplicated rows have.
    known = F.col("customer_id").isNotNull()
    instants = (
        df.select(
            *[c.alias(name) for name, c in _match_keys().items()], "invoice_ts",
            F.when(known & ~cancel, F.col("rid")).alias("sale"),
            (known & cancel).alias("cancels"))
        .withColumn("bucket", F.date_trunc(bucket, "invoice_ts"))
        .groupBy(*MATCH_KEYS, "bucket", "invoice_ts")
        .agg(F.max("sale").alias("sale"), F.max("cancels").alias("cancels"))
    )
    in_bucket = W.partitionBy(*MATCH_KEYS, "bucket").orderBy("invoice_ts").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    searched = instants.withColumn("found", F.last("sale", ignorenulls=True).over(in_bucket))

    before = W.partitionBy(*MATCH_KEYS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # The sales found inside a bucket are handed on beside its last sale, so that the instants
    # are read once; they are distinct instants of one key and bucket.
    inside = F.col("cancels") & F.col("found").isNotNull()
    return (
        searched.groupBy(*MATCH_KEYS, "bucket")
        .agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("invoice_ts"))).alias("last_sale"),
             F.max(F.col("cancels") & F.col("found").isNull()).alias("searching"),
             F.collect_set(F.when(inside, F.col("found"))).alias("found_inside"))
        .withColumn("earlier", F.last("last_sale", ignorenulls=True).over(before))
        .select(F.explode(F.array_compact(F.concat(
            "found_inside", F.array(F.when(F.col("searching"), F.col("earlier")))))).alias("rid"))
        .distinct()
    )


def first_failed_rule(annulled: Column) -> Column:
    return (
        F.when(annulled, "annulled_sale")
        .when(is_cancellation(F.col("invoice")), "cancellation")
        .when(is_non_positive(F.col("quantity"), F.col("price")), "non_positive")
        .when(~is_product(F.col("stock_code")), "non_product")
        .otherwise(KEPT)
    )


def audit_sales(raw: DataFrame) -> DataFrame:
    """De-duplicated rows with the first rule each one fails, or ``kept``.

    One plan instead of one pass per rule; every count and every rejected row can be
    read back from the result.
    """
    rows = drop_exact_duplicates(with_named(normalize_codes(raw)), "named")
    # The number of copies is always positive; it keeps the condition above the grouping, so
    # that all three uses of the rows share one shuffle instead of de-duplicating anew.
    named = F.when(F.col("copies") > 0, F.col("named"))
    # Only rows that some cancellation may reverse are searched and joined.
    candidates = rows.where(named)
    annulled = annulled_sales(candidates).withColumn("annulled", F.lit(True))
    judged = candidates.join(annulled, "rid", "left").withColumn("annulled", F.coalesce("annulled", F.lit(False)))
    others = rows.where(~named).withColumn("annulled", F.lit(False))
    return (
        judged.unionByName(others)
        .withColumn("rule", first_failed_rule(F.col("annulled")))
        .drop("annulled", "named")
        .withColumn("sales_month", month_start(F.col("invoice_ts")))
    )


def clean_sales(audited: DataFrame) -> DataFrame:
    """Kept rows, description trimmed only now, with the revenue of the line."""
    return (
        audited.where(F.col("rule") == KEPT)
        .withColumn("description", strip_text(F.col("description")))
        .withColumn("revenue", F.col("quantity") * F.col("price"))
        .select("rid", *BUSINESS_COLUMNS, "revenue", "sales_month")
    )


def cleaning_ledger(audited: DataFrame) -> DataFrame:
    """Rows in, rows rejected by each rule, rows out, share rejected; one grouped pass."""
    counts = {r: F.count_if(F.col("rule") == r) for r in RULES[1:]}
    counts["exact_duplicate"] = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    one = audited.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_in"),
        *[counts[r].alias(r) for r in RULES],
        F.count_if(F.col("rule") == KEPT).alias("rows_out"))
    steps = ("rows_in", *RULES, "rows_out")
    line = lambda i, s: F.struct(
        F.lit(i).alias("step"), F.lit(s).alias("rule"), F.col(s).cast("bigint").alias("rows"))
    return (
        one.select("rows_in", F.explode(F.array(*[line(i, s) for i, s in enumerate(steps)])).alias("x"))
        .select("x.*", (ratio(F.col("x.rows"), F.col("rows_in")) * 100).alias("pct_of_input"))
        .orderBy("step")
    )


def code_audit(audited: DataFrame) -> DataFrame:
    """Codes outside the product pattern that reach the last rule, and their fate."""
    odd = audited.where(F.col("rule").isin(KEPT, "non_product")
                        & ~is_standard_code(F.col("stock_code")))
    lines = odd.groupBy("stock_code").agg(
        F.count("*").alias("lines"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("rid"))).alias("description"))
    medians = exact_quantiles(odd, ["price"], [0.5], by=["stock_code"]).select(
        "stock_code", F.col("value").alias("median_price"))
    return (
        lines.join(medians, "stock_code", "left")
        .withColumn("decision", F.when(
            starts_with_any(F.col("stock_code"), PRODUCT_EXCEPTIONS), "keep").otherwise("drop"))
        .orderBy(F.desc("lines"), "stock_code")
    )


def annulled_summary(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("rule") == "annulled_sale").agg(
        F.count("*").alias("lines"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
        F.coalesce(sum_money(F.col("quantity") * F.col("price")), F.lit(0.0)).alias("revenue"))


def annulled_top(audited: DataFrame, n: int = 5) -> DataFrame:
    return (
        audited.where(F.col("rule") == "annulled_sale")
        .orderBy(F.desc("quantity"), "rid").limit(n)
        .select("invoice", "stock_code", "description", "quantity", "invoice_ts", "customer_id")
    )


def sales_headline(clean: DataFrame) -> DataFrame:
    return clean.agg(
        F.countDistinct("invoice").alias("invoices"),
        F.countDistinct("stock_code").alias("products"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("country").alias("countries"),
        (F.avg(F.col("customer_id").isNull().cast("int")) * 100).alias("pct_without_customer"),
        sum_money(F.col("revenue")).alias("revenue"))
