"""DuckDB SQL for the same results, written independently of the Spark plans.

The oracles favour the plainest statement of a result (self-joins, row_number, global
windows) over speed; they run on small tables only.
"""

from __future__ import annotations

_RAW = """
li AS (SELECT *, row_number() OVER () - 1 AS line_no FROM lineitem),
base AS (
  SELECT line_no, l_orderkey AS okey, (l_orderkey*7 + l_linenumber*13 + l_partkey) % 100 AS k,
         l_returnflag AS rf, CAST(l_quantity AS BIGINT) AS qty, p_retailprice AS price, p_name AS descr,
         concat(lpad(CAST(p_partkey AS VARCHAR), 5, '0'),
                CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END) AS code,
         o_orderdate + INTERVAL '1' HOUR * CAST(8 + l_orderkey % 10 AS INT) AS ts,
         CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust, n_name AS country
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
          JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sale AS (
  SELECT kind, line_no*10 + kind AS rid, k, okey,
         CASE WHEN k IN (0,1,2) THEN lower(code) WHEN k = 3 THEN concat(code, ' ') WHEN k = 4 THEN 'POST'
              WHEN k = 5 THEN 'DCGS0058' ELSE code END AS stock_code,
         CASE WHEN k = 9 THEN NULL WHEN k = 10 THEN concat(descr, ' ') ELSE descr END AS description,
         CASE WHEN k = 7 THEN -qty ELSE qty END AS qty, ts,
         CASE WHEN k = 6 THEN 0.0E0 ELSE price END AS price, cust AS customer_id, country
  FROM base CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2) kinds
  WHERE kind = 0 OR (kind = 1 AND k = 8) OR (kind = 2 AND rf = 'R' AND k % 4 = 0 AND k <> 8)),
raw AS MATERIALIZED (
  SELECT rid, CASE WHEN kind = 2 THEN concat('C', CAST(okey AS VARCHAR)) ELSE CAST(okey AS VARCHAR) END AS invoice,
         stock_code, description, CASE WHEN kind = 2 THEN -qty ELSE qty END AS quantity,
         CASE WHEN kind <> 2 THEN ts
              ELSE ts + INTERVAL '1' DAY * CAST(CASE WHEN k % 8 = 4 THEN -3 ELSE 3 END AS INT) END AS invoice_ts,
         price, customer_id, country
  FROM sale)"""

_BUSINESS = "invoice, stock_code, description, quantity, invoice_ts, price, customer_id, country"

_AUDIT = _RAW + f""",
norm AS (SELECT * REPLACE (upper(trim(stock_code)) AS stock_code) FROM raw),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {_BUSINESS} ORDER BY rid) AS copy_no,
                    count(*) OVER (PARTITION BY {_BUSINESS}) AS copies FROM norm),
dedup AS MATERIALIZED (SELECT * EXCLUDE (copy_no) FROM numbered WHERE copy_no = 1),
candidates AS (
  SELECT s.rid AS sale_rid,
         row_number() OVER (PARTITION BY c.rid ORDER BY s.invoice_ts DESC, s.rid DESC) AS choice
  FROM dedup c JOIN dedup s ON c.customer_id = s.customer_id AND c.stock_code = s.stock_code
       AND c.price = s.price AND s.quantity = -c.quantity AND s.invoice_ts <= c.invoice_ts
  WHERE c.invoice LIKE 'C%' AND s.invoice NOT LIKE 'C%'),
annulled AS (SELECT DISTINCT sale_rid FROM candidates WHERE choice = 1),
audited AS MATERIALIZED (
  SELECT dedup.*, CASE WHEN sale_rid IS NOT NULL THEN 'annulled_sale' WHEN invoice LIKE 'C%' THEN 'cancellation'
         WHEN quantity <= 0 OR price <= 0 THEN 'non_positive'
         WHEN NOT regexp_matches(stock_code, '^[0-9]{{5}}[A-Z]*$') AND stock_code NOT LIKE 'DCGS%'
              AND stock_code NOT LIKE 'SP1002%' THEN 'non_product' ELSE 'kept' END AS rule
  FROM dedup LEFT JOIN annulled ON rid = sale_rid)"""

_CLEAN = _AUDIT + """,
clean AS MATERIALIZED (
  SELECT rid, invoice, stock_code, trim(description) AS description, quantity, invoice_ts, price, customer_id,
         country, quantity * price AS revenue, CAST(round(quantity * price * 10000) AS BIGINT) AS units10k
  FROM audited WHERE rule = 'kept')"""


def _money(expr: str = "units10k") -> str:
    return f"CAST(sum({expr}) AS DOUBLE) / 10000.0"


_PRODUCTS = _CLEAN + f""",
spelled AS (SELECT stock_code, description, count(*) AS n FROM clean WHERE description IS NOT NULL GROUP BY ALL),
named AS (SELECT stock_code, description AS product FROM (
  SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY n DESC, description) AS r FROM spelled) WHERE r = 1),
product_sums AS (
  SELECT stock_code, count(DISTINCT description) AS descriptions, count(*) AS lines,
         CAST(sum(quantity) AS BIGINT) AS units, {_money()} AS revenue FROM clean GROUP BY stock_code),
products AS MATERIALIZED (
  SELECT stock_code, product, descriptions, lines, units, revenue FROM product_sums LEFT JOIN named USING (stock_code))"""

_CUSTOMERS = _CLEAN + f""",
ref AS (SELECT date_trunc('day', max(invoice_ts)) + INTERVAL '1' DAY AS ref_ts FROM clean WHERE customer_id IS NOT NULL),
features AS (
  SELECT customer_id, {_money()} AS revenue, CAST(sum(quantity) AS BIGINT) AS units,
         count(DISTINCT invoice) AS frequency, count(*) AS lines, min(invoice_ts) AS first_ts,
         max(invoice_ts) AS last_ts, count(DISTINCT stock_code) AS distinct_products,
         arg_min(country, rid) AS country
  FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id),
threshold AS (SELECT quantile_cont(revenue, 0.8) AS threshold FROM features),
customers AS MATERIALIZED (
  SELECT features.*, datesub('day', last_ts, ref_ts) AS recency, datesub('day', first_ts, ref_ts) AS tenure,
         lines / CAST(frequency AS DOUBLE) AS lines_per_invoice,
         CAST(country = 'NATION_0' AS INTEGER) AS is_home, CAST(revenue >= threshold AS INTEGER) AS premium
  FROM features, ref, threshold),
grouped AS MATERIALIZED (SELECT *, CAST(least(3, floor(recency / 100.0)) AS INTEGER) AS segment FROM customers)"""

_POINTS = _CUSTOMERS + """,
logs AS (SELECT *, ln(1 + recency) AS lr, ln(1 + frequency) AS lf, ln(1 + revenue) AS lm FROM grouped),
points AS MATERIALIZED (
  SELECT customer_id, segment, (lr - avg(lr) OVER ()) / stddev_pop(lr) OVER () AS a,
         (lf - avg(lf) OVER ()) / stddev_pop(lf) OVER () AS b,
         (lm - avg(lm) OVER ()) / stddev_pop(lm) OVER () AS c FROM logs),
pairs AS (SELECT p.customer_id AS id, p.segment AS own, o.customer_id AS other, o.segment AS theirs,
                 sqrt((p.a-o.a)*(p.a-o.a) + (p.b-o.b)*(p.b-o.b) + (p.c-o.c)*(p.c-o.c)) AS dist
          FROM points p CROSS JOIN points o)"""

_DAILY = _CLEAN + f""",
all_days AS (SELECT CAST(invoice_ts AS DATE) AS "day", {_money()} AS revenue FROM clean GROUP BY 1),
daily AS MATERIALIZED (
  SELECT "day", revenue, CAST(isodow("day") - 1 AS INTEGER) AS weekday, CAST(month("day") AS INTEGER) AS "month",
         CAST(weekofyear("day") AS INTEGER) AS iso_week, CAST(day("day") AS INTEGER) AS month_day
  FROM all_days WHERE "day" < (SELECT max("day") FROM all_days))"""

_NAIVE = _DAILY + """,
mean AS (SELECT CAST(sum(CAST(round(revenue * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0 AS train_mean
         FROM daily WHERE "day" < DATE '2001-01-01'),
naive AS MATERIALIZED (
  SELECT t."day", t.revenue, coalesce(l.revenue, train_mean) AS prediction, l.revenue IS NOT NULL AS has_lag
  FROM daily t LEFT JOIN daily l ON t."day" = l."day" + 364, mean WHERE t."day" >= DATE '2001-01-01')"""

_PERCENTILES = {"p01": .01, "p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99}


def _describe(base: str, source: str, cols: list[str], probs: dict, shape: bool) -> str:
    pairs = ", ".join(f"{{'col': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in cols)
    quantiles = ", ".join(f"round(quantile_cont(x.v, {p}), 6) AS {n}" for n, p in probs.items())
    moments = ", round(skewness(x.v), 6) AS skew, round(kurtosis(x.v), 4) AS kurtosis" if shape else ""
    return f"""WITH {base}, long AS (SELECT unnest([{pairs}]) AS x FROM {source})
SELECT x.col AS "column", count(x.v) AS "count", round(avg(x.v), 6) AS mean, round(stddev_samp(x.v), 6) AS std,
       round(min(x.v), 6) AS "min", round(max(x.v), 6) AS "max", {quantiles}{moments} FROM long GROUP BY x.col"""


def _profile(base: str, source: str, types: dict[str, str]) -> str:
    sums = ", ".join(f"count(*) - count({c}) AS n_{c}, count(DISTINCT {c}) AS d_{c}" for c in types)
    rows = ", ".join(
        f"{{'column': '{c}', 'type': '{t}', 'nulls': n_{c}, 'null_pct': round(100.0 * n_{c} / CAST(total AS DOUBLE), 6), "
        f"'distinct_values': d_{c}}}" for c, t in types.items())
    return f"""WITH {base}, one AS (SELECT count(*) AS total, {sums} FROM {source}),
x AS (SELECT unnest([{rows}]) AS r FROM one)
SELECT r."column" AS "column", r.type AS type, r.nulls AS nulls, r.null_pct AS null_pct,
       r.distinct_values AS distinct_values FROM x"""


_TYPES = {"invoice": "string", "stock_code": "string", "description": "string", "quantity": "bigint",
          "invoice_ts": "timestamp_ntz", "price": "double", "customer_id": "bigint", "country": "string"}

_YEARS = """,
sold AS (SELECT CAST(year(invoice_ts) + CASE WHEN month(invoice_ts) = 12 THEN 1 ELSE 0 END AS INTEGER) AS "year",
                CAST(month(invoice_ts) AS INTEGER) AS "month", CAST(sum(units10k) AS DOUBLE) / 10000.0 AS revenue
         FROM clean WHERE invoice_ts < TIMESTAMP '2000-12-01' GROUP BY 1, 2),
two AS MATERIALIZED (SELECT * FROM sold WHERE "year" IN (1999, 2000))"""

_YOY = _CLEAN + _YEARS + """,
months AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS "month"),
yoy AS MATERIALIZED (
  SELECT m."month", max(revenue) FILTER (WHERE "year" = 1999) AS first_year,
         max(revenue) FILTER (WHERE "year" = 2000) AS second_year
  FROM months m LEFT JOIN two ON m."month" = two."month" GROUP BY m."month")"""

_ONE = ",\nfirsts AS MATERIALIZED (SELECT invoice, arg_min(invoice_ts, rid) AS invoice_ts FROM clean GROUP BY invoice)"

_TOP = """,
by_units AS (SELECT * FROM products ORDER BY units DESC, stock_code LIMIT 10),
by_revenue AS (SELECT * FROM products ORDER BY revenue DESC, stock_code LIMIT 10)"""

_RULE = _CUSTOMERS + """,
scored AS MATERIALIZED (SELECT premium AS actual, CAST(frequency >= 13 AS INTEGER) AS predicted FROM customers)"""

_MONTHLY = f"""SELECT CAST(date_trunc('month', invoice_ts) AS DATE) AS "month", {_money()} AS revenue,
       count(DISTINCT invoice) AS invoices, count(DISTINCT CAST(invoice_ts AS DATE)) AS trading_days FROM clean"""

_PREDICTORS = ["frequency", "recency", "tenure", "distinct_products", "lines_per_invoice", "is_home"]


def _ranking(col: str) -> str:
    return f"""WITH {_PRODUCTS}, total AS (SELECT sum({col}) AS t FROM products)
SELECT stock_code, product, units, revenue, round(100.0 * {col} / t, 6) AS pct_{col}
FROM products, total ORDER BY {col} DESC, stock_code LIMIT 10"""


def _histogram() -> str:
    return f"""WITH {_CLEAN},
long AS (SELECT unnest([{{'col': 'quantity', 'v': CAST(quantity AS DOUBLE)}}, {{'col': 'price', 'v': price}},
                        {{'col': 'revenue', 'v': revenue}}]) AS x FROM clean),
vals AS MATERIALIZED (SELECT x.col AS col, x.v AS v FROM long),
limits AS (SELECT col, min(v) AS lo, max(v) AS hi FROM vals GROUP BY col),
edge AS (SELECT col, i, CASE WHEN i = 0 THEN lo WHEN i = 49 THEN hi
                ELSE pow(10.0, log10(lo) + (log10(hi) - log10(lo)) * i / 49) END AS e
         FROM limits, (SELECT unnest(range(50)) AS i)),
whole AS (SELECT DISTINCT col, CASE WHEN col = 'quantity' THEN floor(e) ELSE e END AS e FROM edge),
bins AS (SELECT col, row_number() OVER w - 1 AS bin, e AS lower, lead(e) OVER w AS upper,
                max(e) OVER (PARTITION BY col) AS top FROM whole WINDOW w AS (PARTITION BY col ORDER BY e))
SELECT b.col AS "column", CAST(b.bin AS INTEGER) AS bin, round(b.lower, 6) AS lower, round(b.upper, 6) AS upper,
       count(v.v) AS lines
FROM bins b LEFT JOIN vals v ON v.col = b.col AND v.v >= b.lower
     AND (v.v < b.upper OR (b.upper = b.top AND v.v = b.upper))
WHERE b.upper IS NOT NULL GROUP BY ALL"""


ORACLES = {
    "part_profile": f"""WITH {_RAW},
tagged AS (SELECT unnest(CASE WHEN invoice_ts < '1998-06-01' THEN ['part_1'] WHEN invoice_ts < '1998-07-01'
           THEN ['part_1', 'part_2'] ELSE ['part_2'] END) AS part, invoice_ts FROM raw)
SELECT part, count(*) AS rows, min(invoice_ts) AS first_ts, max(invoice_ts) AS last_ts,
       '{_BUSINESS}' AS columns FROM tagged GROUP BY part""",
    "overlap_report": f"""WITH {_RAW}, june AS MATERIALIZED (SELECT * FROM raw WHERE invoice_ts >= (
    SELECT min(invoice_ts) FROM raw WHERE invoice_ts >= '1998-06-01') AND invoice_ts < '1998-07-01')
SELECT count(*) AS rows_first, count(*) AS rows_second, count(*) AS identical_rows,
       CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second,
       min(invoice_ts) AS range_start, max(invoice_ts) AS range_end FROM june""",
    "load_reconciliation": f"""WITH {_RAW},
lines AS (SELECT *, rid // 10 AS line, rid // 10 % 97 <> 0 AND rid // 10 % 89 <> 1 AND rid // 10 % 83 <> 2 AS good FROM raw),
placed AS (SELECT *, unnest(CASE WHEN invoice_ts < '1998-06-01' THEN ['part_1'] WHEN invoice_ts < '1998-07-01'
           THEN ['part_1', 'part_2'] ELSE ['part_2'] END) AS part FROM lines),
cut AS (SELECT min(invoice_ts) AS start FROM placed WHERE part = 'part_2' AND good)
SELECT part, count(*) AS delivered, count(*) FILTER (NOT good) AS rejected,
       count(*) FILTER (good AND part = 'part_1' AND invoice_ts >= start) AS overlap,
       count(*) FILTER (good AND NOT (part = 'part_1' AND invoice_ts >= start)) AS loaded,
       count(*) FILTER (line % 5 = 3) AS quoted, count(*) AS row_ids,
       CAST(sum(CASE WHEN line % 97 <> 0 THEN quantity END) AS BIGINT) AS units
FROM placed, cut GROUP BY part""",
    "merged_sales": f"WITH {_RAW} SELECT {_BUSINESS} FROM raw",
    "typed_export": f"WITH {_RAW} SELECT {_BUSINESS} FROM raw",
    "raw_headline": f"""WITH {_RAW} SELECT count(*) AS rows, CAST(8 AS INTEGER) AS columns,
       min(invoice_ts) AS first_ts, max(invoice_ts) AS last_ts FROM raw""",
    "raw_profile": _profile(_RAW, "raw", _TYPES),
    "invoice_prefixes": f"""WITH {_RAW} SELECT CASE WHEN regexp_extract(invoice, '^([^0-9]*)', 1) = ''
       THEN '(numeric)' ELSE regexp_extract(invoice, '^([^0-9]*)', 1) END AS prefix, count(*) AS lines
FROM raw GROUP BY 1""",
    "code_normalization_audit": f"""WITH {_RAW}
SELECT count(*) FILTER (WHERE stock_code <> trim(stock_code)) AS lines_with_spaces,
       count(*) FILTER (WHERE trim(stock_code) <> upper(trim(stock_code))) AS lines_with_lower_case,
       count(DISTINCT stock_code) AS codes_before, count(DISTINCT upper(trim(stock_code))) AS codes_after FROM raw""",
    "normalized_codes": f"""WITH {_RAW} SELECT upper(trim(stock_code)) AS stock_code, count(*) AS lines
FROM raw GROUP BY 1""",
    "exact_duplicates": f"""WITH {_RAW}, norm AS (SELECT * REPLACE (upper(trim(stock_code)) AS stock_code) FROM raw)
SELECT {_BUSINESS}, count(*) AS copies FROM norm GROUP BY {_BUSINESS} HAVING count(*) > 1""",
    "annulled_sales": f"WITH {_AUDIT} SELECT {_BUSINESS} FROM audited WHERE rule = 'annulled_sale'",
    "audited_sales": f"WITH {_AUDIT} SELECT {_BUSINESS}, copies, rule FROM audited",
    "cleaning_ledger": f"""WITH {_AUDIT},
one AS (SELECT CAST(sum(copies) AS BIGINT) AS n, CAST(sum(copies - 1) AS BIGINT) AS d,
        count(*) FILTER (WHERE rule = 'annulled_sale') AS a, count(*) FILTER (WHERE rule = 'cancellation') AS c,
        count(*) FILTER (WHERE rule = 'non_positive') AS p, count(*) FILTER (WHERE rule = 'non_product') AS x,
        count(*) FILTER (WHERE rule = 'kept') AS k FROM audited),
long AS (SELECT n, unnest([{{'s': 0, 'r': 'rows_in', 'v': n}}, {{'s': 1, 'r': 'exact_duplicate', 'v': d}},
   {{'s': 2, 'r': 'annulled_sale', 'v': a}}, {{'s': 3, 'r': 'cancellation', 'v': c}},
   {{'s': 4, 'r': 'non_positive', 'v': p}}, {{'s': 5, 'r': 'non_product', 'v': x}},
   {{'s': 6, 'r': 'rows_out', 'v': k}}]) AS z FROM one)
SELECT CAST(z.s AS INTEGER) AS step, z.r AS rule, z.v AS rows, round(z.v / CAST(n AS DOUBLE) * 100, 6) AS pct_of_input
FROM long""",
    "code_audit": f"""WITH {_AUDIT}
SELECT stock_code, count(*) AS lines, arg_min(description, rid) FILTER (WHERE description IS NOT NULL) AS description,
       round(median(price), 6) AS median_price,
       CASE WHEN stock_code LIKE 'DCGS%' OR stock_code LIKE 'SP1002%' THEN 'keep' ELSE 'drop' END AS decision
FROM audited WHERE rule IN ('kept', 'non_product') AND NOT regexp_matches(stock_code, '^[0-9]{{5}}[A-Z]*$')
GROUP BY stock_code""",
    "annulled_summary": f"""WITH {_AUDIT} SELECT count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units,
       {_money("CAST(round(quantity * price * 10000) AS BIGINT)")} AS revenue
FROM audited WHERE rule = 'annulled_sale'""",
    "annulled_top": f"""WITH {_AUDIT} SELECT invoice, stock_code, description, quantity, invoice_ts, customer_id
FROM audited WHERE rule = 'annulled_sale' ORDER BY quantity DESC, rid LIMIT 5""",
    "clean_sales": f"WITH {_CLEAN} SELECT {_BUSINESS}, revenue FROM clean",
    "sales_headline": f"""WITH {_CLEAN} SELECT count(DISTINCT invoice) AS invoices,
       count(DISTINCT stock_code) AS products, count(DISTINCT customer_id) AS customers,
       count(DISTINCT country) AS countries,
       round(avg(CASE WHEN customer_id IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_without_customer,
       {_money()} AS revenue FROM clean""",
    "clean_headline": f"""WITH {_CLEAN} SELECT count(*) AS rows, CAST(9 AS INTEGER) AS columns,
       min(invoice_ts) AS first_ts, max(invoice_ts) AS last_ts FROM clean""",
    "clean_profile": _profile(
        _PRODUCTS + ", wide AS (SELECT clean.*, product FROM clean LEFT JOIN products USING (stock_code))",
        "wide", {**_TYPES, "revenue": "double", "product": "string"}),
    "sales_with_product": f"""WITH {_PRODUCTS} SELECT invoice, stock_code, product, quantity, clean.revenue AS revenue
FROM clean JOIN products USING (stock_code)""",
    "product_dim": f"WITH {_PRODUCTS} SELECT * FROM products",
    "multi_description_codes": f"""WITH {_PRODUCTS}
SELECT count(*) FILTER (WHERE descriptions > 1) AS codes_with_several, count(*) AS codes FROM products""",
    "describe_lines": _describe(_CLEAN, "clean", ["quantity", "price", "revenue"], _PERCENTILES, True),
    "describe_invoices": _describe(
        _CLEAN + f""", totals AS (SELECT invoice, count(*) AS lines, sum(quantity) AS units, {_money()} AS value
        FROM clean GROUP BY invoice)""", "totals", ["lines", "units", "value"], _PERCENTILES, True),
    "describe_customers": _describe(
        _CLEAN + f""", totals AS (SELECT customer_id, count(DISTINCT invoice) AS invoices, {_money()} AS revenue
        FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id)""",
        "totals", ["invoices", "revenue"], _PERCENTILES, True),
    "invoice_totals": f"""WITH {_CLEAN} SELECT invoice, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units,
       {_money()} AS value FROM clean GROUP BY invoice""",
    "largest_lines": f"""WITH {_PRODUCTS}, big AS (SELECT * FROM clean ORDER BY quantity DESC, rid LIMIT 10)
SELECT invoice, stock_code, product, quantity, price, customer_id, country
FROM big LEFT JOIN products USING (stock_code)""",
    "top_products_by_units": _ranking("units"),
    "top_products_by_revenue": _ranking("revenue"),
    "products_in_both_rankings": f"""WITH {_PRODUCTS}{_TOP}
SELECT stock_code FROM by_units WHERE stock_code IN (SELECT stock_code FROM by_revenue)""",
    "products_for_share": f"""WITH {_PRODUCTS},
amounts AS (SELECT stock_code, CAST(round(revenue * 10000) AS BIGINT) AS v FROM products),
cum AS MATERIALIZED (SELECT CAST(sum(v) OVER (ORDER BY v DESC, stock_code) AS BIGINT) AS so_far,
                            CAST(sum(v) OVER () AS BIGINT) AS total FROM amounts),
goals AS (SELECT unnest([0.5, 0.8])::DOUBLE AS share)
SELECT share, count(*) FILTER (WHERE so_far <= total * share) + 1 AS products,
       round(100.0 * (count(*) FILTER (WHERE so_far <= total * share) + 1) / CAST(count(*) AS DOUBLE), 6) AS pct_of_catalogue
FROM cum, goals GROUP BY share""",
    "product_running_share": f"""WITH {_PRODUCTS},
amounts AS (SELECT stock_code, revenue, CAST(round(revenue * 10000) AS BIGINT) AS v FROM products)
SELECT stock_code, revenue, CAST(sum(v) OVER w AS DOUBLE) / 10000.0 AS running_total,
       round(CAST(sum(v) OVER w AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 6) AS running_share
FROM amounts WINDOW w AS (ORDER BY revenue DESC, stock_code ROWS UNBOUNDED PRECEDING)""",
    "monthly_sales": f"WITH {_CLEAN} {_MONTHLY} GROUP BY 1",
    "yoy_by_month": f"""WITH {_YOY} SELECT "month", first_year, second_year,
       round((second_year / first_year - 1) * 100, 6) AS change_pct FROM yoy""",
    "yoy_total": f"""WITH {_YOY} SELECT round(sum(first_year), 4) AS first_year, round(sum(second_year), 4) AS second_year,
       round((sum(second_year) / sum(first_year) - 1) * 100, 6) AS change_pct FROM yoy""",
    "top_months": f"""WITH {_CLEAN}{_YEARS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY "year" ORDER BY revenue DESC, "month") AS position,
                  sum(revenue) OVER (PARTITION BY "year") AS total FROM two),
best AS (SELECT * FROM ranked WHERE position <= 3)
SELECT "year", CAST(position AS INTEGER) AS position, "month", revenue,
       round(sum(revenue) OVER (PARTITION BY "year") / total * 100, 6) AS pct_of_year_together FROM best""",
    "partial_month": f"""WITH {_CLEAN} {_MONTHLY} WHERE invoice_ts >= TIMESTAMP '2000-12-01'
  AND invoice_ts < TIMESTAMP '2001-01-01' GROUP BY 1""",
    "peak_month": f"""WITH {_CLEAN}{_YEARS}
SELECT "year", arg_max("month", revenue) AS "month", max(revenue) AS revenue FROM two GROUP BY "year" """,
    "one_per_invoice": f"WITH {_RAW} SELECT invoice, arg_min(invoice_ts, rid) AS invoice_ts FROM raw GROUP BY invoice",
    "invoices_by_weekday": f"""WITH {_CLEAN}{_ONE}, days AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS weekday),
n AS (SELECT isodow(invoice_ts) - 1 AS weekday, count(*) AS c FROM firsts GROUP BY 1)
SELECT d.weekday, coalesce(c, 0) AS invoices,
       round(100.0 * coalesce(c, 0) / CAST((SELECT count(*) FROM firsts) AS DOUBLE), 6) AS pct
FROM days d LEFT JOIN n ON d.weekday = n.weekday""",
    "invoices_by_hour": f"""WITH {_CLEAN}{_ONE}
SELECT CAST(hour(invoice_ts) AS INTEGER) AS "hour", count(*) AS invoices,
       round(100.0 * count(*) / CAST((SELECT count(*) FROM firsts) AS DOUBLE), 6) AS pct FROM firsts GROUP BY 1""",
    "customer_summary": f"""WITH {_CLEAN}, totals AS (SELECT customer_id, count(DISTINCT invoice) AS n,
       sum(units10k) AS v FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id)
SELECT count(*) AS customers,
       round(100.0 * CAST(sum(v) AS DOUBLE) / CAST((SELECT sum(units10k) FROM clean) AS DOUBLE), 6) AS pct_revenue_identified,
       round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_one_invoice FROM totals""",
    "pareto_top_share": f"""WITH {_CLEAN}, totals AS (SELECT customer_id, CAST(sum(units10k) AS BIGINT) AS v
       FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id),
ranked AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v DESC) AS r, count(*) OVER () AS n,
                               CAST(sum(v) OVER () AS DOUBLE) AS total FROM totals),
asked AS (SELECT unnest([0.01, 0.05, 0.10, 0.20])::DOUBLE AS top)
SELECT top, CAST(greatest(1, round_even(top * n, 0)) AS BIGINT) AS customers,
       round(CAST(sum(v) AS DOUBLE) / any_value(total), 6) AS revenue_share
FROM ranked, asked WHERE r <= greatest(1, round_even(top * n, 0)) GROUP BY 1, 2""",
    "country_sales": f"""WITH {_CLEAN} SELECT country, count(*) AS lines, count(DISTINCT customer_id) AS customers,
       {_money()} AS revenue, round(100.0 * CAST(sum(units10k) AS DOUBLE)
       / CAST((SELECT sum(units10k) FROM clean) AS DOUBLE), 6) AS pct_revenue FROM clean GROUP BY country""",
    "top_countries": f"""WITH {_CLEAN} SELECT country, count(*) AS lines, count(DISTINCT customer_id) AS customers,
       {_money()} AS revenue, round(100.0 * CAST(sum(units10k) AS DOUBLE)
       / CAST((SELECT sum(units10k) FROM clean) AS DOUBLE), 6) AS pct_revenue
FROM clean GROUP BY country ORDER BY revenue DESC, country LIMIT 10""",
    "log_histogram": _histogram(),
    "flagged_rankings": f"""WITH {_PRODUCTS}{_TOP}
SELECT 'units' AS ranking, stock_code, product, CAST(units AS DOUBLE) AS value,
       stock_code IN (SELECT stock_code FROM by_revenue) AS in_both FROM by_units
UNION ALL SELECT 'revenue', stock_code, product, revenue,
       stock_code IN (SELECT stock_code FROM by_units) FROM by_revenue""",
    "top_product_trend": f"""WITH {_PRODUCTS},
best AS MATERIALIZED (SELECT stock_code, product FROM products ORDER BY revenue DESC, stock_code LIMIT 5),
sold AS MATERIALIZED (SELECT strftime(invoice_ts, '%Y-%m') AS "month", stock_code, {_money()} AS revenue
  FROM clean WHERE invoice_ts < TIMESTAMP '2000-12-01' AND stock_code IN (SELECT stock_code FROM best) GROUP BY 1, 2),
axis AS (SELECT DISTINCT "month" FROM sold)
SELECT axis."month", best.stock_code, product, coalesce(revenue, 0.0) AS revenue
FROM axis CROSS JOIN best LEFT JOIN sold ON sold."month" = axis."month" AND sold.stock_code = best.stock_code""",
    "weekday_hour_counts": f"""WITH {_CLEAN}{_ONE}, hours AS (SELECT DISTINCT CAST(hour(invoice_ts) AS INTEGER) AS h FROM firsts),
days AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS d)
SELECT d AS weekday, h AS "hour", count(invoice) AS invoices FROM hours CROSS JOIN days
LEFT JOIN firsts ON isodow(invoice_ts) - 1 = d AND hour(invoice_ts) = h GROUP BY 1, 2""",
    "weekday_hour_matrix": f"""WITH {_CLEAN}{_ONE}, days AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS weekday)
SELECT weekday, """ + ", ".join(
        f"count(invoice) FILTER (WHERE hour(invoice_ts) = {h}) AS h{h:02d}" for h in range(24)) + """
FROM days LEFT JOIN firsts ON isodow(invoice_ts) - 1 = weekday GROUP BY weekday""",
    "customer_features": f"""WITH {_CUSTOMERS}
SELECT * REPLACE (round(lines_per_invoice, 6) AS lines_per_invoice) FROM customers""",
    "describe_customer_features": _describe(
        _CUSTOMERS, "customers", ["revenue", "units", *_PREDICTORS],
        {"p25": .25, "p50": .5, "p75": .75}, False),
    "premium_threshold": f"WITH {_CUSTOMERS} SELECT round(threshold, 6) AS threshold FROM threshold",
    "label_summary": f"""WITH {_CUSTOMERS} SELECT count(*) AS customers, CAST(sum(premium) AS BIGINT) AS premium_customers,
       round(avg(premium) * 100, 6) AS pct_premium,
       round(100.0 * sum(revenue) FILTER (WHERE premium = 1) / sum(revenue), 6) AS pct_revenue,
       count(*) FILTER (WHERE premium = 1 AND frequency = 1) AS premium_one_invoice FROM customers""",
    "class_profile": f"""WITH {_CUSTOMERS} SELECT premium, CASE WHEN premium = 1 THEN 'Premium' ELSE 'Normal' END AS class, """
        + ", ".join(f"round(CAST(median({c}) AS DOUBLE), 6) AS {c}" for c in ["revenue", *_PREDICTORS])
        + " FROM customers GROUP BY premium",
    "split_summary": f"""WITH {_CUSTOMERS}, per_class AS (SELECT premium, count(*) AS n,
       CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS t FROM customers GROUP BY premium),
one AS (SELECT CAST(sum(n - t) AS BIGINT) AS train_rows, CAST(sum(t) AS BIGINT) AS test_rows,
        sum(t) FILTER (WHERE premium = 1) / CAST(sum(t) AS DOUBLE) AS share FROM per_class)
SELECT train_rows, test_rows, round(share * 100, 6) AS pct_premium_test, round((1 - share) * 100, 6) AS pct_majority FROM one""",
    "stratified_split": f"""WITH {_CUSTOMERS}, ranked AS (
  SELECT customer_id, premium, row_number() OVER (PARTITION BY premium ORDER BY substr(md5('42|' || customer_id), 1, 13)) AS place,
         count(*) OVER (PARTITION BY premium) AS n FROM customers)
SELECT customer_id, premium, place <= round_even(n * 0.2, 0) AS in_test FROM ranked""",
    "linear_normal_equations": """SELECT unnest(['intercept', 'weekday_1', 'weekday_2', 'weekday_3', 'weekday_4', 'weekday_5', 'weekday_6',
  'month_2', 'month_3', 'month_4', 'month_5', 'month_6', 'month_7', 'month_8', 'month_9', 'month_10', 'month_11', 'month_12']) AS indicator,
  0.0::DOUBLE AS residual_sum""",
    "rule_confusion": f"""WITH {_RULE}, zero_one AS (SELECT CAST(unnest([0, 1]) AS INTEGER) AS v)
SELECT a.v AS actual, p.v AS predicted, count(scored.actual) AS n
FROM zero_one a CROSS JOIN zero_one p LEFT JOIN scored ON scored.actual = a.v AND scored.predicted = p.v GROUP BY 1, 2""",
    "rule_metrics": f"""WITH {_RULE},
c AS (SELECT count(*) FILTER (WHERE actual = 1 AND predicted = 1)::DOUBLE AS tp,
             count(*) FILTER (WHERE actual = 0 AND predicted = 1)::DOUBLE AS fp,
             count(*) FILTER (WHERE actual = 1 AND predicted = 0)::DOUBLE AS fn,
             count(*) FILTER (WHERE actual = 0 AND predicted = 0)::DOUBLE AS tn, count(*) AS n FROM scored),
m AS (SELECT n, (tp + tn) / n AS acc, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1,
             tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fp + fn) AS f0,
             (tp + fn)::BIGINT AS s1, (tn + fp)::BIGINT AS s0 FROM c),
z AS (SELECT unnest([
  {{'row': 'Premium', 'p': p1, 'r': r1, 'f': f1, 's': s1}}, {{'row': 'Normal', 'p': p0, 'r': r0, 'f': f0, 's': s0}},
  {{'row': 'accuracy', 'p': acc, 'r': acc, 'f': acc, 's': n}},
  {{'row': 'macro avg', 'p': (p0 + p1) / 2, 'r': (r0 + r1) / 2, 'f': (f0 + f1) / 2, 's': n}},
  {{'row': 'weighted avg', 'p': (p0 * s0 + p1 * s1) / n, 'r': (r0 * s0 + r1 * s1) / n, 'f': (f0 * s0 + f1 * s1) / n, 's': n}}
  ]) AS z FROM m)
SELECT z."row" AS "row", round(z.p, 6) AS precision, round(z.r, 6) AS recall, round(z.f, 6) AS f1, z.s AS support FROM z""",
    "log_skew": f"""WITH {_CUSTOMERS}, long AS (SELECT unnest([{{'c': 'recency', 'v': recency::DOUBLE}},
   {{'c': 'frequency', 'v': frequency::DOUBLE}}, {{'c': 'revenue', 'v': revenue}}]) AS x FROM customers)
SELECT x.c AS "column", round(skewness(x.v), 6) AS original, round(skewness(ln(1 + x.v)), 6) AS log1p
FROM long GROUP BY x.c""",
    "standardized_rfm": f"""WITH {_POINTS} SELECT customer_id, round(a, 6) AS z_recency, round(b, 6) AS z_frequency,
       round(c, 6) AS z_revenue FROM points""",
    "rule_segment_profile": f"""WITH {_CUSTOMERS}, whole AS (SELECT count(*)::DOUBLE AS n, sum(revenue) AS v FROM grouped)
SELECT segment, count(*) AS customers, round(avg(premium) * 100, 6) AS pct_premium,
       round(100.0 * count(*) / any_value(n), 6) AS pct_customers, round(100.0 * sum(revenue) / any_value(v), 6) AS pct_revenue,
       round(CAST(median(recency) AS DOUBLE), 6) AS recency, round(CAST(median(frequency) AS DOUBLE), 6) AS frequency,
       round(median(revenue), 6) AS revenue FROM grouped, whole GROUP BY segment""",
    "rule_segment_relabel": f"""WITH {_CUSTOMERS},
mid AS (SELECT segment, median(revenue) AS m FROM grouped GROUP BY segment),
renumbered AS (SELECT segment, CAST(row_number() OVER (ORDER BY m, segment) - 1 AS INTEGER) AS new_no FROM mid)
SELECT customer_id, new_no AS segment FROM grouped JOIN renumbered USING (segment)""",
    "rule_segment_crosstab": f"""WITH {_CUSTOMERS} SELECT segment, premium, count(*) AS customers
FROM grouped GROUP BY segment, premium""",
    "rule_segment_sizes": f"""WITH {_CUSTOMERS}, n AS (SELECT segment, count(*) AS c FROM grouped GROUP BY segment)
SELECT count(*) AS groups, min(c) AS smallest FROM n""",
    "rule_silhouette": f"""WITH {_POINTS},
size AS (SELECT segment, count(*) AS n FROM points GROUP BY segment),
sums AS (SELECT id, own, theirs, sum(dist) AS d FROM pairs GROUP BY id, own, theirs),
means AS (SELECT id, own, theirs, CASE WHEN own = theirs THEN d / nullif(n - 1, 0) ELSE d / n END AS m, n
          FROM sums JOIN size ON theirs = segment),
ab AS (SELECT id, max(m) FILTER (WHERE own = theirs) AS a, min(m) FILTER (WHERE own <> theirs) AS b,
              max(n) FILTER (WHERE own = theirs) AS own_n FROM means GROUP BY id)
SELECT round(avg(CASE WHEN own_n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""",
    "bandwidth_estimates": f"""WITH {_POINTS},
ranked AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS r FROM pairs),
asked AS (SELECT q, greatest(1, CAST(floor((SELECT count(*) FROM points) * q) AS BIGINT)) AS k
          FROM (SELECT unnest([0.05, 0.10, 0.15, 0.20, 0.25, 0.30])::DOUBLE AS q))
SELECT q AS quantile, round(avg(dist), 5) AS bandwidth FROM ranked JOIN asked ON r = k GROUP BY q""",
    "daily_sales": f"WITH {_DAILY} SELECT * FROM daily",
    "daily_headline": f"""WITH {_DAILY} SELECT count(*) AS trading_days, min("day") AS first_day, max("day") AS last_day
FROM daily""",
    "daily_describe": _describe(_DAILY, "daily", ["revenue"], {"p25": .25, "p50": .5, "p75": .75}, False),
    "temporal_split": f"""WITH {_DAILY} SELECT count(*) FILTER (WHERE "day" < DATE '2001-01-01') AS train_days,
       count(*) FILTER (WHERE "day" >= DATE '2001-01-01') AS test_days,
       min("day") FILTER (WHERE "day" >= DATE '2001-01-01') AS first_test,
       max("day") FILTER (WHERE "day" >= DATE '2001-01-01') AS last_test FROM daily""",
    "calendar_dummies": f"""WITH {_DAILY} SELECT "day", """ + ", ".join(
        [f"CAST(weekday = {d} AS INTEGER) AS weekday_{d}" for d in range(1, 7)]
        + [f'CAST("month" = {m} AS INTEGER) AS month_{m}' for m in range(2, 13)]) + " FROM daily",
    "seasonal_naive": f"""WITH {_NAIVE} SELECT "day", revenue, round(prediction, 6) AS prediction, has_lag FROM naive""",
    "seasonal_naive_metrics": f"""WITH {_NAIVE}
SELECT round(avg(abs(revenue - prediction)), 6) AS mae, round(sqrt(avg((revenue - prediction) ** 2)), 6) AS rmse,
       round(1 - sum((revenue - prediction) ** 2) / (var_pop(revenue) * count(*)), 6) AS r2,
       round((sum(prediction) / sum(revenue) - 1) * 100, 6) AS total_error_pct FROM naive""",
    "seasonal_naive_monthly": f"""WITH {_NAIVE} SELECT CAST(date_trunc('month', "day") AS DATE) AS "month",
       {_money("CAST(round(revenue * 10000) AS BIGINT)")} AS revenue,
       {_money("CAST(round(prediction * 10000) AS BIGINT)")} AS prediction FROM naive GROUP BY 1""",
}
