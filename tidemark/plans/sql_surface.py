"""Ad-hoc SQL: one query per kind of statement a user may send to ``dataset``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordered import asof_join as asof_join_tables
from tidemark.operators.ordered import asof_last, count_in_ranges, framed, pairs_in_ranges, ranked_within, range_frames, running_sums
from tidemark.operators.selection import modes, quantiles, sample_rows
from tidemark.operators.sql import capped, run_sql, suggested_sql
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import table


def statement(key: str, dataset: str, text: str, check: str | None = None, views: tuple[str, ...] = (), checked: bool = True):
    """Register SQL text over ``dataset`` (and named tables); by default the same text is the check."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(text, table(spark, sf_dir, dataset), **{v: table(spark, sf_dir, v) for v in views})

    standard = f"WITH dataset AS (SELECT * FROM {dataset}) {check or text}" if checked else None
    run.__name__ = key
    query(key, standard)(run)


# --- the operator itself -------------------------------------------------------------------

statement(
    "sql_query", "orders",
    'SELECT "o_orderpriority" AS priority, COUNT(*) AS orders, ROUND(SUM("o_totalprice"), 2) AS total '
    'FROM dataset GROUP BY "o_orderpriority" ORDER BY "o_orderpriority"',
)


@query(
    "suggested_sql",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY 1 DESC LIMIT 25",
)
def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return run_sql(suggested_sql("customers", customers.columns), customers)


@query("row_cap", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return capped(run_sql("SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_orderkey DESC NULLS LAST", orders))


# --- projection and filters ----------------------------------------------------------------

statement(
    "sql_project_filter", "customer",
    "SELECT c_custkey, upper(c_mktsegment) AS segment, c_nationkey::BIGINT AS nation, "
    "CASE WHEN c_acctbal < 0 THEN 'debit' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'low' ELSE 'high' END AS band "
    "FROM dataset WHERE c_name ILIKE 'customer#%' AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND NOT c_nationkey IN (3, 4)",
)
statement(
    "sql_star_exclude", "supplier", "SELECT * EXCEPT (s_acctbal) FROM dataset", "SELECT * EXCLUDE (s_acctbal) FROM dataset"
)

# --- joins ---------------------------------------------------------------------------------

statement(
    "sql_inner_join", "orders",
    "SELECT n.n_name, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice), 2) AS total FROM dataset o "
    "JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name",
    views=("customer", "nation"),
)
statement(
    "sql_left_join", "customer",
    "SELECT c.c_custkey, coalesce(e.n, 0) AS events FROM dataset c LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) e "
    "ON e.user_id = c.c_custkey",
    "SELECT c.c_custkey, COUNT(e.event_id) AS events FROM dataset c LEFT JOIN events e ON e.user_id = c.c_custkey GROUP BY c.c_custkey",
    views=("events",),
)
statement(
    "sql_full_join", "documents",
    "SELECT coalesce(d.doc_id, -1) AS doc_id, coalesce(l.doc_id, -1) AS label_id, coalesce(l.quality, -1) AS quality "
    "FROM dataset d FULL JOIN (SELECT doc_id, quality FROM labels UNION ALL SELECT -1 - doc_id, quality FROM labels) l ON l.doc_id = d.doc_id",
    views=("labels",),
)
statement(
    "sql_self_join", "orders",
    "SELECT a.o_orderkey, b.o_orderkey AS next_key, a.o_orderpriority = b.o_orderpriority AS same_priority "
    "FROM dataset a JOIN dataset b ON b.o_orderkey = a.o_orderkey + 1 AND b.o_orderstatus <> a.o_orderstatus",
)
statement(
    "sql_semi_anti", "customer",
    "SELECT c_custkey, 'seen' AS activity FROM dataset c WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') e "
    "WHERE e.user_id = c.c_custkey) UNION ALL SELECT c_custkey, 'never' FROM dataset c WHERE NOT EXISTS "
    "(SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders) o WHERE o.o_custkey = c.c_custkey) "
    "UNION ALL SELECT c_custkey, 'big' FROM dataset WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 480000)",
    "SELECT c_custkey, 'seen' AS activity FROM dataset c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'purchase') "
    "UNION ALL SELECT c_custkey, 'never' FROM dataset c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) "
    "UNION ALL SELECT c_custkey, 'big' FROM dataset WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)",
    views=("events", "orders"),
)

HOUR_MICROS = 3_600_000_000


@query(
    "sql_range_join",
    "SELECT p.event_id, COUNT(e.event_id) AS matches FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts "
    "AND e.ts <= p.ts + INTERVAL 1 HOUR WHERE p.event_type = 'purchase' GROUP BY p.event_id",
)
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of the same user follow each purchase within an hour."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("at"))
    ranges = events.where("event_type = 'purchase'").select(
        "event_id", "user_id", F.col("at").alias("low"), (F.col("at") + HOUR_MICROS).alias("high")
    )
    return count_in_ranges(events, ranges, "user_id", "event_id", "at", "low", "high", HOUR_MICROS)


@query(
    "sql_asof_join",
    "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p "
    "ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's newest view at or before each purchase."""
    events = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'view')")
    found = asof_last(
        events.select("event_id", "user_id", "event_type", "ts"),
        "user_id",
        ["ts", "event_id"],
        F.date_trunc("hour", "ts"),
        F.col("event_type") == "view",
        F.col("event_id"),
        "view_id",
    )
    return found.where("event_type = 'purchase' AND view_id IS NOT NULL").select("event_id", "view_id")


@query(
    "sql_range_pairs",
    "SELECT p.event_id AS purchase_id, e.event_id FROM events p JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts "
    "AND e.ts <= p.ts + INTERVAL 1 HOUR WHERE p.event_type = 'purchase'",
)
def range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the same user within an hour after each purchase."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("at"))
    ranges = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("purchase_id"), "user_id", F.col("at").alias("low"), (F.col("at") + HOUR_MICROS).alias("high")
    )
    return pairs_in_ranges(events, ranges, "user_id", "event_id", "purchase_id", "at", "low", "high", HOUR_MICROS)


@query(
    "sql_asof_tables",
    "SELECT o_orderkey, event_id FROM (SELECT o_orderkey, o_custkey, o_orderdate FROM orders) o ASOF LEFT JOIN "
    "(SELECT user_id, ts - INTERVAL 6 YEAR AS ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON e.user_id = o.o_custkey AND e.ts <= o.o_orderdate",
)
def asof_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's newest event (moved to the orders' years) before each order: two tables, pieces cut where the rows lie."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 6 YEAR")).alias("ts"))
    return asof_join_tables(orders, events, "user_id", "ts", "event_id", "event_id").select("o_orderkey", "event_id")


# --- aggregates ----------------------------------------------------------------------------

statement(
    "sql_group_by", "lineitem",
    "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_discount > 0.05) AS discounted, "
    "ROUND(SUM(l_extendedprice * (1 - l_discount)), 0) AS revenue, ROUND(AVG(l_quantity), 4) AS avg_quantity "
    "FROM dataset GROUP BY ALL HAVING COUNT(*) > 10",
)
statement(
    "sql_distinct", "orders",
    "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderdate) AS days "
    "FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderpriority FROM dataset) t GROUP BY o_orderpriority",
)
statement(
    "sql_approx_distinct", "orders",
    "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, "
    "abs(approx_count_distinct(o_custkey) - COUNT(DISTINCT o_custkey)) <= 0.15 * COUNT(DISTINCT o_custkey) AS within_bound "
    "FROM dataset GROUP BY o_orderpriority",
    "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, TRUE AS within_bound FROM dataset GROUP BY o_orderpriority",
)
_SUM = "CAST(SUM(l_linenumber) AS BIGINT) AS lines"
statement(
    "sql_grouping_sets", "lineitem",
    f"SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, COUNT(*) AS n, {_SUM} "
    "FROM dataset GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
)
statement(
    "sql_cube", "lineitem",
    f"SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, CAST(GROUPING(l_returnflag) AS BIGINT) AS g, COUNT(*) AS n, {_SUM} "
    "FROM dataset GROUP BY CUBE (l_returnflag, l_linestatus)",
)
statement(
    "sql_rollup", "orders",
    "SELECT coalesce(CAST(extract(year FROM o_orderdate) AS BIGINT), -1) AS year_no, coalesce(o_orderstatus, '*') AS status, COUNT(*) AS n "
    "FROM dataset GROUP BY ROLLUP (extract(year FROM o_orderdate), o_orderstatus)",
)
# Exact percentiles keep one counter per distinct value, so they are taken of a column with few.
statement(
    "sql_stat_aggs", "lineitem",
    "SELECT l_returnflag, CAST(median(l_quantity) AS DOUBLE) AS median_quantity, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90, "
    "percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS p25, ROUND(stddev_samp(l_extendedprice), 3) AS spread, "
    "ROUND(corr(l_quantity, l_extendedprice), 6) AS relation, ROUND(var_pop(l_discount), 8) AS discount_variance FROM dataset GROUP BY l_returnflag",
)
statement(
    "sql_mode", "lineitem",
    "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_quantity) AS common_quantity FROM dataset GROUP BY l_returnflag",
    "SELECT l_returnflag, l_quantity AS common_quantity FROM (SELECT l_returnflag, l_quantity, row_number() OVER "
    "(PARTITION BY l_returnflag ORDER BY COUNT(*) DESC, l_quantity) AS n FROM dataset GROUP BY l_returnflag, l_quantity) t WHERE n = 1",
)
@query(
    "sql_wide_percentiles",
    "SELECT l_returnflag, ROUND(quantile_cont(l_extendedprice, 0.5), 6) AS median_price, ROUND(quantile_cont(l_extendedprice, 0.9), 6) AS p90, "
    "quantile_disc(l_extendedprice, 0.25) AS p25 FROM lineitem GROUP BY l_returnflag",
)
def wide_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of a column with nearly as many values as rows."""
    found = quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median_price": 0.5, "p90": 0.9}, {"p25": 0.25})
    return found.select("l_returnflag", F.round("median_price", 6).alias("median_price"), F.round("p90", 6).alias("p90"), "p25")


@query(
    "sql_wide_mode",
    "SELECT l_returnflag, l_extendedprice, times FROM (SELECT l_returnflag, l_extendedprice, COUNT(*) AS times, row_number() OVER "
    "(PARTITION BY l_returnflag ORDER BY COUNT(*) DESC, l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag, l_extendedprice) t WHERE n = 1",
)
def wide_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


statement(
    "sql_string_agg", "orders",
    "SELECT o_custkey, listagg(DISTINCT o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) AS priorities FROM dataset GROUP BY o_custkey",
    "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM dataset GROUP BY o_custkey",
)

# --- windows: cut per key before the shuffle, or run over monthly totals ---------------------

statement(
    "sql_rank", "orders",
    "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS price_rank, CAST(dense_rank() OVER w AS BIGINT) AS price_dense, "
    "CAST(row_number() OVER w AS BIGINT) AS price_row FROM dataset WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) t "
    "WHERE price_rank <= 3",
)
statement(
    "sql_qualify", "orders",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n "
    "FROM dataset) t WHERE n = 1",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM dataset QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
)
_MONTHLY = (
    "monthly AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS m, COUNT(*) AS n FROM dataset GROUP BY o_orderpriority, "
    "date_trunc('month', o_orderdate))"
)


def _monthly(key: str, columns: str) -> None:
    text = f"{_MONTHLY} SELECT p, CAST(CAST(m AS DATE) AS STRING) AS m, n, {columns} FROM monthly WINDOW w AS (PARTITION BY p ORDER BY m)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(f"WITH {text}", table(spark, sf_dir, "orders"))

    query(key, f"WITH dataset AS (SELECT * FROM orders), {text}")(run)


_monthly(
    "sql_analytic",
    "coalesce(lag(n) OVER w, -1) AS before, coalesce(lead(n, 2) OVER w, -1) AS later, first_value(n) OVER w AS first_n, "
    "coalesce(nth_value(n, 2) OVER w, -1) AS second_n, CAST(ntile(4) OVER w AS BIGINT) AS quarter_no, "
    "ROUND(percent_rank() OVER w, 6) AS share, ROUND(cume_dist() OVER w, 6) AS cumulative",
)
_monthly(
    "sql_frames",
    "CAST(SUM(n) OVER (PARTITION BY p ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three, "
    "CAST(SUM(n) OVER (PARTITION BY p ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, "
    "CAST(SUM(n) OVER (PARTITION BY p ORDER BY m RANGE BETWEEN INTERVAL '62' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS recent, "
    "MAX(n) OVER (PARTITION BY p) AS peak",
)

# --- windows over raw rows: three keys hold all lines -------------------------------------------

_LINE = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_LINE_ORDER = f"(PARTITION BY l_returnflag ORDER BY {', '.join(_LINE)})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", *_LINE)


@query(
    "sql_wide_frames",
    "SELECT l_returnflag, l_extendedprice, l_orderkey, l_linenumber, SUM(l_quantity) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three, "
    "MAX(l_quantity) OVER (w ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS around, lag(l_extendedprice, 2) OVER w AS before, "
    f"lead(l_extendedprice, 3) OVER w AS later FROM lineitem WINDOW w AS {_LINE_ORDER}",
)
def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving sums, lag and lead over all order lines of a return flag."""
    done = framed(
        _lines(spark, sf_dir), ["l_returnflag"], [F.col(c) for c in _LINE], 2, 3,
        {
            "last_three": lambda w: F.sum("l_quantity").over(w.rowsBetween(-2, 0)),
            "around": lambda w: F.max("l_quantity").over(w.rowsBetween(-1, 3)),
            "before": lambda w: F.lag("l_extendedprice", 2).over(w),
            "later": lambda w: F.lead("l_extendedprice", 3).over(w),
        },
    )
    return done.drop("l_partkey", "l_suppkey", "l_quantity")


@query(
    "sql_wide_running",
    f"SELECT l_returnflag, l_extendedprice, CAST(SUM(SUM(l_linenumber)) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS BIGINT) AS running "
    "FROM lineitem GROUP BY l_returnflag, l_extendedprice",
)
def wide_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by price over all order lines of a return flag."""
    prices = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.sum("l_linenumber").alias("lines"))
    done = running_sums(prices, ["l_returnflag"], ["l_extendedprice"], ["lines"])
    return done.select("l_returnflag", "l_extendedprice", (F.col("before_lines") + F.col("lines")).alias("running"))


_BY_KEY = "OVER (PARTITION BY l_returnflag ORDER BY l_orderkey RANGE BETWEEN 1000 PRECEDING AND 500 FOLLOWING)"


@query(
    "sql_wide_ranges",
    f"SELECT l_returnflag, l_orderkey, l_linenumber, CAST(SUM(l_linenumber) {_BY_KEY} AS BIGINT) AS lines, COUNT(*) {_BY_KEY} AS n FROM lineitem",
)
def wide_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RANGE frames over all order lines of a return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return range_frames(lines, ["l_returnflag"], "l_orderkey", 1000, 500, {"lines": F.col("l_linenumber"), "n": F.lit(1)})


@query(
    "sql_wide_analytic",
    "SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber, CAST(rank() OVER w AS BIGINT) AS rank, ROUND(percent_rank() OVER w, 9) AS percent_rank, "
    "ROUND(cume_dist() OVER w, 9) AS cume_dist FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)",
)
def wide_analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks and shares over all order lines of a return flag, with many equal rows."""
    done = ranked_within(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber"), ["l_returnflag"], ["l_quantity"], 4)
    return done.select(
        "l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist")
    )


@query(
    "sql_wide_tiles",
    f"SELECT l_returnflag, tile, COUNT(*) AS n, MAX(l_extendedprice) AS top FROM (SELECT *, CAST(ntile(7) OVER {_LINE_ORDER} AS BIGINT) AS tile FROM lineitem) t GROUP BY l_returnflag, tile",
)
def wide_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ranked_within(_lines(spark, sf_dir), ["l_returnflag"], _LINE, 7)
    return done.groupBy("l_returnflag", "tile").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top"))


# --- set operations, order, subqueries, CTEs -------------------------------------------------

statement(
    "sql_set_ops", "customer",
    "SELECT 'union' AS op, k FROM (SELECT c_custkey AS k FROM dataset UNION SELECT o_custkey FROM orders) a "
    "UNION ALL SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM dataset INTERSECT SELECT user_id FROM events) b "
    "UNION ALL SELECT 'except', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM dataset) c",
    views=("orders", "events"),
)
statement(
    "sql_order_limit_offset", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM dataset "
    "ORDER BY 5 DESC NULLS LAST, 1 ASC NULLS LAST, 2 NULLS LAST, 3 NULLS LAST, 4 NULLS LAST LIMIT 40 OFFSET 10",
)
statement(
    "sql_subquery", "orders",
    "SELECT o.o_orderkey, o.o_totalprice > (SELECT AVG(o_totalprice) FROM dataset) AS above_mean, "
    "(SELECT c.c_mktsegment FROM customer c WHERE c.c_custkey = o.o_custkey) AS segment, t.yearly FROM dataset o, "
    "LATERAL (SELECT CAST(extract(year FROM o.o_orderdate) * 10 AS BIGINT) AS yearly) t",
    views=("customer",),
)

def _with(key: str, dataset: str, ctes: str, text: str, recursive: bool = False) -> None:
    start = "WITH RECURSIVE" if recursive else "WITH"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(f"{start} {ctes} {text}", table(spark, sf_dir, dataset))

    query(key, f"{start} dataset AS (SELECT * FROM {dataset}), {ctes} {text}")(run)


_with(
    "sql_cte", "lineitem",
    "sums AS (SELECT l_orderkey, SUM(l_quantity) AS q FROM dataset GROUP BY l_orderkey), "
    "banded AS (SELECT l_orderkey, CASE WHEN q < 50 THEN 'small' WHEN q < 150 THEN 'middle' ELSE 'large' END AS band FROM sums)",
    "SELECT band, COUNT(*) AS orders FROM banded GROUP BY band",
)
_with(
    "sql_recursive_cte", "part",
    "held AS (SELECT p_size, COUNT(*) AS parts FROM dataset GROUP BY p_size), "
    "sizes AS (SELECT MIN(p_size) AS n, MAX(p_size) AS hi FROM held UNION ALL SELECT n + 1, hi FROM sizes WHERE n < hi)",
    "SELECT n, coalesce(parts, 0) AS parts FROM sizes LEFT JOIN held ON p_size = n",
    recursive=True,
)

# --- reshape and sample ----------------------------------------------------------------------

statement(
    "sql_pivot", "orders",
    "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM dataset) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('O' AS o_open, 'F' AS o_final, 'P' AS o_part))",
    "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o_open, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS o_final, "
    "COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS o_part FROM dataset GROUP BY o_orderpriority",
)
statement(
    "sql_unpivot", "lineitem",
    "SELECT measure, COUNT(*) AS n, ROUND(SUM(amount), 2) AS total FROM (SELECT l_quantity, l_discount, l_tax FROM dataset) "
    "UNPIVOT (amount FOR measure IN (l_quantity, l_discount, l_tax)) GROUP BY measure",
)
_SAMPLED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_IDENTITY = "concat_ws(':', {})".format(", ".join(f"CAST({c} AS VARCHAR)" for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]))
_PICKED = ", ".join(_SAMPLED)


def _identity() -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]])


@query("sql_sample", f"SELECT {_PICKED} FROM lineitem ORDER BY md5('42:' || {_IDENTITY}) LIMIT 1000")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand order lines drawn from all: the same ones however the table is dealt."""
    return sample_rows(table(spark, sf_dir, "lineitem").select(_SAMPLED), 1000, _identity())


@query(
    "sql_sample_strata",
    f"SELECT l_returnflag, {_PICKED} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || {_IDENTITY})) <= 200",
)
def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred order lines of each return flag."""
    return sample_rows(table(spark, sf_dir, "lineitem").select("l_returnflag", *_SAMPLED), 200, _identity(), ["l_returnflag"])


statement(
    "sql_sample_share", "orders",
    "WITH picked AS (SELECT * FROM dataset TABLESAMPLE (10 PERCENT) REPEATABLE (42)), counted AS "
    "(SELECT COUNT(*) AS rows_in_all, (SELECT COUNT(*) FROM picked) AS rows_picked, "
    "(SELECT COUNT(*) FROM picked p LEFT ANTI JOIN dataset d ON p.o_orderkey = d.o_orderkey AND p.o_totalprice = d.o_totalprice) AS strangers FROM dataset) "
    "SELECT rows_in_all, strangers, abs(rows_picked - rows_in_all * 0.1) <= 5 * sqrt(rows_in_all * 0.09) AS size_fits FROM counted",
    "SELECT COUNT(*) AS rows_in_all, CAST(0 AS BIGINT) AS strangers, TRUE AS size_fits FROM dataset",
)

# --- scalar functions ------------------------------------------------------------------------

statement(
    "sql_string_fns", "customer",
    "SELECT c_custkey, lower(c_name) AS low, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 1, 8) AS start8, replace(c_name, '#', '-') AS dashed, "
    "lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, concat_ws('/', c_mktsegment, c_name) AS joined, reverse(c_mktsegment) AS reversed, "
    "split_part(c_name, '#', 2) AS digits, regexp_replace(c_name, '[-_#]+', ' ') AS spaced, c_name LIKE '%1' AS ends_one, "
    "ltrim(concat('  ', c_mktsegment)) AS trimmed, repeat('x', 3) AS xs, CAST(position('#' IN c_name) AS BIGINT) AS hash_at FROM dataset",
    "SELECT c_custkey, lower(c_name) AS low, CAST(length(c_name) AS BIGINT) AS n, substr(c_name, 1, 8) AS start8, replace(c_name, '#', '-') AS dashed, "
    "lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, concat_ws('/', c_mktsegment, c_name) AS joined, reverse(c_mktsegment) AS reversed, "
    "split_part(c_name, '#', 2) AS digits, regexp_replace(c_name, '[-_#]+', ' ', 'g') AS spaced, c_name LIKE '%1' AS ends_one, "
    "ltrim(concat('  ', c_mktsegment)) AS trimmed, repeat('x', 3) AS xs, CAST(position('#' IN c_name) AS BIGINT) AS hash_at FROM dataset",
)
statement(
    "sql_date_fns", "orders",
    "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS day_text, CAST(extract(month FROM o_orderdate) AS BIGINT) AS month_no, "
    "CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS STRING) AS quarter_start, CAST(CAST(o_orderdate AS DATE) + 7 AS STRING) AS week_later, "
    "CAST(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS BIGINT) AS days, CAST(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS STRING) AS month_later, "
    "CAST(last_day(o_orderdate) AS STRING) AS month_end FROM dataset",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_text, CAST(extract(month FROM o_orderdate) AS BIGINT) AS month_no, "
    "CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS STRING) AS quarter_start, CAST(CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS STRING) AS week_later, "
    "CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE) AS STRING) AS month_later, "
    "CAST(last_day(o_orderdate) AS STRING) AS month_end FROM dataset",
)
statement(
    "sql_math_fns", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(-l_quantity) AS a, floor(l_extendedprice) * 1.0D AS f, ceil(l_extendedprice) * 1.0D AS c, "
    "ROUND(sqrt(l_quantity), 6) AS r, ROUND(ln(l_extendedprice), 6) AS l, power(l_linenumber, 2) AS p, l_partkey div 7 AS d, l_partkey % 7 AS m, "
    "sign(l_discount - 0.05D) AS s, greatest(l_tax, l_discount) AS g, try_divide(l_quantity, l_discount) IS NULL AS undefined FROM dataset",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(-l_quantity) AS a, CAST(floor(l_extendedprice) AS DOUBLE) AS f, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, "
    "ROUND(sqrt(l_quantity), 6) AS r, ROUND(ln(l_extendedprice), 6) AS l, power(l_linenumber, 2) AS p, l_partkey // 7 AS d, l_partkey % 7 AS m, "
    "CAST(sign(l_discount - 0.05::DOUBLE) AS DOUBLE) AS s, greatest(l_tax, l_discount) AS g, l_discount = 0 AS undefined FROM dataset",
)
statement(
    "sql_list_fns", "embeddings",
    "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, CAST(element_at(embedding, 1) AS DOUBLE) AS first_value, "
    "ROUND(aggregate(embedding, 0D, (a, x) -> a + x), 4) AS total, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive, "
    "array_contains(array(label, 1), 1) AS has_one, array_join(slice(array('a', 'b', 'c'), 2, 2), '-') AS sliced FROM dataset",
    "SELECT vec_id, len(embedding) AS n, CAST(embedding[1] AS DOUBLE) AS first_value, "
    "ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, len(list_filter(embedding, lambda x: x > 0)) AS positive, "
    "list_contains([label, 1], 1) AS has_one, array_to_string(list_slice(['a', 'b', 'c'], 2, 3), '-') AS sliced FROM dataset",
)
statement(
    "sql_unnest", "embeddings",
    "SELECT label, COUNT(*) AS n, COUNT_IF(x > 0) AS positive FROM dataset LATERAL VIEW explode(embedding) e AS x GROUP BY label",
    "SELECT label, COUNT(*) AS n, COUNT(*) FILTER (WHERE x > 0) AS positive FROM (SELECT label, unnest(embedding) AS x FROM dataset) t GROUP BY label",
)
statement(
    "sql_map_fns", "events",
    "SELECT event_id, m['type'] AS type_text, CAST(size(m) AS BIGINT) AS n, array_join(array_sort(map_keys(m)), ',') AS names, "
    "coalesce(try_element_at(m, 'none'), '-') AS missing FROM (SELECT event_id, map('type', event_type, 'user', CAST(user_id AS STRING)) AS m FROM dataset)",
    "SELECT event_id, m['type'] AS type_text, CAST(cardinality(m) AS BIGINT) AS n, array_to_string(list_sort(map_keys(m)), ',') AS names, "
    "coalesce(m['none'], '-') AS missing FROM (SELECT event_id, MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)} AS m FROM dataset) t",
)
statement(
    "sql_json_fns", "events",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k INT').k + 1 AS k_next, "
    "to_json(named_struct('id', event_id, 'type', event_type)) AS text_form, get_json_object(props, '$.none') IS NULL AS missing FROM dataset",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS k_next, "
    "concat('{\"id\":', event_id, ',\"type\":\"', event_type, '\"}') AS text_form, json_extract(props, '$.none') IS NULL AS missing FROM dataset",
)
statement(
    "sql_hash_fns", "documents",
    "SELECT doc_id, sha2(text, 256) AS digest, md5(source) AS source_digest FROM dataset",
    "SELECT doc_id, sha256(text) AS digest, md5(source) AS source_digest FROM dataset",
)
