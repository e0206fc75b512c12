"""Relational families reachable through SQL: one or more checked queries each."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelwarden.operators.joins import range_join
from modelwarden.operators.ordered import asof_join
from modelwarden.plans.catalog import query
from modelwarden.plans.views import table
from modelwarden.session import work_dir
from modelwarden.sources.datasets import query as run_sql


def _tables(spark, sf, *names):
    return {n: table(spark, sf, n) for n in names}


def _same(name: str, sql: str, *names: str) -> None:
    """Register a text that both engines run unchanged."""

    @query(name, sql)
    def run(spark, sf):
        return run_sql(spark, sql, tables=_tables(spark, sf, *names))


_same("sql_join_inner_left", """
SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY c_mktsegment, o_orderstatus""", "customer", "orders")
_same("sql_join_right", """
SELECT n_name, count(s_suppkey) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name""", "supplier", "nation")
_same("sql_join_full", """
SELECT s_nationkey, c_nationkey, coalesce(ns, 0) AS ns, coalesce(nc, 0) AS nc
FROM (SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) s
FULL JOIN (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c ON s_nationkey = c_nationkey""", "supplier", "customer")

query("sql_join_semi_anti", """
SELECT 'with' AS side, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 2
UNION ALL SELECT 'without', c_mktsegment, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 2""")(
    lambda spark, sf: run_sql(spark, """
SELECT 'with' AS side, c_mktsegment, count(*) AS n FROM customer LEFT SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey GROUP BY c_mktsegment
UNION ALL SELECT 'without', c_mktsegment, count(*) FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey GROUP BY c_mktsegment""",
                              tables=_tables(spark, sf, "customer", "orders")))


@query("sql_parameters", """
SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1""")
def sql_parameters(spark, sf):
    import datetime as dt

    return run_sql(
        spark,
        "SELECT o_orderpriority, count(*) AS n FROM IDENTIFIER(:t) WHERE o_orderdate >= :day AND o_orderstatus = @status AND o_totalprice > @least GROUP BY 1",
        {"t": "orders", "day": dt.date(1997, 1, 1), "status": "F", "least": 100000}, _tables(spark, sf, "orders"))


@query("sql_range_join", """
SELECT e.event_type, count(*) AS n, round(sum(e.value), 4) AS total FROM events x JOIN events e
ON e.user_id = x.user_id AND x.event_type = 'error' AND e.event_type <> 'error' AND epoch(e.ts) BETWEEN epoch(x.ts) AND epoch(x.ts) + 7200 GROUP BY 1""")
def sql_range_join(spark, sf):
    """Events within two hours after an error of the same user."""
    e = table(spark, sf, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    errors = e.where("event_type = 'error'").select("user_id", F.col("sec").alias("start"))
    others = e.where("event_type <> 'error'").select("user_id", "event_type", "value", "sec")
    out = range_join(others, errors, ["user_id"], F.col("sec"), F.col("start"), F.col("start") + 7200, 7200)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sql_asof_join", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_orderkey AS last_order FROM
  (SELECT *, l_suppkey AS k FROM lineitem) l ASOF LEFT JOIN (SELECT o_custkey AS k, o_orderdate + to_seconds(o_orderkey % 80000) AS ots, o_orderkey FROM orders) o ON l.k = o.k AND l.l_shipdate >= o.ots""")
def sql_asof_join(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("k"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice").alias("row_id"))
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 80000)).alias("ots"),
        F.col("o_orderkey").alias("last_order"))
    out = asof_join(li, o, ["k"], "l_shipdate", "ots", ["last_order"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "last_order")


_same("sql_group_having", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""", "lineitem")
_same("sql_grouping_sets", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", "lineitem")
_same("sql_rollup", """
SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)""", "orders", "customer")
_same("sql_cube", """
SELECT p_type, p_size % 5 AS size_class, count(*) AS n, round(max(p_retailprice), 2) AS top FROM part GROUP BY CUBE (p_type, p_size % 5)""", "part")
_same("sql_windows", """
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
  CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr,
  lag(o_orderkey) OVER w AS prev_key, lead(o_orderkey, 2) OVER w AS next2, CAST(ntile(4) OVER w AS BIGINT) AS quartile, first_value(o_orderkey) OVER w AS first_key,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", "orders")
_same("sql_window_filter", """
SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) t WHERE rn <= 3""", "lineitem")
_same("sql_set_union_intersect", """
SELECT o_custkey AS k, 'both' AS part FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O'
UNION ALL (SELECT c_custkey, 'none' FROM customer EXCEPT SELECT o_custkey, 'none' FROM orders)""", "orders", "customer")
_same("sql_set_all", """
SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
UNION ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""", "orders")
_same("sql_order_limit", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10""", "orders")
_same("sql_subqueries", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(total, 2) AS total FROM customer JOIN spend ON c_custkey = o_custkey
WHERE total > (SELECT avg(total) FROM spend) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P')""", "customer", "orders")
_same("sql_correlated", """
SELECT p_partkey, p_retailprice, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS n_lines FROM part WHERE p_size < 20""", "part", "lineitem")

query("sql_lateral", """
SELECT c_custkey, t.top_price, t.n FROM customer, LATERAL (SELECT max(o_totalprice) AS top_price, count(*) AS n FROM orders WHERE o_custkey = c_custkey) t WHERE t.n > 0""")(
    lambda spark, sf: run_sql(spark, """
SELECT c_custkey, t.top_price, t.n FROM customer, LATERAL (SELECT max(o_totalprice) AS top_price, count(*) AS n FROM orders WHERE o_custkey = c_custkey) t WHERE t.n > 0""",
                              tables=_tables(spark, sf, "customer", "orders")))

_RECURSIVE = """
WITH RECURSIVE top AS (SELECT max(p_size) AS m FROM part),
steps(size, depth) AS (SELECT min(p_size), 0 FROM part UNION ALL SELECT size * 2, depth + 1 FROM steps WHERE size * 2 <= (SELECT m FROM top))
SELECT s.size, s.depth, CAST(sum(c) AS BIGINT) AS n FROM steps s JOIN (SELECT p_size, count(*) AS c FROM part GROUP BY p_size) p ON p_size >= s.size GROUP BY s.size, s.depth"""


_same("sql_recursive", _RECURSIVE, "part")


@query("sql_pivot", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def sql_pivot(spark, sf):
    return run_sql(spark, """
SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F', 'O', 'P'))""",
                   tables=_tables(spark, sf, "orders"))


@query("sql_unpivot", """
SELECT l_returnflag, measure, round(sum(v), 4) AS total FROM (SELECT l_returnflag, 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2""")
def sql_unpivot(spark, sf):
    return run_sql(spark, """
SELECT l_returnflag, measure, round(sum(v), 4) AS total FROM (SELECT l_returnflag, l_quantity, l_tax FROM lineitem) UNPIVOT (v FOR measure IN (l_quantity, l_tax)) GROUP BY l_returnflag, measure""",
                   tables=_tables(spark, sf, "lineitem"))


@query("sql_approximate", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n, true AS parts_close, true AS sketch_close, true AS median_close FROM lineitem GROUP BY 1""")
def sql_approximate(spark, sf):
    """Approximate aggregates next to exact ones: counts within 10 %, the median's rank within 1 % of the rows."""
    return run_sql(spark, """
WITH approx AS (SELECT l_returnflag, approx_count_distinct(l_partkey) AS a, hll_sketch_estimate(hll_sketch_agg(l_partkey)) AS h,
  percentile_approx(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_returnflag),
exact AS (SELECT l_returnflag, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY l_returnflag),
ranks AS (SELECT l_returnflag, count(*) AS n, count_if(l_quantity < m) AS below, count_if(l_quantity <= m) AS upto
  FROM lineitem JOIN approx USING (l_returnflag) GROUP BY l_returnflag)
SELECT l_returnflag, d AS parts, n, abs(a - d) <= 0.1 * d AS parts_close, abs(h - d) <= 0.1 * d AS sketch_close,
  below <= 0.51 * n AND upto >= 0.49 * n AS median_close
FROM approx JOIN exact USING (l_returnflag) JOIN ranks USING (l_returnflag)""", tables=_tables(spark, sf, "lineitem"))


@query("sql_stored_sketches", """
WITH y AS (SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1),
p AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem),
b AS (SELECT a.l_returnflag, count(*) AS parts_in_r FROM p a JOIN p r ON a.l_partkey = r.l_partkey AND r.l_returnflag = 'R' GROUP BY 1)
SELECT l_returnflag, n, parts, coalesce(parts_in_r, 0) AS parts_in_r, true AS hll_ok, true AS theta_ok, true AS shared_ok, true AS kll_ok, true AS kll_n_ok
FROM y LEFT JOIN b USING (l_returnflag)""")
def sql_stored_sketches(spark, sf):
    """Sketches stored per flag and month, merged per flag later; their answers stand next to the exact figures.

    Distinct parts within 4 % (16,384 registers or samples: 5 standard errors), parts shared with returned lines within 4 %
    of all parts, and the rank of the median of prices within 2 % of the rows.
    """
    path = work_dir(spark, "sketches")
    run_sql(spark, """
SELECT l_returnflag, trunc(l_shipdate, 'MM') AS month, hll_sketch_agg(l_partkey, 14) AS hll, theta_sketch_agg(l_partkey, 14) AS theta,
  kll_sketch_agg_double(CAST(l_extendedprice AS DOUBLE)) AS kll FROM lineitem GROUP BY ALL""",
            tables=_tables(spark, sf, "lineitem")).write.parquet(path)
    return run_sql(spark, """
WITH flags AS (SELECT l_returnflag, hll_union_agg(hll) AS hll, theta_union_agg(theta, 14) AS theta, kll_merge_agg_double(kll) AS kll FROM stored GROUP BY 1),
told AS (SELECT l_returnflag, hll_sketch_estimate(hll) AS h, theta_sketch_estimate(theta) AS t, kll_sketch_get_n_double(kll) AS k_n,
  kll_sketch_get_quantile_double(kll, 0.5) AS m, theta FROM flags),
shared AS (SELECT l_returnflag, theta_sketch_estimate(theta_intersection(theta, (SELECT theta FROM told WHERE l_returnflag = 'R'))) AS s FROM told),
exact AS (SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1),
pairs AS (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem),
both AS (SELECT a.l_returnflag, count(*) AS parts_in_r FROM pairs a JOIN pairs r ON a.l_partkey = r.l_partkey AND r.l_returnflag = 'R' GROUP BY 1),
ranks AS (SELECT l_returnflag, count_if(l_extendedprice < m) AS below, count_if(l_extendedprice <= m) AS upto FROM lineitem JOIN told USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, n, parts, coalesce(parts_in_r, 0L) AS parts_in_r, abs(h - parts) <= 0.04 * parts AS hll_ok, abs(t - parts) <= 0.04 * parts AS theta_ok,
  coalesce(abs(s - coalesce(parts_in_r, 0L)) <= 0.04 * parts, parts_in_r IS NULL) AS shared_ok, below <= 0.52 * n AND upto >= 0.48 * n AS kll_ok, k_n = n AS kll_n_ok
FROM exact JOIN told USING (l_returnflag) JOIN ranks USING (l_returnflag) LEFT JOIN both USING (l_returnflag) LEFT JOIN shared USING (l_returnflag)""",
                   tables=_tables(spark, sf, "lineitem") | {"stored": spark.read.parquet(path)})


@query("sql_json_arrays", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS k, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS keys FROM events GROUP BY 1, 2""")
def sql_json_arrays(spark, sf):
    return run_sql(spark, """
SELECT event_type, k % 4 AS k, count(*) AS n, size(collect_set(k)) + 0L AS keys FROM (
  SELECT event_type, coalesce(variant_get(parse_json(props), '$.k', 'int'), from_json(props, 'k int').k) AS k FROM events) GROUP BY event_type, k % 4""",
                   tables=_tables(spark, sf, "events"))


@query("sql_higher_order", """
SELECT label, round(avg(s), 6) AS mean_sum, round(avg(p), 6) AS mean_positive FROM (
  SELECT vec_id, label, sum(CAST(x AS DOUBLE)) AS s, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS p FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
def sql_higher_order(spark, sf):
    return run_sql(spark, """
SELECT label, round(avg(aggregate(embedding, 0D, (a, x) -> a + x)), 6) AS mean_sum, round(avg(size(filter(embedding, x -> x > 0))), 6) AS mean_positive FROM embeddings GROUP BY label""",
                   tables=_tables(spark, sf, "embeddings"))
