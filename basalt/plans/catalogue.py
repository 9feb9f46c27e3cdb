"""The catalogue: each operator of the engine as a query on the driver's tables, beside SQL for an independent engine.

``{table}`` in a text stands for a table. Every computed column is named and cast alike on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as G
from ..functions import array_agg

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def sql(name: str, spark_text: str, oracle: str | None = None) -> None:
    """A query in the engine's language; the same text for both engines unless ``oracle`` differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..engine import over

        return over(spark, plain(spark_text), {t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", spark_text))})

    QUERIES[name] = Query(run, plain(oracle or spark_text))


def frame(name: str, oracle: str | None):
    """A query in DataFrame operations: a function of a table reader."""

    def add(fn):
        QUERIES[name] = Query(lambda spark, sf_dir: fn(lambda t: read(spark, sf_dir, t)), plain(oracle) if oracle else None)
        return fn

    return add


def engine(name: str, oracle: str | None, tables: dict[str, list[str]] | None = None):
    """A query through the engine on a fresh warehouse; ``tables`` are loaded first: name -> [source columns]."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..engine import Engine
            from ..sources.shared import shared_path
            from ..types import inferred

            e = Engine(spark, shared_path(spark, "warehouse"), "basalt-queries", "main")
            e.catalog.create_project("basalt-queries")
            e.catalog.create_dataset("basalt-queries", "main")
            for t, columns in (tables or {}).items():
                rows = read(spark, sf_dir, t).select(*columns)
                e.create_table(t, inferred(rows.schema))
                e.insert(t, rows)
            return fn(e, lambda t: read(spark, sf_dir, t))

        QUERIES[name] = Query(run, plain(oracle) if oracle else None)
        return fn

    return add


# --- scans, projections, filters -------------------------------------------------------------------

sql("scan_table", "SELECT * FROM {nation}")
sql("select_star", "SELECT * FROM {region}", "SELECT * FROM {region}")
sql("project_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM {orders}")
sql("project_except", "SELECT * EXCEPT (l_tax, l_discount) FROM {lineitem}", "SELECT * EXCLUDE (l_tax, l_discount) FROM {lineitem}")
sql("project_replace", "SELECT * REPLACE (UPPER(c_name) AS c_name) FROM {customer}", "SELECT * REPLACE (upper(c_name) AS c_name) FROM {customer}")
sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
sql("filter_compare", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 30 AND l_discount <> 0.05 AND l_shipdate < DATETIME '1996-01-01'", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 30 AND l_discount <> 0.05 AND l_shipdate < TIMESTAMP '1996-01-01'")
sql("filter_bool_chain", "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_totalprice < 1000 OR o_totalprice > 300000)")
sql("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%A%' AND p_name LIKE '_a%'")
sql("filter_not_like", "SELECT p_partkey FROM {part} WHERE p_type NOT LIKE '%A%'")
sql("filter_is_null", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS NULL AS a, (o_totalprice > 100000) IS TRUE AS b, NULLIF(o_orderstatus, 'F') IS NOT NULL AS c FROM {orders}")
sql("filter_distinct_from", "SELECT o_orderkey FROM {orders} WHERE NULLIF(o_orderstatus, 'F') IS DISTINCT FROM 'O' AND o_orderpriority IS NOT DISTINCT FROM o_orderpriority")
sql("filter_in_list", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN UNNEST([1, 3, 5, 7])", "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (1, 3, 5, 7)")
sql("filter_not_in_list", "SELECT c_custkey FROM {customer} WHERE NULLIF(c_nationkey, 2) NOT IN (1, 3, 5, 7)")
sql("filter_in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
sql("filter_not_in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
sql("filter_not_in_null_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT NULLIF(n_nationkey, 3) FROM {nation})")
sql("filter_in_unnest", "SELECT c_custkey FROM {customer} WHERE COALESCE(array_contains(array(1, 4, 9), c_nationkey), false)", "SELECT c_custkey FROM {customer} WHERE list_contains([1, 4, 9], c_nationkey)")
sql("filter_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql("filter_correlated_scalar", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT AVG(p.o_totalprice) FROM {orders} p WHERE p.o_custkey = o.o_custkey)")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(x, y)")
sql("select_constants", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS s, true AS t, CAST(NULL AS BIGINT) AS n")
sql("derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM {orders} GROUP BY o_custkey) AS d WHERE d.n > 12")

# --- expressions -----------------------------------------------------------------------------------

sql("arith_ops", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_discount AS b, l_extendedprice * (1 - l_discount) AS c, l_extendedprice / NULLIF(l_quantity, 0) AS d FROM {lineitem}")
sql("int_div_mod", "SELECT o_orderkey, CAST(o_orderkey div 7 AS BIGINT) AS q, CAST(o_orderkey % 7 AS BIGINT) AS r, CAST((0 - o_orderkey) div 7 AS BIGINT) AS nq, CAST((0 - o_orderkey) % 7 AS BIGINT) AS nr FROM {orders}", "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS q, CAST(o_orderkey % 7 AS BIGINT) AS r, CAST((0 - o_orderkey) // 7 AS BIGINT) AS nq, CAST((0 - o_orderkey) % 7 AS BIGINT) AS nr FROM {orders}")
sql("bitwise_ops", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 16 AS b, o_orderkey ^ 85 AS c, shiftleft(o_orderkey, 3) AS d, shiftright(o_orderkey, 2) AS e FROM {orders}", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 16 AS b, xor(o_orderkey, 85) AS c, o_orderkey << 3 AS d, o_orderkey >> 2 AS e FROM {orders}")
sql("string_concat", "SELECT c_custkey, c_name || '-' || c_mktsegment AS s, c_name || NULLIF(c_mktsegment, 'BUILDING') AS n FROM {customer}")
sql("unary_ops", "SELECT o_orderkey, -o_totalprice AS neg, +o_custkey AS pos, ~o_orderkey AS inv, NOT (o_totalprice > 100) AS no FROM {orders}")
sql("cast_types", "SELECT o_orderkey, CAST(ROUND(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS STRING) AS s, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS dt, CAST(o_totalprice AS DECIMAL(20,2)) AS n FROM {orders}", "SELECT o_orderkey, CAST(ROUND(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS dt, CAST(o_totalprice AS DECIMAL(20,2)) AS n FROM {orders}")
sql("safe_cast", "SELECT c_custkey, TRY_CAST(c_mktsegment AS BIGINT) AS bad, TRY_CAST(CAST(c_custkey AS STRING) AS BIGINT) AS good FROM {customer}", "SELECT c_custkey, TRY_CAST(c_mktsegment AS BIGINT) AS bad, TRY_CAST(CAST(c_custkey AS VARCHAR) AS BIGINT) AS good FROM {customer}")
sql("array_literal", "SELECT n_nationkey, array(n_nationkey, n_regionkey, 7) AS a, array(n_name) AS b FROM {nation}", "SELECT n_nationkey, [n_nationkey, n_regionkey, 7] AS a, [n_name] AS b FROM {nation}")
sql("struct_literal", "SELECT n_nationkey, named_struct('k', n_regionkey, 'name', n_name).name AS nm, named_struct('k', n_regionkey, 'name', n_name).k AS k FROM {nation}", "SELECT n_nationkey, struct_pack(k := n_regionkey, name := n_name).name AS nm, struct_pack(k := n_regionkey, name := n_name).k AS k FROM {nation}")
sql("temporal_literals", "SELECT DATE '2024-02-29' AS d, TIMESTAMP_NTZ '2024-02-29 12:34:56.789' AS dt", "SELECT DATE '2024-02-29' AS d, TIMESTAMP '2024-02-29 12:34:56.789' AS dt")
sql("decimal_literals", "SELECT CAST('1234567.891' AS DECIMAL(38,9)) AS n, CAST('0.000000000000000001' AS DECIMAL(38,18)) AS b")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice - (SELECT MIN(o_totalprice) FROM {orders}) AS over FROM {orders}")
sql("case_between", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'S' WHEN p_size BETWEEN 11 AND 30 THEN 'M' ELSE 'L' END AS size, p_size NOT BETWEEN 5 AND 40 AS odd FROM {part}")
sql("extract_parts", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(EXTRACT(QUARTER FROM o_orderdate) AS BIGINT) AS q FROM {orders}")
sql("array_subscript", "SELECT vec_id, CAST(element_at(embedding, 1) AS DOUBLE) AS first, CAST(size(embedding) AS BIGINT) AS n FROM {embeddings}", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(len(embedding) AS BIGINT) AS n FROM {embeddings}")
sql("array_subquery", "SELECT n_regionkey, array_sort(array_agg(n_name)) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(n_name)) AS names FROM {nation} GROUP BY n_regionkey")

# --- scalar functions ------------------------------------------------------------------------------

sql("fn_coalesce_ifnull_nullif_if", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS a, IFNULL(NULLIF(c_nationkey, 4), -1) AS b, IF(c_acctbal > 0, 'pos', 'neg') AS c FROM {customer}")
sql("fn_abs_ceil_floor_round", "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(CEIL(c_acctbal) AS DOUBLE) AS b, CAST(FLOOR(c_acctbal) AS DOUBLE) AS c, ROUND(c_acctbal) AS d, ROUND(c_acctbal, 1) AS e FROM {customer}")
sql("fn_lower_upper_length", "SELECT p_partkey, LOWER(p_name) AS l, UPPER(p_name) AS u, CAST(LENGTH(p_name) AS BIGINT) AS n FROM {part}")
sql("fn_array_length", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n FROM {embeddings}")
sql("fn_to_json", "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'name', NULLIF(n_name, 'NATION_1')), map('ignoreNullFields', 'false')) AS j FROM {nation}", "SELECT n_nationkey, CAST(to_json(struct_pack(k := n_nationkey, name := NULLIF(n_name, 'NATION_1'))) AS VARCHAR) AS j FROM {nation}")
frame("fn_shims", "SELECT o_orderkey, CAST(ceil(o_totalprice) AS DOUBLE) AS a, CAST(floor(o_totalprice) AS DOUBLE) AS b, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS c, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_orderkey % 3) END AS d, o_orderstatus IN ('F', 'P') AS e, CAST(to_json(o_orderstatus) AS VARCHAR) AS f FROM {orders}")(
    lambda t: t("orders").select("o_orderkey", G.ceil(F.col("o_totalprice")).alias("a"), G.floor(F.col("o_totalprice")).alias("b"), G.to_int64(F.col("o_totalprice")).alias("c"), G.safe_divide(F.col("o_totalprice"), F.col("o_orderkey") % 3).alias("d"), G.in_unnest(F.col("o_orderstatus"), F.array(F.lit("F"), F.lit(None), F.lit("P"))).alias("e"), G.to_json(F.col("o_orderstatus"), scalar=True).alias("f")))
for _part in ("MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"):
    sql(f"fn_timestamp_trunc_{_part.lower()}", f"SELECT event_id, CAST(date_trunc('{_part}', ts) AS TIMESTAMP_NTZ) AS t FROM {{events}}", f"SELECT event_id, CAST(date_trunc('{_part}', ts) AS TIMESTAMP) AS t FROM {{events}}")
for _part in ("WEEK", "MONTH", "QUARTER", "YEAR"):
    sql(f"fn_date_trunc_{_part.lower()}", f"SELECT o_orderkey, CAST(date_trunc('{_part}', o_orderdate) AS DATE) AS d FROM {{orders}}")
sql("fn_strings", "SELECT c_custkey, SUBSTRING(c_name, 2, 4) AS a, TRIM(c_mktsegment) AS b, REPLACE(c_name, 'a', 'z') AS c, CAST(INSTR(c_name, '0') AS BIGINT) AS d, REVERSE(c_mktsegment) AS e, LPAD(CAST(c_nationkey AS STRING), 4, '0') AS f, STARTSWITH(c_name, 'Cust') AS g FROM {customer}", "SELECT c_custkey, SUBSTRING(c_name, 2, 4) AS a, TRIM(c_mktsegment) AS b, REPLACE(c_name, 'a', 'z') AS c, CAST(INSTR(c_name, '0') AS BIGINT) AS d, REVERSE(c_mktsegment) AS e, LPAD(CAST(c_nationkey AS VARCHAR), 4, '0') AS f, starts_with(c_name, 'Cust') AS g FROM {customer}")
sql("fn_math", "SELECT o_orderkey, ROUND(SQRT(o_totalprice), 6) AS a, ROUND(LN(o_totalprice + 1), 6) AS b, ROUND(EXP(o_orderkey % 5), 6) AS c, ROUND(POWER(o_orderkey % 9, 2), 6) AS d, SIGN(o_totalprice - 1000) AS e, GREATEST(o_custkey, 50) AS f, LEAST(o_custkey, 50) AS g FROM {orders}", "SELECT o_orderkey, ROUND(SQRT(o_totalprice), 6) AS a, ROUND(LN(o_totalprice + 1), 6) AS b, ROUND(EXP(o_orderkey % 5), 6) AS c, ROUND(POWER(o_orderkey % 9, 2), 6) AS d, CAST(SIGN(o_totalprice - 1000) AS DOUBLE) AS e, GREATEST(o_custkey, 50) AS f, LEAST(o_custkey, 50) AS g FROM {orders}")
sql("fn_regex", "SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#') AS masked, url RLIKE '[0-9]' AS digits FROM {pages}", "SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_matches(url, '[0-9]') AS digits FROM {pages}")
sql("fn_hash", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM {documents}", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM {documents}")
sql("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k, props IS NOT NULL AS has FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS has FROM {events}")
sql("fn_date_math", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL '3' DAY AS TIMESTAMP_NTZ) AS a, CAST(datediff(DAY, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate) AS BIGINT) AS b, last_day(o_orderdate) AS c FROM {orders}", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, CAST(date_diff('day', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS BIGINT) AS b, last_day(o_orderdate) AS c FROM {orders}")
sql("fn_array", "SELECT vec_id, ROUND(CAST(aggregate(embedding, CAST(0 AS FLOAT64), (a, x) -> a + x * x) AS FLOAT64), 3) AS sq, ARRAY_LENGTH(filter(embedding, x -> x > 0)) AS pos FROM {embeddings}", "SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 3) AS sq, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS pos FROM {embeddings}")

# --- aggregates ------------------------------------------------------------------------------------

frame("agg_basic", "SELECT COUNT(*) AS n, COUNT(NULLIF(l_returnflag, 'N')) AS nn, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_extendedprice), 4) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM {lineitem}")(
    lambda t: t("lineitem").agg(F.count("*").alias("n"), F.count(F.nullif("l_returnflag", F.lit("N"))).alias("nn"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")))
frame("agg_distinct", "SELECT COUNT(DISTINCT l_suppkey) AS n, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS s, AVG(DISTINCT l_linenumber) AS a FROM {lineitem}")(
    lambda t: t("lineitem").agg(F.countDistinct("l_suppkey").alias("n"), F.sum_distinct("l_linenumber").cast("long").alias("s"), F.expr("avg(DISTINCT l_linenumber)").alias("a")))
frame("agg_group_by", """SELECT l_returnflag, l_linestatus, COUNT(*) AS count_order, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2""")(
    lambda t: t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("count_order"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc")).orderBy("l_returnflag", "l_linestatus"))
sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM {orders} GROUP BY o_custkey HAVING COUNT(*) >= 15")
sql("agg_group_by_all", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY ALL")
sql("agg_array_agg_ignore_nulls", "SELECT n_regionkey, ARRAY_AGG(NULLIF(n_name, 'NATION_1') IGNORE NULLS ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, list_sort(list(NULLIF(n_name, 'NATION_1')) FILTER (WHERE NULLIF(n_name, 'NATION_1') IS NOT NULL)) AS names FROM {nation} GROUP BY n_regionkey")
sql("agg_array_agg_respect_nulls", "SELECT n_regionkey, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 3) RESPECT NULLS)) AS n, ARRAY_LENGTH(ARRAY_AGG(NULLIF(n_nationkey, 3) IGNORE NULLS)) AS there FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, CAST(len(list(NULLIF(n_nationkey, 3))) AS BIGINT) AS n, CAST(list_count(list(NULLIF(n_nationkey, 3))) AS BIGINT) AS there FROM {nation} GROUP BY n_regionkey")
sql("agg_array_agg_distinct", "SELECT l_linestatus, SORT_ARRAY(ARRAY_AGG(DISTINCT l_returnflag)) AS flags FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, list_sort(list(DISTINCT l_returnflag)) AS flags FROM {lineitem} GROUP BY l_linestatus")
sql("agg_filter", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM {orders} GROUP BY o_orderpriority")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(GROUPING(o_orderstatus) AS BIGINT) AS g FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_statistics", "SELECT o_orderpriority, ROUND(STDDEV_SAMP(o_totalprice), 3) AS sd, ROUND(VAR_POP(o_totalprice), 0) AS vp, ROUND(CORR(o_totalprice, o_custkey), 6) AS c FROM {orders} GROUP BY o_orderpriority")
sql("agg_strings", "SELECT n_regionkey, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
sql("agg_min_max_by", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, bool_or(o_totalprice > 300000) AS big FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, (list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC))[1] AS top, bool_or(o_totalprice > 300000) AS big FROM {orders} GROUP BY o_custkey")
frame("agg_approx_distinct", None)(lambda t: t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts")))
sql("agg_percentile", "SELECT o_orderpriority, ROUND(percentile(o_totalprice, 0.5), 4) AS med, ROUND(percentile(o_totalprice, 0.9), 4) AS p90 FROM {orders} GROUP BY o_orderpriority", "SELECT o_orderpriority, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS med, ROUND(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM {orders} GROUP BY o_orderpriority")
sql("agg_pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM {orders} GROUP BY o_orderpriority")


def _respecting(nation: DataFrame) -> DataFrame:
    held = nation.groupBy("n_regionkey").agg(array_agg(F.nullif("n_nationkey", F.lit(3)), respect_nulls=True).alias("a"))
    return held.select("n_regionkey", F.size("a").cast("long").alias("n"), F.size(F.filter("a", lambda x: x.isNotNull())).cast("long").alias("there"))


# --- joins -----------------------------------------------------------------------------------------

sql("join_inner", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 250000")
sql("join_right", "SELECT c_custkey, n_name FROM {customer} RIGHT JOIN {nation} ON c_nationkey = n_nationkey")
sql("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_comma", "SELECT n_name, r_name FROM {nation}, {region} WHERE n_regionkey = r_regionkey")
sql("join_using", "SELECT doc_id, lang, quality FROM {documents} JOIN {labels} USING (doc_id)")
sql("join_natural", "SELECT doc_id, source, toxic FROM {documents} NATURAL JOIN {labels}")
sql("join_theta_range", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey >= b.n_regionkey")
sql("join_semi", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders})")
sql("join_anti", "SELECT c_custkey FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})")
sql("join_unnest_lateral", "SELECT vec_id, CAST(x AS FLOAT64) AS x FROM {embeddings}, UNNEST(embedding) AS x", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM {embeddings}")
sql("join_star_5way", "SELECT r_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")
_ASOF = "SELECT e.event_id, p.value AS last_value FROM {events} e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM {events} WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts"


@frame("join_asof", _ASOF)
def _asof(t):
    from ..operators.joins import asof

    events = t("events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value")).select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    return asof(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "at", ["last_value"]).select("event_id", "last_value")


@frame("join_range", "SELECT o_orderkey, lo FROM {orders} JOIN (SELECT CAST(p_partkey * 1000 AS DOUBLE) AS lo, CAST(p_partkey * 1000 + 500 AS DOUBLE) AS hi FROM {part}) b ON o_totalprice >= lo AND o_totalprice < hi")
def _range(t):
    from ..operators.joins import in_range

    bands = t("part").select((F.col("p_partkey") * 1000.0).alias("lo"), (F.col("p_partkey") * 1000.0 + 500.0).alias("hi"))
    return in_range(t("orders").select("o_orderkey", "o_totalprice"), bands, F.col("o_totalprice"), F.col("lo"), F.col("hi"), 500.0).select("o_orderkey", "lo")


# --- windows ---------------------------------------------------------------------------------------

sql("win_rank_family", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, ROUND(percent_rank() OVER v, 6) AS pr, ROUND(cume_dist() OVER v, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
sql("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, 0.0) OVER w AS b, first_value(o_orderkey) OVER w AS c, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
frame("win_running_sum", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mov FROM {orders}")(
    lambda t: t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(_by_customer().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("run"), F.round(F.avg("o_totalprice").over(_by_customer().rowsBetween(-2, 0)), 4).alias("mov")))
sql("win_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {orders}")


def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@frame("win_qualify_topn", "SELECT o_custkey, o_orderkey, o_totalprice FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def _topn(t):
    from ..operators.joins import top_per_group

    return top_per_group(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)


# --- sorting, sets, CTEs ---------------------------------------------------------------------------

sql("order_nulls", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM {customer} ORDER BY seg ASC NULLS LAST, c_custkey DESC NULLS FIRST")
sql("limit_offset", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 25 OFFSET 10")
sql("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION DISTINCT SELECT s_nationkey FROM {supplier}", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
frame("union_by_name", "SELECT n_name AS name, n_nationkey AS k FROM {nation} UNION ALL BY NAME SELECT r_regionkey AS k, r_name AS name FROM {region}")(lambda t: t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")).unionByName(t("region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))))
sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT DISTINCT SELECT s_nationkey FROM {supplier}", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("except", "SELECT c_custkey AS k FROM {customer} EXCEPT DISTINCT SELECT o_custkey FROM {orders}", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql("cte", "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT k, n FROM a WHERE n > 10) SELECT b.k, b.n, c.c_name FROM b JOIN {customer} c ON c.c_custkey = b.k")
sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")
sql("pipe_syntax", "FROM {orders} |> WHERE o_totalprice > 100000 |> AGGREGATE COUNT(*) AS n GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY o_orderstatus")

# --- the language where it differs from Spark's ------------------------------------------------------

sql("lit_strings_like_operators", "SELECT r_name, 'a UNION DISTINCT b' AS v, \"it's EXCEPT DISTINCT\" AS w FROM {region} UNION DISTINCT SELECT r_name, 'x INTERSECT DISTINCT y', r'\\d' FROM {region}", "SELECT r_name, 'a UNION DISTINCT b' AS v, 'it''s EXCEPT DISTINCT' AS w FROM {region} UNION SELECT r_name, 'x INTERSECT DISTINCT y', '\\d' FROM {region}")
sql("lit_typed_array_struct", "SELECT n_nationkey, ARRAY<INT64>[n_regionkey, 7] AS a, ARRAY_LENGTH(ARRAY<STRING>[]) AS none, STRUCT<x INT64, y STRING>(n_nationkey, n_name).y AS y FROM {nation}", "SELECT n_nationkey, [CAST(n_regionkey AS BIGINT), 7] AS a, CAST(0 AS BIGINT) AS none, n_name AS y FROM {nation}")
sql("unnest_left", "SELECT o.o_orderkey, part FROM (SELECT o_orderkey, IF(o_orderstatus = 'F', ARRAY<STRING>[], SPLIT(o_orderpriority, '-')) AS parts FROM {orders}) AS o LEFT JOIN UNNEST(o.parts) AS part", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE part END AS part FROM (SELECT o_orderkey, o_orderstatus, unnest(CASE WHEN o_orderstatus = 'F' THEN ['x'] ELSE string_split(o_orderpriority, '-') END) AS part FROM {orders})")
sql("unnest_with_offset", "SELECT vec_id, place, CAST(x AS FLOAT64) AS x FROM {embeddings}, UNNEST(embedding) AS x WITH OFFSET AS place", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM {embeddings}")
sql("array_subscripts", "SELECT vec_id, CAST(embedding[OFFSET(0)] AS FLOAT64) AS a, CAST(embedding[ORDINAL(2)] AS FLOAT64) AS b, embedding[SAFE_OFFSET(100000)] IS NULL AS c FROM {embeddings}", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, TRUE AS c FROM {embeddings}")
sql("array_of_subquery", "SELECT vec_id, ARRAY_LENGTH(ARRAY(SELECT x FROM UNNEST(embedding) AS x WHERE x > 0)) AS n FROM {embeddings}", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n FROM {embeddings}")
sql("to_json_nulls", "SELECT o_orderkey, TO_JSON(STRUCT(o_orderkey AS k, NULLIF(o_orderstatus, 'O') AS s)) AS j, TO_JSON(o_custkey) AS c, TO_JSON(o_orderstatus) AS t FROM {orders}", "SELECT o_orderkey, '{\"k\":' || o_orderkey || ',\"s\":' || CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' AS j, CAST(o_custkey AS VARCHAR) AS c, '\"' || o_orderstatus || '\"' AS t FROM {orders}")
sql("agg_countif_logical", "SELECT o_custkey, COUNTIF(o_totalprice > 150000) AS n, LOGICAL_OR(o_orderstatus = 'P') AS some, LOGICAL_AND(o_totalprice > 20000) AS every FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 150000) AS n, bool_or(o_orderstatus = 'P') AS some, bool_and(o_totalprice > 20000) AS every FROM {orders} GROUP BY o_custkey")
sql("agg_array_agg_order_limit", "SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 3) AS best FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC), 1, 3) AS best FROM {orders} GROUP BY o_custkey")
sql("fn_regexp_contains", "SELECT doc_id, REGEXP_CONTAINS(text, r'[0-9][0-9][0-9]') AS digits, STARTS_WITH(source, 's') AS s, STRPOS(text, 'the') AS at FROM {documents}", "SELECT doc_id, regexp_matches(text, '[0-9][0-9][0-9]') AS digits, starts_with(source, 's') AS s, CAST(strpos(text, 'the') AS BIGINT) AS at FROM {documents}")
sql("fn_date_arithmetic", "SELECT o_orderkey, DATE_ADD(DATE(o_orderdate), INTERVAL 1 MONTH) AS a, DATE_SUB(DATE(o_orderdate), INTERVAL 10 DAY) AS b, DATE_DIFF(DATE '1999-01-01', DATE(o_orderdate), DAY) AS d, DATE_DIFF(DATE '1999-01-01', DATE(o_orderdate), MONTH) AS m, EXTRACT(YEAR FROM o_orderdate) AS y FROM {orders}", "SELECT o_orderkey, CAST(o_orderdate::DATE + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate::DATE - INTERVAL 10 DAY AS DATE) AS b, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS d, date_diff('month', o_orderdate::DATE, DATE '1999-01-01') AS m, EXTRACT(YEAR FROM o_orderdate) AS y FROM {orders}")
sql("select_as_struct", "SELECT TO_JSON(ARRAY(SELECT AS STRUCT n_nationkey AS k, n_name AS n FROM {nation} ORDER BY n_nationkey)) AS j", "SELECT '[' || string_agg('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS j FROM {nation}")

# --- the engine: statements on versioned tables ----------------------------------------------------

_ORDERS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]}
_SMALL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM {orders}"


@engine("sql_backticks_qualify", "SELECT o_custkey, o_orderkey FROM {orders} WHERE o_orderstatus IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1", _ORDERS)
def _backticks(e, t):
    return e.query('SELECT o_custkey, o_orderkey FROM `basalt-queries.main.orders` WHERE o_orderstatus IN UNNEST(["F", "O"]) QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1')


@engine("sql_casts", "SELECT o_orderkey, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS i, CAST(ceil(o_totalprice) AS DOUBLE) AS c, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM {orders}", _ORDERS)
def _casts(e, t):
    return e.query("SELECT o_orderkey, CAST(o_totalprice AS INT64) AS i, CEIL(o_totalprice) AS c, DATE_TRUNC(o_orderdate, MONTH) AS m FROM orders")


@engine("result_anonymous_names", "SELECT COUNT(*) AS f0_, MAX(o_orderkey) AS f1_, MIN(o_custkey) AS low FROM {orders}", _ORDERS)
def _names(e, t):
    return e.query("SELECT COUNT(*), MAX(o_orderkey), MIN(o_custkey) AS low FROM orders")


@engine("dml_insert", "SELECT r_regionkey, r_name FROM {region} UNION ALL SELECT * FROM (VALUES (100, 'NORTH'), (101, NULL))")
def _insert(e, t):
    e.create_table("region", [{"name": "r_regionkey", "type": "INT64"}, {"name": "r_name", "type": "STRING"}])
    e.insert("region", t("region"))
    e.query("INSERT INTO region (r_regionkey, r_name) VALUES (100, 'NORTH'), (101, NULL)")
    return e.table("region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@engine("dml_insert_select", _SMALL + " UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice, o_orderdate FROM {orders} WHERE o_orderstatus = 'F'", _ORDERS)
def _insert_select(e, t):
    e.query("INSERT INTO orders SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
    return e.table("orders")


@engine("dml_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 200000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM {orders}", _ORDERS)
def _update(e, t):
    e.query("UPDATE orders SET o_orderstatus = 'BIG', o_totalprice = o_totalprice * 2 WHERE o_totalprice > 200000")
    return e.table("orders")


@engine("dml_update_from", "SELECT c_custkey, COALESCE(n_name, c_mktsegment) AS c_mktsegment, c_nationkey FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey AND n_regionkey = 2", {"customer": ["c_custkey", "c_mktsegment", "c_nationkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"]})
def _update_from(e, t):
    e.query("UPDATE customer c SET c_mktsegment = n.n_name FROM nation AS n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 2")
    return e.table("customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@engine("dml_delete", _SMALL + " WHERE NOT (o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) AND o_orderstatus = 'O')", _ORDERS | {"customer": ["c_custkey", "c_acctbal"]})
def _delete(e, t):
    e.query("DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus = 'O'")
    return e.table("orders")


@engine("dml_merge_upsert", """SELECT o_orderkey, o_custkey, 'M' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'I', o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey % 5 = 0""", _ORDERS)
def _upsert(e, t):
    orders = t("orders").select(*_ORDERS["orders"])
    fresh = orders.where("o_orderkey % 3 = 0").unionByName(orders.where("o_orderkey % 5 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000))
    from ..types import inferred

    e.create_table("fresh", inferred(fresh.schema))
    e.insert("fresh", fresh)
    e.query("MERGE INTO orders AS o USING fresh AS f ON o.o_orderkey = f.o_orderkey WHEN MATCHED THEN UPDATE SET o_orderstatus = 'M', o_totalprice = o.o_totalprice + 1 WHEN NOT MATCHED THEN INSERT (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate) VALUES (f.o_orderkey, f.o_custkey, 'I', f.o_totalprice, f.o_orderdate)")
    return e.table("orders")


@engine("dml_merge_by_source", """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN 'ODD' ELSE c_mktsegment END AS c_mktsegment FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3) OR c_acctbal >= 0""", {"customer": ["c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal"], "nation": ["n_nationkey", "n_regionkey"]})
def _by_source(e, t):
    e.query("MERGE customer c USING (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) n ON c.c_nationkey = n.n_nationkey WHEN NOT MATCHED BY SOURCE AND c.c_acctbal < 0 THEN DELETE WHEN NOT MATCHED BY SOURCE AND MOD(c.c_nationkey, 2) = 1 THEN UPDATE SET c_mktsegment = 'ODD' WHEN MATCHED AND MOD(c.c_nationkey, 2) = 1 THEN UPDATE SET c_mktsegment = 'ODD'")
    return e.table("customer").select("c_custkey", "c_mktsegment")


@engine("ddl_create_drop", "SELECT CAST(0 AS BIGINT) AS n, true AS gone")
def _create_drop(e, t):
    from ..errors import NotFound

    e.query("CREATE TABLE made (id INT64 NOT NULL, amount NUMERIC(10,2), tags ARRAY<STRING>, at TIMESTAMP, who STRUCT<name STRING, age INT64>)")
    n = e.table("made").count()
    e.query("DROP TABLE made")
    try:
        e.table("made")
        gone = False
    except NotFound:
        gone = True
    return e.spark.createDataFrame([(n, gone)], "n long, gone boolean")


@engine("ddl_add_column", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS note FROM {orders}", _ORDERS)
def _add(e, t):
    e.query("ALTER TABLE orders ADD COLUMN note STRING")
    e.query("UPDATE orders SET note = 'even' WHERE MOD(o_orderkey, 2) = 0")
    return e.table("orders").select("o_orderkey", "note")


@engine("ddl_rename_column", "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM {orders}", _ORDERS)
def _rename(e, t):
    e.query("ALTER TABLE orders RENAME COLUMN o_orderkey TO id")
    return e.table("orders")


@engine("ddl_drop_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM {orders}", _ORDERS)
def _drop(e, t):
    e.query("ALTER TABLE orders DROP COLUMN o_totalprice")
    return e.table("orders")


@engine("ddl_set_type", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(20,2)) AS o_totalprice FROM {orders}", _ORDERS)
def _set_type(e, t):
    e.query("ALTER TABLE orders ALTER COLUMN o_totalprice SET DATA TYPE NUMERIC(20,2)")
    return e.table("orders").select("o_orderkey", "o_totalprice")


@engine("ddl_truncate", "SELECT COUNT(*) AS n FROM {orders} WHERE false", _ORDERS)
def _truncate(e, t):
    e.query("TRUNCATE TABLE orders")
    return e.table("orders").agg(F.count("*").alias("n"))


@engine("overwrite_static", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM {orders} WHERE o_orderstatus = 'P'", _ORDERS)
def _static(e, t):
    e.query("MERGE orders d USING (SELECT * FROM orders WHERE o_orderstatus = 'P') s ON FALSE WHEN NOT MATCHED THEN INSERT ROW WHEN NOT MATCHED BY SOURCE THEN DELETE")
    return e.table("orders")


def _dynamic(part: str):
    trunc = part.lower()
    touched = f"SELECT DISTINCT date_trunc('{trunc}', o_orderdate) FROM {{orders}} WHERE o_orderkey % 97 = 0"
    oracle = f"SELECT o_orderkey, o_orderdate, 'old' AS origin FROM {{orders}} WHERE date_trunc('{trunc}', o_orderdate) NOT IN ({touched}) UNION ALL SELECT o_orderkey, o_orderdate, 'new' FROM {{orders}} WHERE o_orderkey % 97 = 0 UNION ALL SELECT -1, NULL, 'old' UNION ALL SELECT -2, NULL, 'new'"

    @engine(f"overwrite_dynamic_{trunc}", oracle)
    def run(e, t):
        rows = t("orders").select("o_orderkey", "o_orderdate", F.lit("old").alias("origin"))
        none = e.spark.createDataFrame([(-1, "old"), (-2, "new")], "o_orderkey long, origin string").select("o_orderkey", F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), "origin")
        e.create_table("dyn", [{"name": "o_orderkey", "type": "INT64"}, {"name": "o_orderdate", "type": "DATETIME"}, {"name": "origin", "type": "STRING"}], time_partitioning={"type": part, "field": "o_orderdate"})
        e.insert("dyn", rows.unionByName(none.where("origin = 'old'")))
        e.overwrite_partitions("dyn", rows.where("o_orderkey % 97 = 0").withColumn("origin", F.lit("new")).unionByName(none.where("origin = 'new'")))
        return e.table("dyn")


for _part in ("HOUR", "DAY", "MONTH", "YEAR"):
    _dynamic(_part)


@engine("dest_write_append", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O'", _ORDERS)
def _append(e, t):
    e.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", destination="kept")
    return e.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", destination="kept", write="WRITE_APPEND")


@engine("dest_write_truncate", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O'", _ORDERS)
def _dest_truncate(e, t):
    e.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", destination="kept")
    return e.query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'", destination="kept", write="WRITE_TRUNCATE")


@engine("dest_write_empty", "SELECT COUNT(*) AS n, true AS refused FROM {orders} WHERE o_orderstatus = 'F'", _ORDERS)
def _dest_empty(e, t):
    from ..errors import AlreadyExists

    e.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", destination="kept")
    try:
        e.query("SELECT o_orderkey FROM orders", destination="kept", write="WRITE_EMPTY")
        refused = False
    except AlreadyExists:
        refused = True
    return e.table("kept").agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


@engine("tabledata_page", "SELECT CAST(k AS VARCHAR) AS k FROM (SELECT n_nationkey AS k FROM {nation} ORDER BY n_nationkey LIMIT 7 OFFSET 5)")
def _page(e, t):
    e.create_table("ordered", [{"name": "k", "type": "INT64"}])
    e.insert("ordered", t("nation").select(F.col("n_nationkey").alias("k")).orderBy("k"))
    rows = e.table_page("ordered", 5, 7)
    return e.spark.createDataFrame([(r["f"][0]["v"],) for r in rows], "k string")


def _exported(e, t):
    from ..sources.shared import shared_path

    path = shared_path(e.spark, "export")
    t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.parquet(path)
    return f"{path}/*.parquet"


@engine("load_parquet_append", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} UNION ALL SELECT 0, 0, 'X'")
def _load_append(e, t):
    e.query("CREATE TABLE loaded (o_orderkey INT64 NOT NULL, o_custkey INT64, o_orderstatus STRING)")
    e.query("INSERT INTO loaded VALUES (0, 0, 'X')")
    e.load("loaded", [_exported(e, t)])
    return e.table("loaded")


@engine("load_parquet_truncate", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders}")
def _load_truncate(e, t):
    e.query("CREATE TABLE loaded (o_orderkey INT64 NOT NULL, o_custkey INT64, o_orderstatus STRING)")
    e.query("INSERT INTO loaded VALUES (0, 0, 'X')")
    e.load("loaded", [_exported(e, t)], write="WRITE_TRUNCATE")
    return e.table("loaded")


def _load_text(kind: str, name: str):
    @engine(name, "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders}")
    def run(e, t):
        from ..sources.shared import shared_path

        path = shared_path(e.spark, "export")
        rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        {"CSV": rows.write.csv, "NEWLINE_DELIMITED_JSON": rows.write.json, "ORC": rows.write.orc}[kind](path)
        e.query("CREATE TABLE loaded (o_orderkey INT64, o_custkey INT64, o_orderstatus STRING)")
        e.load("loaded", [f"{path}/part-*"], kind)
        return e.table("loaded")


for _kind, _name in (("CSV", "load_csv"), ("NEWLINE_DELIMITED_JSON", "load_json"), ("ORC", "load_orc")):
    _load_text(_kind, _name)


@engine("read_session_projection", "SELECT o_orderkey, o_totalprice FROM {orders}", _ORDERS)
def _projection(e, t):
    s = e.read_session("orders", ["o_totalprice", "o_orderkey"], streams=3)
    return _together([e.reader.frame(x.name) for x in s.streams])


@engine("read_session_restriction", "SELECT o_orderkey FROM {orders} WHERE (o_totalprice >= 100000.5 AND o_orderstatus <> 'P') OR NOT (o_custkey > 10 OR o_orderstatus IS NULL)", _ORDERS)
def _restriction(e, t):
    s = e.read_session("orders", ["o_orderkey"], "(o_totalprice >= 100000.5 AND o_orderstatus != 'P') OR NOT (o_custkey > 10 OR o_orderstatus IS NULL)")
    return _together([e.reader.frame(x.name) for x in s.streams])


@engine("read_stream_ranges", "SELECT CAST(25 AS BIGINT) AS total, CAST(4 AS BIGINT) AS streams, CAST(7 AS BIGINT) AS largest, n_nationkey AS k FROM {nation} WHERE n_nationkey BETWEEN 9 AND 12")
def _ranges(e, t):
    e.create_table("ordered", [{"name": "k", "type": "INT64"}])
    e.insert("ordered", t("nation").select(F.col("n_nationkey").alias("k")).orderBy("k"))
    s = e.read_session("ordered", streams=4)
    rest = e.reader.frame(s.streams[1].name, 2)
    return rest.select(F.lit(s.rows).cast("long").alias("total"), F.lit(len(s.streams)).cast("long").alias("streams"), F.lit(max(x.rows for x in s.streams)).cast("long").alias("largest"), F.col("k").cast("int").alias("k"))


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@engine("write_stream_commit", "SELECT o_orderkey, o_orderstatus FROM {orders}")
def _commit(e, t):
    e.query("CREATE TABLE streamed (o_orderkey INT64, o_orderstatus STRING)")
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    names = [e.write_stream("streamed") for _ in range(2)]
    for k, name in enumerate(names):
        for half in range(2):
            part = rows.where(f"o_orderkey % 4 = {2 * k + half}")
            at = e.writer.append(name, part)
            e.writer.append(name, part, at)  # the same again has no effect
        e.writer.finalize(name)
    e.writer.commit(e.ref("streamed"), names)
    e.writer.commit(e.ref("streamed"), names)  # nor has this
    return e.table("streamed")


@engine("write_stream_default", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus <> 'P'")
def _default(e, t):
    e.query("CREATE TABLE streamed (o_orderkey INT64, o_orderstatus STRING)")
    for status in ("F", "O"):
        e.writer.append_default(e.ref("streamed"), t("orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderstatus"))
    return e.table("streamed")


def _rounding(name: str, mode: str, oracle: str):
    @engine(name, oracle)
    def run(e, t):
        e.create_table("money", [{"name": "k", "type": "INT64"}, {"name": "amount", "type": "NUMERIC", "precision": 20, "scale": 1, "rounding": mode}])
        e.insert("money", t("orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 1000 - 500).cast("decimal(18,2)") * F.lit("0.05").cast("decimal(3,2)")).cast("decimal(18,2)").alias("amount")))
        return e.table("money")


_rounding("decimal_round_half_away", "ROUND_HALF_AWAY_FROM_ZERO", "SELECT o_orderkey AS k, CAST(ROUND(CAST((o_orderkey % 1000 - 500) AS DECIMAL(18,2)) * 0.05, 1) AS DECIMAL(20,1)) AS amount FROM {orders}")
_rounding("decimal_round_half_even", "ROUND_HALF_EVEN", "SELECT o_orderkey AS k, CAST(CAST(round_even(CAST((o_orderkey % 1000 - 500) AS DOUBLE) / 2, 0) AS BIGINT) AS DECIMAL(20,1)) / CAST(10 AS DECIMAL(3,0)) AS amount FROM {orders}")


@engine("schema_evolve_nested", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS BIGINT) AS rank FROM {nation} UNION ALL SELECT 100, 'new', 7")
def _evolve(e, t):
    old = [{"name": "id", "type": "INT64"}, {"name": "who", "type": "RECORD", "fields": [{"name": "name", "type": "STRING"}]}]
    new = [old[0], {"name": "who", "type": "RECORD", "fields": [{"name": "name", "type": "STRING"}, {"name": "rank", "type": "INT64"}]}]
    e.create_table("nested", old)
    e.insert("nested", t("nation").select(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("name")).alias("who")))
    e.catalog.update_table(e.ref("nested"), new)
    e.query("INSERT INTO nested SELECT 100, NAMED_STRUCT('name', 'new', 'rank', 7)")
    return e.table("nested").select(F.col("id").cast("int").alias("id"), "who.name", "who.rank")


# --- event time ------------------------------------------------------------------------------------


def _streamed(name: str, oracle: str, body):
    """The events as a bounded stream, run to its end."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..sources.shared import shared_path
        from ..streaming.events import drained

        source = shared_path(spark, "stream")
        events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        events.write.parquet(f"{source}/in")
        # A last row far ahead moves the watermark past every window; its own never closes.
        last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
        last.write.mode("append").parquet(f"{source}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{source}/in")
        return drained(body(stream), f"{source}/out", f"{source}/state")

    QUERIES[name] = Query(run, plain(oracle))


def _windowed(length: str, slide: str | None):
    from ..streaming.events import windowed

    return lambda s: windowed(s, "ts", "1 hour", length, slide, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v")]).withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz")})


def _sessions(s: DataFrame) -> DataFrame:
    from ..streaming.events import sessions

    return sessions(s, "ts", "1 hour", "30 minutes", ["user_id"], [F.count("*").alias("n")]).withColumns({"session_start": F.col("session_start").cast("timestamp_ntz"), "session_end": F.col("session_end").cast("timestamp_ntz")})


def _deduplicated(s: DataFrame) -> DataFrame:
    from ..streaming.events import deduplicated

    return deduplicated(s.where("event_type <> 'end'"), "ts", "400 days", ["user_id", "event_type"]).select("user_id", "event_type")


_streamed("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS v FROM {events} GROUP BY ALL", _windowed("1 hour", None))
_streamed("stream_sliding", "SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS v FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM {events}) GROUP BY ALL", _windowed("2 hours", "1 hour"))
_streamed("stream_session", "SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n FROM (SELECT *, SUM(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {events})) GROUP BY user_id, s", _sessions)
_streamed("stream_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM {events}", _deduplicated)


@engine("stream_sink_exactly_once", "SELECT event_id, event_type FROM {events}")
def _sink(e, t):
    from ..sources.shared import shared_path

    e.query("CREATE TABLE sunk (event_id INT64, event_type STRING)")
    source = shared_path(e.spark, "stream")
    events = t("events").select("event_id", "event_type")
    events.repartition(4).write.parquet(f"{source}/in")
    write = e.writer.sink(e.ref("sunk"), "events")

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)  # as after a lost acknowledgement

    stream = e.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{source}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start().awaitTermination()
    return e.table("sunk")

