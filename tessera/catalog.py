"""Queries by name, one for each operator and semantic decision, with SQL for an independent engine beside each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import functions as X, streaming
from .plans import EngineContext, Frame
from .storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events".split()


def _verbs(name: str, oracle: str) -> Callable[[Callable[..., Frame]], Callable[..., Frame]]:
    """Registers a query over frames: the function gets ``t``, from a table's name to its frame."""

    def add(build: Callable[..., Frame]) -> Callable[..., Frame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ctx = EngineContext(spark)
            return build(lambda table: ctx.parquet(f"{sf_dir}/{table}.parquet")).df

        QUERIES[name], ORACLE_SQL[name] = run, oracle
        return build

    return add


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query in the engine's SQL; its oracle is the same text unless the engines differ in a spelling."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = EngineContext(spark)
        for table in TABLES:
            if table in text:
                ctx.register_parquet(table, f"{sf_dir}/{table}.parquet")
        return ctx.sql(text).df

    QUERIES[name], ORACLE_SQL[name] = run, oracle or text


c, lit = X.col, X.lit

# --- scans ---
_verbs("scan_parquet", "SELECT * FROM nation")(lambda t: t("nation"))
_verbs("scan_projection", "SELECT l_orderkey, l_quantity FROM lineitem")(lambda t: t("lineitem").project(["l_orderkey", "l_quantity"]))


def _written(df: DataFrame, label: str, kind: str = "csv", **options: object) -> str:
    """Writes a frame to the shared folder, as many files as it has partitions."""
    path = scratch(df.sparkSession, label)
    df.write.options(**options).format(kind).save(path)
    return path


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes customers as delimited text to the shared folder and reads them back, all strings."""
    ctx = EngineContext(spark)
    path = _written(ctx.parquet(f"{sf_dir}/customer.parquet").project(["c_custkey", "c_name", "c_mktsegment"]).df, "csv", header=True)
    return ctx.csv(path).project(["c_custkey", "c_name", X.cast(c("c_custkey"), "int64").alias("key_as_long")]).df


QUERIES["scan_csv_all_string"] = _csv_round_trip
ORACLE_SQL["scan_csv_all_string"] = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_custkey AS key_as_long FROM customer"


def _memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    ctx = EngineContext(spark)
    return ctx.memory(pa.table({"k": ["a", "b", None], "v": [1, None, 3]})).filter(c("v") >= 1).df


QUERIES["scan_memory_filtered"] = _memory_source
ORACLE_SQL["scan_memory_filtered"] = "SELECT * FROM (VALUES ('a', CAST(1 AS BIGINT)), (NULL, CAST(3 AS BIGINT))) AS t(k, v)"



def _query(name: str, oracle: str) -> Callable[[Query], Query]:
    """Registers a query that is a function of the session and the folder of the tables."""

    def add(run: Query) -> Query:
        QUERIES[name], ORACLE_SQL[name] = run, oracle
        return run

    return add


@_query("scan_csv_tabs_no_header", "SELECT CAST(n_nationkey AS VARCHAR) AS field_1, n_name AS field_2, NULLIF(n_regionkey, 1) AS region FROM nation")
def _tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter told from the head, names by position, empty fields null."""
    ctx = EngineContext(spark)
    rows = ctx.sql(f"SELECT n_nationkey, n_name, NULLIF(n_regionkey, 1) AS k FROM parquet.`{sf_dir}/nation.parquet`")
    return ctx.csv(_written(rows.df, "tsv", sep="\t"), header=False).project(["field_1", "field_2", X.cast(c("field_3"), "int32").alias("region")]).df


@_query("scan_csv_odd_delimiter", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def _colons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    return ctx.csv(_written(ctx.parquet(f"{sf_dir}/region.parquet").project(["r_regionkey", "r_name"]).df, "colons", sep=":", header=True)).df


@_query("scan_csv_quoted_and_empty", "SELECT n_nationkey, 'a \"b\", ' || n_name AS quoted, CAST(NULL AS VARCHAR) AS nothing FROM nation")
def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    rows = ctx.sql(f"SELECT n_nationkey, concat('a \"b\", ', n_name) AS quoted, '' AS nothing FROM parquet.`{sf_dir}/nation.parquet`")
    path = _written(rows.df, "quoted", header=True, quote='"', escape='"')
    return ctx.csv(path, sep=",").project([X.cast(c("n_nationkey"), "int32"), "quoted", "nothing"]).df


@_query("scan_csv_filtered_with_schema", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_custkey < 500")
def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    path = _written(ctx.parquet(f"{sf_dir}/customer.parquet").project(["c_custkey", "c_name", "c_acctbal"]).df, "typed", header=True)
    frame = ctx.csv(path, schema="c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")
    return frame.filter((c("c_acctbal") > 1000.0) & (c("c_custkey") < 500)).project(["c_custkey", "c_acctbal"]).df


@_query("scan_parquet_folder", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    path = _written(ctx.parquet(f"{sf_dir}/orders.parquet").df.repartition(3), "folder", "parquet")
    return ctx.parquet(path).filter(c("o_totalprice") > 100000.0).project(["o_orderkey", "o_totalprice"]).df


class Squares:
    """An own source: numbers and their squares, in two splits. The filter bounds what the scan makes."""

    splits = 2

    def schema(self) -> str:
        return "n BIGINT, square BIGINT, name STRING"

    def scan(self, projection, filters, split=0):
        import pyarrow as pa

        most = min([100, *(f.value for f in filters if f.column == "n" and f.sign == "<")])
        n = list(range(split, most, 2))
        yield pa.record_batch({"n": pa.array(n, pa.int64()), "square": pa.array([k * k for k in n], pa.int64()), "name": pa.array([f"n{k}" for k in n], pa.string())})


@_query("scan_own_source", "SELECT range * range AS square, range AS n FROM range(40) WHERE range >= 10")
def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EngineContext(spark).source(Squares(), ["square", "n"]).filter((c("n") < 40) & (c("n") >= 10)).df


# --- sinks: what a result gives, as a frame again ---
@_query("sink_batches", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 200000")
def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark, {"csv.batch_size": 100})
    frame = ctx.parquet(f"{sf_dir}/orders.parquet").filter(c("o_totalprice") > 200000.0).project(["o_orderkey", "o_orderstatus"])
    return ctx.batches(ctx.execute_batches(frame), frame.schema()).df


@_query("sink_csv_text", "SELECT 'r_regionkey,r_name' AS line UNION ALL SELECT r_regionkey || ',' || r_name FROM region")
def _csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    text = ctx.execute(ctx.parquet(f"{sf_dir}/region.parquet").project(["r_regionkey", "r_name"])).to_csv()
    return ctx.memory([(line,) for line in text.splitlines()], "line string").df


@_query("sink_collect_limit", "SELECT 3 AS collected, 5 AS shown, 25 AS rows, CAST(25 AS BIGINT) AS scalar, 25 AS pandas, 25 AS iterated")
def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    result = ctx.execute(ctx.parquet(f"{sf_dir}/nation.parquet"))
    count = ctx.execute(ctx.parquet(f"{sf_dir}/nation.parquet").aggregate([], [X.count_rows()]))
    found = (len(result.collect(3)), len(result.to_markdown(3).splitlines()), len(result), count.scalar(), len(result.to_pandas()), sum(1 for _ in result))
    return ctx.memory([found], "collected int, shown int, rows int, scalar bigint, pandas int, iterated int").df


# --- filters ---
_KEEP = ["l_orderkey", "l_linenumber", "l_quantity"]
for _name, _op, _text in (("gt", X.gt, ">"), ("gteq", X.gteq, ">="), ("lt", X.lt, "<"), ("lteq", X.lteq, "<="), ("neq", X.neq, "<>"), ("eq", X.eq, "=")):
    _verbs(f"filter_{_name}", f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_text} 25")(lambda t, op=_op: t("lineitem").filter(op(c("l_quantity"), 25.0)).project(_KEEP))
_verbs("filter_eq_string", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda t: t("customer").filter(c("c_mktsegment") == "BUILDING").project(["c_custkey"]))
_verbs("filter_and", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R'")(lambda t: t("lineitem").filter((c("l_quantity") > 10.0) & (c("l_returnflag") == "R")).project(_KEEP))
_verbs("filter_or", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 OR l_returnflag = 'R'")(lambda t: t("lineitem").filter((c("l_quantity") > 45.0) | (c("l_returnflag") == "R")).project(_KEEP))
_verbs("filter_not", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'R')")(lambda t: t("lineitem").filter(~(c("l_returnflag") == "R")).project(_KEEP))
_verbs("filter_three_valued", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NULLIF(l_linenumber, 1) > 2 OR l_quantity > 40")(
    lambda t: t("lineitem").filter((X.function("nullif", c("l_linenumber"), X.cast(1, "int")) > 2) | (c("l_quantity") > 40.0)).project(_KEEP)
)
_verbs("filter_chained", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_discount > 0.05")(
    lambda t: t("lineitem").filter(c("l_quantity") > 10.0).filter(c("l_quantity") < 20.0).filter(c("l_discount") > 0.05).project(_KEEP)
)
_verbs("filter_no_projection", "SELECT * FROM supplier WHERE s_acctbal > 5000")(lambda t: t("supplier").filter(c("s_acctbal") > 5000.0))
_verbs("filter_column_not_selected", "SELECT c_name FROM customer WHERE c_acctbal < 0")(lambda t: t("customer").filter(c("c_acctbal") < 0.0).project(["c_name"]))
_verbs("filter_empty_result", "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 0")(lambda t: t("customer").filter(c("c_custkey") < 0).project(["c_custkey", "c_name"]))
_sql("sql_where_cast", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_quantity AS INT64) > 30")

# --- projections and casts ---
_verbs("project_alias", "SELECT c_custkey AS id, c_name AS label FROM customer")(lambda t: t("customer").project([c("c_custkey").alias("id"), c("c_name").alias("label")]))
_verbs("project_column_index", "SELECT r_name, r_regionkey FROM region")(lambda t: t("region").project([X.column_index(1), X.column_index(0)]))
for _name, _op, _text, _out in (("add", X.add, "+", "add"), ("subtract", X.subtract, "-", "subtract"), ("multiply", X.multiply, "*", "mult")):
    _verbs(f"project_{_name}", f"SELECT l_orderkey, l_linenumber, l_extendedprice {_text} l_discount AS {_out} FROM lineitem")(lambda t, op=_op: t("lineitem").project(["l_orderkey", "l_linenumber", op(c("l_extendedprice"), c("l_discount"))]))
_verbs("project_divide_int", "SELECT o_orderkey, (o_orderkey - 500) // 7 AS div FROM orders")(lambda t: t("orders").project(["o_orderkey", X.divide(c("o_orderkey") - 500, 7)]))
_verbs("project_divide_float", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem")(lambda t: t("lineitem").project(["l_orderkey", "l_linenumber", (c("l_extendedprice") / c("l_quantity")).alias("unit")]))
_verbs("project_divide_by_zero", "SELECT l_orderkey, l_linenumber, l_quantity / NULLIF(l_linenumber - 1, 0) AS q, l_orderkey // NULLIF(l_linenumber - 1, 0) AS k FROM lineitem")(
    lambda t: t("lineitem").project(["l_orderkey", "l_linenumber", (c("l_quantity") / (c("l_linenumber") - X.cast(1, "int"))).alias("q"), (c("l_orderkey") / (c("l_linenumber") - X.cast(1, "int"))).alias("k")])
)
_verbs("project_modulus", "SELECT o_orderkey, (o_orderkey - 500) % 7 AS mod, o_custkey % NULLIF(o_orderkey % 2, 0) AS rest FROM orders")(lambda t: t("orders").project(["o_orderkey", (c("o_orderkey") - 500) % 7, (c("o_custkey") % (c("o_orderkey") % 2)).alias("rest")]))
_verbs("project_literals", "SELECT r_regionkey, CAST(7 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS d, 'x' AS s, TRUE AS b FROM region")(lambda t: t("region").project(["r_regionkey", lit(7).alias("i"), lit(1.5).alias("d"), lit("x").alias("s"), lit(True).alias("b")]))
_verbs("project_precedence", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax * 2 - l_discount AS v FROM lineitem")(lambda t: t("lineitem").project(["l_orderkey", "l_linenumber", (c("l_quantity") + c("l_tax") * 2 - c("l_discount")).alias("v")]))
_verbs("project_comparison_names", "SELECT n_nationkey, n_regionkey = 1 AS eq, n_regionkey <> 1 AS neq, n_regionkey > 1 AS gt, n_regionkey >= 1 AS gteq, n_regionkey < 1 AS lt, n_regionkey <= 1 AS lteq, NOT (n_regionkey = 1) AS \"not\" FROM nation")(
    lambda t: t("nation").project(["n_nationkey", *(op(c("n_regionkey"), 1) for op in (X.eq, X.neq, X.gt, X.gteq, X.lt, X.lteq)), X.not_(c("n_regionkey") == 1)])
)
_verbs("project_computed_then_filter", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem) t WHERE revenue > 30000")(
    lambda t: t("lineitem").project(["l_orderkey", "l_linenumber", (c("l_extendedprice") * (lit(1) - c("l_discount"))).alias("revenue")]).filter(c("revenue") > 30000.0)
)
_verbs("project_scalar_function", "SELECT c_custkey, UPPER(c_name) AS upper FROM customer")(lambda t: t("customer").project(["c_custkey", X.function("upper", c("c_name"))]))
_verbs("cast_double_to_long", "SELECT c_custkey, CAST(TRUNC(c_acctbal) AS BIGINT) AS v FROM customer")(lambda t: t("customer").project(["c_custkey", X.cast(c("c_acctbal"), "int64").alias("v")]))
_verbs("cast_long_to_double", "SELECT CAST(c_custkey AS DOUBLE) AS v FROM customer")(lambda t: t("customer").project([X.cast(c("c_custkey"), "double").alias("v")]))
_verbs("cast_int_to_string", "SELECT CAST(n_nationkey AS VARCHAR) AS v FROM nation")(lambda t: t("nation").project([X.cast(c("n_nationkey"), "string").alias("v")]))
_verbs("cast_string_to_int", "SELECT n_nationkey, CAST(CAST(n_nationkey AS VARCHAR) AS INTEGER) AS v FROM nation")(lambda t: t("nation").project(["n_nationkey", X.cast(X.cast(c("n_nationkey"), "string"), "int32").alias("v")]))
_verbs("cast_try", "SELECT n_nationkey, TRY_CAST(n_name AS BIGINT) AS v FROM nation")(lambda t: t("nation").project(["n_nationkey", X.try_cast(c("n_name"), "int64").alias("v")]))
_sql("sql_cast_names", "SELECT CAST(n_nationkey AS INT64) AS a, CAST(n_nationkey AS STRING) AS s, CAST(n_nationkey AS DOUBLE) AS d, CAST(n_nationkey AS INT32) AS i, n_name = 'AS INT64)' AS b FROM nation")

_verbs("cast_same_type", "SELECT c_custkey, c_name FROM customer")(lambda t: t("customer").project([X.cast(c("c_custkey"), "int64"), X.cast(c("c_name"), "string")]))
_verbs("cast_narrow", "SELECT n_nationkey, CAST(n_nationkey AS TINYINT) AS b, CAST(n_nationkey AS SMALLINT) AS s FROM nation")(lambda t: t("nation").project(["n_nationkey", X.cast(c("n_nationkey"), "int8").alias("b"), X.cast(c("n_nationkey"), "int16").alias("s")]))
_verbs("cast_narrow_overflow_to_null", "SELECT o_orderkey, CASE WHEN o_orderkey <= 127 THEN CAST(o_orderkey AS TINYINT) END AS b FROM orders")(lambda t: t("orders").project(["o_orderkey", X.try_cast(c("o_orderkey"), "int8").alias("b")]))
_verbs("cast_double_to_string", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS v FROM lineitem")(lambda t: t("lineitem").project(["l_orderkey", "l_linenumber", X.cast(c("l_quantity"), "string").alias("v")]))
_verbs("cast_bool", "SELECT n_nationkey, CAST(n_regionkey = 1 AS INTEGER) AS i, CAST(n_regionkey = 1 AS DOUBLE) AS d, CAST(n_regionkey = 1 AS VARCHAR) AS s FROM nation")(
    lambda t: t("nation").project(["n_nationkey", *(X.cast(c("n_regionkey") == 1, k).alias(n) for k, n in (("int32", "i"), ("double", "d"), ("string", "s")))])
)
_verbs("cast_to_bool", "SELECT n_nationkey, CAST(n_regionkey AS BOOLEAN) AS i, n_regionkey = 1 AS b FROM nation")(lambda t: t("nation").project(["n_nationkey", X.cast(c("n_regionkey"), "bool").alias("i"), X.cast(c("n_regionkey") == 1, "bool").alias("b")]))
_verbs("cast_null", "SELECT l_orderkey, l_linenumber, CAST(NULLIF(l_linenumber, 1) AS DOUBLE) AS d, CAST(NULLIF(l_linenumber, 1) AS VARCHAR) AS s FROM lineitem")(
    lambda t: t("lineitem").project(["l_orderkey", "l_linenumber", *(X.cast(X.function("nullif", c("l_linenumber"), X.cast(1, "int")), k).alias(n) for k, n in (("double", "d"), ("string", "s")))])
)
_verbs("coerce_mixed_types", "SELECT l_orderkey, l_linenumber, l_linenumber + l_quantity AS v, l_linenumber * l_orderkey AS w FROM lineitem WHERE l_linenumber < l_discount * 100")(
    lambda t: t("lineitem").filter(c("l_linenumber") < c("l_discount") * 100).project(["l_orderkey", "l_linenumber", (c("l_linenumber") + c("l_quantity")).alias("v"), (c("l_linenumber") * c("l_orderkey")).alias("w")])
)
_sql("sql_precedence", "SELECT o_orderkey, 1 + o_custkey * 2 - 3 AS v FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 100000 AND NOT o_custkey < 50")
_sql("sql_keywords_any_case", "select o_orderstatus, max(o_totalprice) as top from orders where o_custkey > 10 and o_totalprice > 0 group by o_orderstatus having count(*) > 1")
_sql("sql_identifiers_and_comments", "SELECT o.o_orderkey /* the key */, o.o_custkey AS key -- and the customer\nFROM orders AS o WHERE o.o_totalprice >= 1.5e5 AND -1 < o.o_custkey")
_verbs("names_any_case", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda t: t("nation").join(t("region"), ["N_RegionKey"], ["R_REGIONKEY"]).project(["n_nationkey", "r_name"]))

# --- aggregates ---
_verbs("agg_sum", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS total FROM lineitem GROUP BY l_returnflag")(lambda t: t("lineitem").aggregate(["l_returnflag"], [X.function("round", X.sum_(c("l_quantity")), X.cast(2, "int")).alias("total")]))
_verbs("agg_sum_int", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS SUM FROM lineitem GROUP BY l_returnflag")(lambda t: t("lineitem").aggregate(["l_returnflag"], [X.sum_(c("l_linenumber"))]))
_verbs("agg_min_max", "SELECT l_returnflag, MIN(l_extendedprice) AS MIN, MAX(l_extendedprice) AS MAX FROM lineitem GROUP BY l_returnflag")(lambda t: t("lineitem").aggregate(["l_returnflag"], [X.min_(c("l_extendedprice")), X.max_(c("l_extendedprice"))]))
_verbs("agg_min_max_string", "SELECT MIN(c_name) AS MIN, MAX(c_name) AS MAX FROM customer")(lambda t: t("customer").aggregate([], [X.min_(c("c_name")), X.max_(c("c_name"))]))
_verbs("agg_count_star", "SELECT o_orderstatus, COUNT(*) AS COUNT FROM orders GROUP BY o_orderstatus")(lambda t: t("orders").aggregate(["o_orderstatus"], [X.count_rows()]))
_verbs("agg_count_with_nulls", "SELECT COUNT(NULLIF(l_linenumber, 1)) AS n, COUNT(*) AS rows FROM lineitem")(lambda t: t("lineitem").aggregate([], [X.count(X.function("nullif", c("l_linenumber"), X.cast(1, "int"))).alias("n"), X.count_rows().alias("rows")]))
_verbs("agg_avg", "SELECT l_linestatus, ROUND(AVG(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_linestatus")(lambda t: t("lineitem").aggregate(["l_linestatus"], [X.function("round", X.avg(c("l_discount")), X.cast(6, "int")).alias("avg_disc")]))
_verbs("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS COUNT_DISTINCT FROM lineitem GROUP BY l_returnflag")(lambda t: t("lineitem").aggregate(["l_returnflag"], [X.count_distinct(c("l_suppkey"))]))
_verbs("agg_global", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders")(lambda t: t("orders").aggregate([], [X.count_rows().alias("n"), X.max_(c("o_totalprice")).alias("top")]))
_verbs("agg_global_empty", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders WHERE o_orderkey < 0")(lambda t: t("orders").filter(c("o_orderkey") < 0).aggregate([], [X.count_rows().alias("n"), X.max_(c("o_totalprice")).alias("top")]))
_verbs("agg_group_multi_key", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")(lambda t: t("lineitem").aggregate(["l_returnflag", "l_linestatus"], [X.count_rows().alias("n")]))
_verbs("agg_group_expr_key", "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10")(lambda t: t("orders").aggregate([(c("o_custkey") % 10).alias("bucket")], [X.count_rows().alias("n")]))
_verbs("agg_null_key", "SELECT NULLIF(l_linenumber, 1) AS k, COUNT(*) AS n FROM lineitem GROUP BY 1")(lambda t: t("lineitem").aggregate([X.function("nullif", c("l_linenumber"), X.cast(1, "int")).alias("k")], [X.count_rows().alias("n")]))
_verbs("agg_all_null", "SELECT MIN(NULLIF(l_linestatus, l_linestatus)) AS low, COUNT(NULLIF(l_linestatus, l_linestatus)) AS n FROM lineitem")(
    lambda t: t("lineitem").aggregate([], [X.min_(X.function("nullif", c("l_linestatus"), c("l_linestatus"))).alias("low"), X.count(X.function("nullif", c("l_linestatus"), c("l_linestatus"))).alias("n")])
)
_sql("agg_where", "SELECT o_orderpriority, MAX(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
_sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_sql("agg_where_having", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey HAVING COUNT(*) >= 6")
_sql("agg_select_order", "SELECT COUNT(*) AS n, l_linestatus AS status, MIN(l_tax) AS low, l_returnflag AS flag FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag, l_linestatus")
_sql("agg_group_without_aggregate", "SELECT l_returnflag FROM lineitem GROUP BY l_returnflag")

_verbs("agg_nan_key", "SELECT CAST(COUNT(DISTINCT k) AS BIGINT) AS groups, CAST(SUM(n) AS BIGINT) AS total FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'nan' ELSE CAST(l_linenumber AS VARCHAR) END AS k, COUNT(*) AS n FROM lineitem GROUP BY 1)")(
    lambda t: t("lineitem").project([(X.cast(c("l_linenumber"), "double") + X.function("if", c("l_linenumber") == 1, X.cast("NaN", "double"), 0.0)).alias("k")]).aggregate(["k"], [X.count_rows().alias("n")]).aggregate([], [X.count_rows().alias("groups"), X.sum_(c("n")).alias("total")])
)
_verbs("agg_user_defined", "SELECT l_returnflag, CAST(MAX(l_linenumber) - MIN(l_linenumber) AS BIGINT) AS spread FROM lineitem GROUP BY l_returnflag")(
    lambda t: t("lineitem").aggregate(["l_returnflag"], [X.user_aggregate("spread", lambda low, high: None if pd.isna(high.max()) else int(high.max() - low.min()), "int64", lambda v: (v.min(), v.max()))(c("l_linenumber"))])
)
_verbs("agg_of_built_in_by_name", "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS deviation FROM lineitem GROUP BY l_returnflag")(
    lambda t: t("lineitem").aggregate(["l_returnflag"], [X.function("round", X.function("stddev_samp", c("l_quantity")), X.cast(6, "int")).alias("deviation")])
)
_sql("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("window_rank", "SELECT o_custkey, o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")

# --- joins ---
_verbs("join_inner", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")(lambda t: t("orders").join(t("customer"), ["o_custkey"], ["c_custkey"]).project(["o_orderkey", "o_custkey", "c_custkey", "c_name"]))
_verbs("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS l_quantity_right FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_suppkey = b.l_suppkey")(
    lambda t: t("lineitem").join(t("lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_suppkey"]).project(["l_orderkey", "l_linenumber", "l_quantity_right"])
)
_verbs("join_suffix", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right, b.n_regionkey AS n_regionkey_right FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")(lambda t: t("nation").join(t("nation"), ["n_nationkey"], ["n_regionkey"]))
_verbs("join_chain3", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda t: t("supplier").join(t("nation"), ["s_nationkey"], ["n_nationkey"]).join(t("region"), ["n_regionkey"], ["r_regionkey"]).project(["s_name", "n_name", "r_name"])
)
_verbs("join_filter_both_sides", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND c_mktsegment = 'BUILDING'")(
    lambda t: t("orders").join(t("customer"), ["o_custkey"], ["c_custkey"]).filter((c("o_totalprice") > 200000.0) & (c("c_mktsegment") == "BUILDING")).project(["o_orderkey", "c_name"])
)
_verbs("join_residual_filter", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 30")(lambda t: t("orders").join(t("customer"), ["o_custkey"], ["c_custkey"]).filter(c("o_totalprice") > c("c_acctbal") * 30).project(["o_orderkey", "c_custkey"]))
_verbs("join_null_keys", "SELECT a.r_name, b.n_name FROM (SELECT r_name, NULLIF(r_regionkey, 1) AS k FROM region) a JOIN (SELECT n_name, NULLIF(n_regionkey, 1) AS k FROM nation) b ON a.k = b.k")(
    lambda t: t("region").project(["r_name", X.function("nullif", c("r_regionkey"), X.cast(1, "int")).alias("k")]).join(t("nation").project(["n_name", X.function("nullif", c("n_regionkey"), X.cast(1, "int")).alias("k")]), ["k"], ["k"]).project(["r_name", "n_name"])
)
_verbs("join_no_match", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_nationkey WHERE r_regionkey < 0")(lambda t: t("region").filter(c("r_regionkey") < 0).join(t("nation"), ["r_regionkey"], ["n_nationkey"]).project(["r_name", "n_name"]))
_sql("join_then_agg", "SELECT c_mktsegment, COUNT(*) AS n, MAX(o_totalprice) AS top FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c_mktsegment")
_sql("join_left", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
_sql("join_alias_either_order", "SELECT n.n_name, r.r_name FROM nation AS n INNER JOIN region AS r ON r.r_regionkey = n.n_regionkey")

_sql("join_right", "SELECT l.n_name, r.r_name FROM (SELECT * FROM nation WHERE n_nationkey < 5) l RIGHT JOIN region r ON l.n_regionkey = r.r_regionkey")
_sql("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 10) a FULL JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey > 5) b ON a.n_nationkey = b.n_nationkey")
_sql("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
_verbs("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(lambda t: t("customer").join(t("orders"), ["c_custkey"], ["o_custkey"], "left_semi").project(["c_custkey"]))
_verbs("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda t: t("customer").join(t("orders"), ["c_custkey"], ["o_custkey"], "left_anti").project(["c_custkey"]))
_sql("join_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey")
_verbs("join_mixed_key_types", "SELECT n_name, r_name FROM nation JOIN region ON CAST(n_regionkey AS DOUBLE) = r_regionkey")(
    lambda t: t("nation").project(["n_name", X.cast(c("n_regionkey"), "double").alias("k")]).join(t("region"), ["k"], ["r_regionkey"]).project(["n_name", "r_name"])
)
_verbs("join_aggregate_side_filtered", "SELECT c_name, n FROM customer JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE n > 10")(
    lambda t: t("customer").join(t("orders").aggregate(["o_custkey"], [X.count_rows().alias("n")]), ["c_custkey"], ["o_custkey"]).filter(c("n") > 10).project(["c_name", "n"])
)
_verbs("project_keeps_order", "SELECT r_name, r_regionkey FROM (SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0)")(lambda t: t("region").project(["r_regionkey", "r_name"]).filter(c("r_regionkey") > 0).project(["r_name", "r_regionkey"]))

# --- views, order, limit, set operations ---


def _view_over_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = EngineContext(spark)
    ctx.register_parquet("orders_base", f"{sf_dir}/orders.parquet")
    ctx.register("orders_big", ctx.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders_base WHERE o_totalprice > 150000"))
    ctx.register("orders_by_customer", ctx.sql("SELECT o_custkey, COUNT(*) AS n FROM orders_big GROUP BY o_custkey"))
    return ctx.sql("SELECT o_custkey, n FROM orders_by_customer WHERE n > 2").df


QUERIES["view_over_view"] = _view_over_view
ORACLE_SQL["view_over_view"] = "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey HAVING COUNT(*) > 2"
_sql("order_by_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql("select_star", "SELECT * FROM region")
_sql("distinct", "SELECT DISTINCT l_shipdate FROM lineitem")
_sql("intersect", "SELECT n_regionkey AS k FROM nation INTERSECT SELECT r_regionkey AS k FROM region WHERE r_regionkey > 1")
_sql("except", "SELECT r_regionkey AS k FROM region EXCEPT SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 10")
_sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")

# --- flagship and streaming ---
_FLAGSHIP = "SELECT l_returnflag, MAX(l_extendedprice) AS max_price FROM lineitem WHERE CAST(l_quantity AS DOUBLE) > 10 GROUP BY l_returnflag"
_sql("flagship", _FLAGSHIP)
_sql(
    "flagship_join_benchmark",
    "SELECT c.c_nationkey, COUNT(*) AS items, CAST(SUM(CAST(ROUND(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, MAX(o.o_totalprice) AS top FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE c.c_acctbal > 0 AND o.o_orderstatus = 'F' AND l.l_quantity > 10 GROUP BY c.c_nationkey",
)


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return streaming.windowed_counts(EngineContext(spark).parquet(f"{sf_dir}/events.parquet").df).withColumn("total", F.round("total", 4))


QUERIES["events_windowed"] = _windowed
ORACLE_SQL["events_windowed"] = "SELECT DATE_TRUNC('hour', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
