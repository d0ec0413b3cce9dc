"""Sources, expressions, joins, SQL and results on small fixtures."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException
from tessera import EngineContext
from tessera import functions as X
from tessera.operators.relational import suffixed
from tessera.plans.context import dialect
from tessera.sources.readers import sniff

c = X.col
BOATS = "id,name,harbour,region,kind,metres\n1,Petrel,Kilve,SW,ketch,31\n2,Dunlin,Amble,NE,yawl,24\n3,Whimbrel,Blyth,NE,ketch,24\n"


@pytest.fixture(scope="module")
def ctx(spark):
    return EngineContext(spark)


@pytest.fixture
def boats(tmp_path):
    path = tmp_path / "boats.csv"
    path.write_text(BOATS)
    return path


def rows(frame):
    return sorted((tuple(r) for r in frame.df.collect()), key=repr)


def test_csv_header_types_and_projection(ctx, boats):
    frame = ctx.csv(boats)
    assert {f.dataType.simpleString() for f in frame.schema()} == {"string"}
    assert rows(frame.project(["id", "region"])) == [("1", "SW"), ("2", "NE"), ("3", "NE")]


def test_csv_without_header_and_tabs(ctx, tmp_path):
    path = tmp_path / "e.tsv"
    path.write_text("1\tketch\n2\t\n\n3\t\"a\"\"b\tc\"\n")
    frame = ctx.csv(path, header=False)
    assert frame.schema().names == ["field_1", "field_2"]
    assert rows(frame) == [("1", "ketch"), ("2", None), ("3", 'a"b\tc')]


def test_csv_schema_and_single_column(ctx, tmp_path, boats):
    assert rows(ctx.csv(boats, schema="id int, name string, harbour string, region string, kind string, metres long").aggregate([], [X.sum_(c("metres"))])) == [(79,)]
    path = tmp_path / "one.csv"
    path.write_text("name\nx\ny\n")
    assert rows(ctx.csv(path)) == [("x",), ("y",)]


def test_parquet_file_and_folder(ctx, tmp_path):
    for k in (1, 2):
        pq.write_table(pa.table({"id": pa.array([k, None], pa.int64())}), tmp_path / f"p{k}.parquet")
    assert rows(ctx.parquet(tmp_path / "p1.parquet")) == [(1,), (None,)]
    assert rows(ctx.parquet(tmp_path).filter(c("id") > 0)) == [(1,), (2,)]


def test_scan_reads_only_what_is_needed(ctx, tmp_path):
    pq.write_table(pa.table({"a": [1, 2], "b": [3, 4], "z": [5, 6]}), tmp_path / "t.parquet")
    plan = ctx.parquet(tmp_path / "t.parquet").filter(c("a") > 1).project(["b"]).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,1)" in plan and "z" not in plan.split("ReadSchema")[1]


def test_memory_filter_and_chained_filters(ctx):
    frame = ctx.memory(pa.table({"a": [1, 2, 3], "b": [1.0, None, 3.0]}))
    assert rows(frame.filter(c("a") > 1).filter(c("b") > 0.0)) == [(3, 3.0)]
    with pytest.raises(ValueError):
        frame.filter(c("a"))


def test_integer_division_zero_and_modulus(ctx):
    frame = ctx.memory([(7, 2), (-7, 2), (5, 0), (None, 1)], "a int, b int")
    assert [tuple(r) for r in frame.project([c("a") / c("b"), c("a") % c("b"), (X.cast(c("a"), "double") / c("b")).alias("f")]).df.collect()] == [(3, 1, 3.5), (-3, -1, -3.5), (None, None, None), (None, None, None)]


def test_literals_and_names(ctx):
    frame = ctx.memory([(1,)], "a int").project([X.lit(5), X.lit(1.5), X.lit("s"), X.lit(True), c("a") + 1, X.cast(c("a"), "string")])
    assert frame.schema().names == ["5", "1.5", "s", "True", "add", "a"]
    with pytest.raises(TypeError):
        X.lit(object())


def test_boolean_logic_is_three_valued(ctx):
    frame = ctx.memory([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    got = [tuple(r) for r in frame.project([c("a") & c("b"), c("a") | c("b"), ~c("a")]).df.collect()]
    assert got == [(True, True, False), (False, True, False), (None, True, False), (False, True, True), (False, False, True), (False, None, True), (None, True, None), (False, None, None), (None, None, None)]


def test_casts(ctx):
    frame = ctx.memory([("5", 2.7), (" 5", -2.7)], "s string, d double")
    assert rows(frame.project([X.cast(c("s"), "int64"), X.cast(c("d"), "int32").alias("i")])) == [(5, -2), (5, 2)]
    bad = ctx.memory([("x",)], "s string")
    assert rows(bad.project([X.try_cast(c("s"), "int64")])) == [(None,)]
    with pytest.raises(NumberFormatException):
        bad.project([X.cast(c("s"), "int64")]).df.collect()
    with pytest.raises(ArithmeticException):
        ctx.memory([(300,)], "a int").project([X.cast(c("a"), "int8")]).df.collect()
    assert X.cast(c("a"), pa.int64()).resolve(frame.df.selectExpr("1 AS a")) is not None


def test_aggregates_with_nulls_and_empty_input(ctx):
    frame = ctx.memory([("a", 1), ("a", None), (None, 3), ("b", None)], "k string, v int")
    got = rows(frame.aggregate(["k"], [X.sum_(c("v")), X.min_(c("v")), X.max_(c("v")), X.count(c("v")), X.count_rows().alias("n"), X.avg(c("v")), X.count_distinct(c("v"))]))
    assert got == sorted([("a", 1, 1, 1, 1, 2, 1.0, 1), (None, 3, 3, 3, 1, 1, 3.0, 1), ("b", None, None, None, 0, 1, None, 0)], key=repr)
    assert rows(frame.filter(c("v") > 9).aggregate([], [X.count_rows(), X.sum_(c("v"))])) == [(0, None)]
    assert rows(frame.filter(c("v") > 9).aggregate(["k"], [X.count_rows()])) == []


def test_nan_groups_together(ctx):
    assert rows(ctx.memory([(float("nan"),), (float("nan"),), (-0.0,), (0.0,)], "x double").aggregate(["x"], [X.count_rows()]).project(["COUNT"])) == [(2,), (2,)]


def test_joins(ctx):
    left = ctx.memory([("a", 1, 10), ("a", 2, 20), (None, 1, 30)], "k1 string, k2 int, v int")
    right = ctx.memory([("a", 1, 5), ("a", 1, 6), (None, 1, 7)], "k1 string, k2 int, w int")
    out = left.join(right, ["k1", "k2"], ["k1", "k2"])
    assert out.schema().names == ["k1", "k2", "v", "k1_right", "k2_right", "w"]
    assert rows(out.project(["v", "w"])) == [(10, 5), (10, 6)]
    assert rows(left.join(right, ["k1", "k2"], ["k1", "k2"], "left_anti").project(["v"])) == [(20,), (30,)]
    assert left.join(left, ["v"], ["v"]).join(left, ["v"], ["v"]).schema().names[-3:] == ["k1_right2", "k2_right2", "v_right2"]
    for bad in (([], []), (["k1"], ["k1", "k2"]), (["none"], ["k1"])):
        with pytest.raises(ValueError):
            left.join(right, *bad)
    assert suffixed(["v", "v_right"], ["v", "v_right"]) == ["v_right2", "v_right_right"]


def test_sql_end_to_end(ctx, boats, tmp_path):
    coasts = tmp_path / "coasts.csv"
    coasts.write_text("code,coast\nSW,Bristol Channel\nNE,North Sea\n")
    ctx.register_csv("boats", boats)
    ctx.register_csv("coasts", coasts)
    assert rows(ctx.sql("SELECT s.coast, MAX(CAST(b.metres AS INT64)) AS top FROM boats b JOIN coasts s ON s.code = b.region WHERE b.id > '0' GROUP BY s.coast HAVING COUNT(*) > 1")) == [("North Sea", 24)]
    assert rows(ctx.sql("select name from boats order by name limit 1")) == [("Dunlin",)]
    ctx.register("southwest", ctx.table("boats").filter(c("region") == "SW"))
    assert rows(ctx.sql("SELECT name FROM southwest")) == [("Petrel",)]
    with pytest.raises(AnalysisException):
        ctx.sql("SELECT nothing FROM boats")


def test_dialect_leaves_text_alone():
    assert dialect("SELECT CAST(a AS INT64), 'x AS INT64)', CAST(b AS varchar(3)), cast(c as bool) -- d AS INT64)") == "SELECT CAST(a AS bigint), 'x AS INT64)', CAST(b AS varchar(3)), cast(c as boolean) -- d AS INT64)"


def test_results(ctx, capsys):
    result = ctx.execute(ctx.memory([(1, 'a,"b"'), (2, None), (3, "y" * 40)], "id int, s string"))
    assert result.collect(1) == [{"id": 1, "s": 'a,"b"'}] and len(result) == 3 and len(result.collect()) == 3
    assert result.scalar() == 1 and result.to_pandas().shape == (3, 2) and sum(b.num_rows for b in result.to_batches()) == 3
    assert result.to_csv() == 'id,s\n1,"a,""b"""\n2,null\n3,' + "y" * 40 + "\n"
    result.show(2)
    assert "(first 2 rows)" in capsys.readouterr().out
    result.show(3)
    assert "(3 rows)" in capsys.readouterr().out
    assert [b.num_rows for b in result.batches(2)] in ([2, 1], [1, 1, 1], [1, 2]) and list(result.csv_lines(False))[1] == "2,null\n"
    assert "y" * 27 + "..." in result.to_markdown(truncate=True) and [r["id"] for r in result] == [1, 2, 3]
    empty = ctx.execute(ctx.memory([], "id int"))
    assert empty.collect() == [] and empty.scalar() is None and list(empty.to_pandas().columns) == ["id"]


def test_own_source_gets_projection_and_filter(ctx, tmp_path):
    seen = tmp_path / "seen"

    class Numbers:
        def schema(self):
            return "id BIGINT, name STRING"

        def scan(self, projection, filters, split=0):
            seen.write_text(repr((list(projection), [(f.column, f.sign, f.value) for f in filters])))
            yield pa.record_batch({"id": pa.array([0, 1, 2], pa.int64()), "name": pa.array(["a", "b", None])})

    ctx.register_data_source("numbers", Numbers())
    frame = ctx.table("numbers").filter(c("id") > 0)
    assert rows(frame) == [(1, "b"), (2, None)]
    assert seen.read_text() == repr((["id", "name"], [("id", ">", 0)]))
    assert rows(ctx.source(Numbers(), ["name"])) == [("a",), ("b",), (None,)] and seen.read_text().startswith("(['name'], ")
    with pytest.raises(ValueError):
        ctx.source(Numbers(), ["none"])
    assert sum(b.num_rows for b in ctx.execute_batches(frame)) == 2


def test_plans(ctx):
    frame = ctx.memory([(1, "a")], "id int, s string").filter(c("id") > 0).project(["s"])
    assert "Filter" in frame.logical_plan() and "Project" in frame.optimized_plan() and "Project" in frame.physical_plan()
    lines = frame.pretty().splitlines()
    assert lines[0].startswith("Project") and lines[1].startswith("\tFilter") and lines[2].startswith("\t\t")


def test_settings(spark):
    ctx = EngineContext(spark, {"csv.batch_size": 2, "spark.sql.session.timeZone": "UTC"})
    assert [b.num_rows for b in ctx.execute_batches(spark.range(5).coalesce(1))] == [2, 2, 1]
    with pytest.raises(ValueError):
        EngineContext(spark, {"csv.batchsize": 2})


@pytest.mark.parametrize(("head", "sep"), [("a:b\n1:2\n3:4\n", ":"), ("a~b~c\n1~2~3\n", "~"), ("a\tb\n1\t2\n", "\t"), ("word\nwood\nworld\n", ","), ("", ","), ("a;b\n1,5;2\n", ";")])
def test_sniff(head, sep):
    assert sniff(head) == sep


def test_names_in_any_case_and_ambiguity(ctx):
    left, right = ctx.memory([(1, 2)], "Key int, v int"), ctx.memory([(1, 3)], "key int, v int")
    assert rows(left.join(right, ["KEY"], ["KEY"])) == [(1, 2, 1, 3)]
    ctx.register("l", left)
    ctx.register("r", right)
    with pytest.raises(AnalysisException, match="AMBIGUOUS"):
        ctx.sql("SELECT v FROM l JOIN r ON l.key = r.key")
    with pytest.raises(AnalysisException):
        ctx.sql("SELECT l.none FROM l JOIN r ON l.key = r.key")


def test_windowed_counts_on_a_stream(ctx, spark, tmp_path):
    from tessera.streaming import windowed_counts

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT SUM(n) FROM counted").first()[0] == 50


def test_many_small_batches_become_few_partitions(ctx, spark, monkeypatch):
    from tessera.sources import readers

    kept = spark.conf.get("spark.sql.execution.arrow.localRelationThreshold")
    spark.conf.set("spark.sql.execution.arrow.localRelationThreshold", "0")
    try:
        small = [pa.record_batch({"id": pa.array([k], pa.int64())}) for k in range(300)]
        assert ctx.memory(pa.Table.from_batches(small)).df.rdd.getNumPartitions() == 1
        assert sorted(rows(ctx.batches(iter(small), ctx.memory(small[0]).schema()))) == [(k,) for k in range(300)]
        monkeypatch.setattr(readers, "HELD_BATCHES", 100)
        frame = ctx.batches(iter(small), ctx.memory(small[0]).schema())
        assert sorted(rows(frame)) == [(k,) for k in range(300)] and len(frame.df.inputFiles()) >= 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.localRelationThreshold", kept)


def test_a_stream_of_batches_keeps_types_and_may_be_empty(ctx, spark):
    typed = ctx.sql("SELECT id, IF(id % 7 = 0, NULL, CAST(id AS STRING)) AS s, TIMESTAMP_NTZ'2020-01-01 00:00:00' + id * INTERVAL '1' DAY AS n, TIMESTAMP'2020-01-01 00:00:00' AS t FROM range(0, 5000, 1, 3)")
    batches = list(EngineContext(spark, {"csv.batch_size": 100}).execute_batches(typed))
    assert {b.num_rows for b in batches} <= set(range(1, 101)) and sum(b.num_rows for b in batches) == 5000
    again = ctx.batches(iter(batches), typed.schema())
    assert [f.dataType for f in again.schema()] == [f.dataType for f in typed.schema()] and rows(again) == rows(typed)
    none = ctx.batches(iter([]), typed.schema())
    assert rows(none) == [] and none.schema().names == ["id", "s", "n", "t"]


def test_batches_travel_together_up_to_a_megabyte(spark):
    from tessera.plans.result import _packed

    batch = pa.record_batch({"s": ["x" * 1000] * 5050})
    parts = [pa.ipc.open_stream(b["batch"][0].as_py()).read_all() for b in _packed(100)(iter([batch]))]
    assert sum(p.num_rows for p in parts) == 5050 and all(p.num_rows % 100 == 0 for p in parts[:-1])
    assert 5 <= len(parts) <= 16 and max(p.nbytes for p in parts) <= 1 << 20
    with pytest.raises(ValueError):
        next(EngineContext(spark).execute(spark.range(1)).batches(0))


def test_user_aggregate_by_parts_holds_a_batch_at_a_time(ctx, spark):
    import pandas as pd

    def part(v):
        assert len(v) <= 100, "values of a group met"
        return v.min(), v.max(), int(v.count())

    spread = X.user_aggregate("spread", lambda low, high, n: None if n.sum() == 0 else int(high.max() - low.min()), "int64", part)
    frame = ctx.sql("SELECT IF(id % 5 = 0, NULL, id % 3) AS k, CAST(IF(id % 3 = 1, NULL, id) AS INT) AS v, id FROM range(0, 5000, 1, 3)")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = rows(frame.aggregate(["k"], [X.count_rows(), spread(c("v")), X.count_distinct(c("id")).alias("ids"), X.add(spread(c("v")), 1).alias("more")]))
        data = pd.DataFrame({"id": range(5000)})
        data["k"], data["v"] = (data.id % 3).where(data.id % 5 != 0, -1), data.id.where(data.id % 3 != 1)
        want = []
        for k, g in data.groupby("k"):
            s = None if g.v.isna().all() else int(g.v.max() - g.v.min())
            want.append((None if k < 0 else k, len(g), s, len(g), None if s is None else s + 1))
        assert got == sorted(want, key=repr)
        assert rows(frame.aggregate([], [spread(c("v"))])) == [(4998,)]
        assert rows(frame.filter(c("id") < 0).aggregate([], [spread(c("v"))])) == [(None,)]
        assert rows(frame.filter(c("id") < 0).aggregate(["k"], [spread(c("v"))])) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_user_aggregate_by_parts_keeps_groups_of_any_key_apart(ctx):
    top = X.user_aggregate("top", lambda v: v.max(), "int64", lambda v: (v.max(),))
    names = ["big", "x", "s", "t", "d"]
    frame = ctx.sql("SELECT IF(id % 4 = 0, NULL, 9007199254740992 + id % 2) AS big, IF(id % 3 = 0, CAST('NaN' AS DOUBLE), IF(id % 3 = 1, -0.0D, 0.0D)) AS x, named_struct('a', CAST(id % 2 AS INT), 'b', NULL) AS s, timestamp_micros(id % 2) AS t, CAST(id % 2 AS DECIMAL(20, 2)) AS d, id FROM range(0, 600, 1, 2)")
    for by in [*([n] for n in names), names]:
        assert repr(rows(frame.aggregate(by, [top(c("id"))]))) == repr(rows(frame.aggregate(by, [X.max_(c("id")).alias("top")])))
    with pytest.raises(ValueError):
        frame.project([top(c("id"))])
