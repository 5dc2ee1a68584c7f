"""The engine on small tables with nulls, edges and restarts, and every query against DuckDB."""

import datetime
import json
import math
import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridspan import Session, Table, col
from gridspan import queries as q
from gridspan.operators import vector as v
from gridspan.operators.registry import apply_step, register
from gridspan.plans.expressions import compile_expr, compile_predicate, from_json, parse, references
from gridspan.streaming.sink import append_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, str(tmp_path))


def table_text(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for _, x in sorted(r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(q.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in q.QUERIES[name](spark, SF).collect()]
    assert table_text(got) == table_text(want)


def test_every_query_is_registered(spark):
    found = __spark_entry__.queries()
    assert set(q.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() > 0
    assert q.QUERIES["scan_stream_append"](spark, SF).count() == 1000


def test_expressions_round_trip(spark):
    df = spark.createDataFrame([(7, 2, 10.0, 0.0), (-7, 2, -1.0, 0.0), (None, 3, 0.0, 0.0)], "a long, b int, x double, z double")
    e = (1 - col("x")) * 2 + col("a") / col("b")
    assert from_json(json.loads(json.dumps(e.to_json()))).to_json() == e.to_json() and references(e) == {"x", "a", "b"}
    rows = df.select(compile_expr(col("a") / col("b"), df).alias("d"), compile_expr(col("x") / col("z"), df).alias("i")).collect()
    assert [r.d for r in rows] == [3, -3, None] and rows[0].i == math.inf and rows[1].i == -math.inf and math.isnan(rows[2].i)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        df.select(compile_expr(col("a") / 0, df)).collect()
    with pytest.raises(ValueError, match="unknown column"):
        compile_expr(col("nope"), df)
    with pytest.raises(ValueError):
        col("a") + (lambda x: x)


def test_predicates(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    keep = lambda p: [r.a for r in df.filter(compile_predicate(parse(p), df)).collect()]
    assert keep([("a", "=", 1), "OR", ("a", "=", 3)]) == [1, 3] and keep([]) == [1, None, 3]
    assert keep([("a", ">", 0), ("a", "<", 2)]) == [1] and keep(("a", "in", [3, None])) == [3] and keep(("a", "IN", [])) == []
    assert keep([("a", "=", 1), "OR", ("a", "=", 3), "AND", ("a", ">", 1)]) == [3]
    assert keep((col("a") == 1) | [("a", "BETWEEN", (3, 4))]) == [1, 3]
    with pytest.raises(ValueError):
        parse(("a", "LIKE", "x"))


def test_storage_round_trip(spark, session):
    f = session.create_dataset("t", chunk_rows=10, hash_dims={"name": 3}, range_dims={"x": 5})
    f.write({"name": ["a", "b", None, "a"], "x": [-1.5, 0.0, None, 12.0]})
    f.write(pa.table({"x": [3.0], "name": ["c"], "more": [1]}))
    assert values(f.df(), "global_id", "name", "x", "more") == [(0, "a", -1.5, None), (1, "b", 0.0, None), (2, None, None, None), (3, "a", 12.0, None), (4, "c", 3.0, 1)]
    again = session.read("t")
    again.write({"name": ["d"], "x": [1.0]})
    assert again.count() == 6 and again.table.axes == ["name", "x", "global_id"] and again.table.column_groups()["x"] == 0
    with pytest.raises(FileNotFoundError):
        session.read("missing")
    with pytest.raises(ValueError, match="dimension"):
        f.write({"x": [1.0], "other": [1]})
    with pytest.raises(FileExistsError):
        session.create_dataset("t")
    assert session.create_dataset("empty").count() == 0 and f.limit(0).count() == 0


def test_updates_and_deletes(spark, session):
    f = session.create_dataset("t", hash_dims={"k": 2}, global_id="i")
    f.write({"i": [1, 2, 3], "k": ["a", "b", "a"], "n": pa.array([1, None, 3], pa.int32()), "x": [1.0, 2.0, 3.0]})
    assert f.filter(col("n") > 1).update({"n": 1.7, "x": col("x") * 10 + col("n")}, count=True) == 1
    assert values(f.df(), "i", "n", "x") == [(1, 1, 1.0), (2, None, 2.0), (3, 1, 33.0)]
    f.filter(col("n") == 1).delete()
    assert values(f.df(), "i") == [(2,)]  # a null condition deletes nothing
    f.write({"i": [4], "k": ["a"], "n": pa.array([1], pa.int32()), "x": [0.0]})
    reopened = session.read("t")
    assert values(reopened.df(), "i") == [(2,), (4,)]  # changes do not reach later rows, and outlive the session
    assert values(session.read("t", as_of=2).df(), "i", "x") == [(1, 1.0), (2, 2.0), (3, 33.0)]
    reopened.filter(col("i") == 4).update({"k": "b"})
    assert values(reopened.filter(col("k") == "b").df(), "i") == [(2,), (4,)]  # although the stored bucket is of "a"
    reopened.table.compact()
    reopened.table.vacuum()
    assert values(session.read("t").filter(col("k") == "b").df(), "i") == [(2,), (4,)] and not session.read("t").table.patches()
    with pytest.raises(ValueError):
        f.update({"nope": 1})
    with pytest.raises(ValueError):
        f.filter(col("nope") == 1).delete()
    with pytest.raises(ValueError):
        f.limit(1).delete()
    f.delete()
    assert f.count() == 0


def test_pruning_never_changes_results(spark, session):
    rng = random.Random(0)
    f = session.create_dataset("t", chunk_rows=20, hash_dims={"s": 3, "h": 4}, range_dims={"r": 7, "d": 2}, global_id="i")
    f.write({"i": list(range(-50, 150)), "s": [rng.choice(["a", "b", "c", None]) for _ in range(200)], "h": [rng.randint(-9, 9) for _ in range(200)], "r": [rng.randint(-40, 40) for _ in range(200)], "d": [rng.uniform(-9, 9) for _ in range(200)]})

    def leaf():
        c = rng.choice(["s", "h", "r", "d", "i"])
        value = lambda: rng.choice("abcz") if c == "s" else rng.uniform(-9, 9) if c == "d" else rng.randint(-40, 140)
        op = rng.choice(["=", "!=", "<", "<=", ">", ">=", "IN", "BETWEEN"])
        return (c, op, [value(), value()] if op in ("IN", "BETWEEN") else value())

    for _ in range(12):
        tree = [leaf(), rng.choice(["AND", "OR"]), [leaf(), rng.choice(["AND", "OR"]), leaf()]]
        p = parse(tree)
        assert values(f.table.dataframe(p), "i") == values(f.table.dataframe(p, prune=False), "i")
    plan = f.filter(col("i") == 30).select("s").df()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__range_i" in plan and "r:" not in plan.split("ReadSchema")[1]
    assert len(f.table.candidates(("i", "=", 30))) < len(f.table.candidates())


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [0.9, 0.1, 0.0])], "i int, x array<double>")
    assert [round(r[0], 3) for r in df.select(v.cosine_query(F.col("x"), [1, 0, 0])).collect()] == [1.0, 0.0, 0.0, 0.994]
    assert [r[0] for r in df.select(v.cosine_query(F.col("x"), [0, 0, 0])).collect()] == [0.0] * 4
    with pytest.raises(Exception, match="elements needed"):
        df.select(v.cosine_query(F.col("x"), [1, 0])).collect()
    odd = spark.createDataFrame([([],), (None,), ([None],), ([3.0, -1.0],)], "x array<double>")
    x = F.col("x")
    got = odd.select(v.reduce_array(x).alias("m"), v.reduce_array(x, "sum").alias("s"), v.reduce_array(x, "max").alias("h"), v.cardinality(x).alias("n"), v.any_element(x, 0, 2, ">", 0).alias("any"), v.any_element(x, 0, 2, ">", 0, "ALL").alias("all"), v.slice_1d(x, 1, 9).alias("p"), v.concat_arrays(x, F.array(F.lit(1.0))).alias("c"), v.transform_elements(x, "log").alias("l")).collect()
    assert [r.m for r in got] == [0.0, None, None, 1.0] and [r.s for r in got][3] == 2.0 and [r.n for r in got] == [0, None, 1, 2]
    assert [r["any"] for r in got] == [False, False, False, True] and [r["all"] for r in got] == [False] * 4
    assert [r.p for r in got] == [[], None, [], [-1.0]] and [r.c for r in got] == [[1.0], [1.0], [None, 1.0], [3.0, -1.0, 1.0]] and math.isnan(got[3].l[1])
    assert v.unnest(odd, "x").count() == 5 and odd.filter(v.element_is(x, 1, "<", 0)).count() == 1
    tensor = spark.createDataFrame([(list(range(24)),), (None,)], "x array<int>")
    assert tensor.select(v.slice_nd(x, [2, 3, 4], [1, ["slice", 0, 3, 2]])).first()[0] == [12, 13, 14, 15, 20, 21, 22, 23]
    with pytest.raises(Exception, match="elements needed"):
        tensor.select(v.slice_nd(x, [5], [])).collect()
    for bad in (lambda: v.slice_1d(x, -1, 2), lambda: v.slice_1d(x, 2, 2), lambda: v.reduce_array(x, "median"), lambda: v.transform_elements(x, "sqrt"), lambda: v.weighted_sum([x], []), lambda: apply_step(df, {"op": "nope"})):
        with pytest.raises(ValueError):
            bad()
    register("double", lambda df, column: df.withColumn(column, F.col(column) * 2))
    assert [r.i for r in apply_step(df, {"op": "double", "column": "i"}).collect()] == [2, 4, 6, 8]


def test_concat_and_matrix(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], None), (None, None), ([], [5.0]), ([None, 1.0], [2.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(v.concat_arrays(F.col("x"), F.col("y"))).collect()] == [[1.0, 2.0, 3.0, 4.0], [], [5.0], [None, 1.0, 2.0]]
    assert [r[0] for r in df.select(v.matrix(F.col("x"), 2)).collect()] == [[[1.0, 2.0], [3.0, 4.0]], None, [], [[None, 1.0]]]
    with pytest.raises(Exception, match="whole rows"):
        df.select(v.matrix(F.col("x"), 3)).collect()
    with pytest.raises(ValueError):
        v.matrix(F.col("x"), 0)


def test_pruning_of_odd_numbers(spark, session):
    rows = [(1, math.nan, 1.5, 3), (2, 150.0, -0.0, 100), (3, -0.0, 0.0, -128), (4, math.inf, math.nan, 127), (5, None, None, None), (6, -math.inf, 7.0, 0)]
    f = session.create_dataset("t", hash_dims={"h": 4, "b": 3}, range_dims={"x": 10, "y": 2}, global_id="i")
    f.write(spark.createDataFrame([(i, x, y, x, b) for i, x, y, b in rows], "i long, x double, y float, h double, b byte"))
    tests = [("x", op, n) for op in ("=", "<", "<=", ">", ">=", "!=") for n in (100, 0.0, -0.0, math.nan, math.inf, 6.999999999, 1e300)]
    tests += [("y", op, n) for op in ("=", "<", ">=") for n in (0, 0.1, 1.9999999999, math.nan)] + [("h", "=", n) for n in (0.0, -0.0, 150, math.nan)]
    tests += [("b", op, n) for op in ("=", "<", ">") for n in (300, -300, 127, 0)] + [("x", "BETWEEN", [100, math.nan]), ("x", "IN", [math.nan, -0.0])]
    for t in tests:
        assert values(f.table.dataframe(parse(t)), "i") == values(f.table.dataframe(parse(t), prune=False), "i"), t
    assert values(f.filter(("x", ">", 100)).df(), "i") == [(1,), (2,), (4,)] and values(f.filter(("h", "=", 0.0)).df(), "i") == [(3,)]


def test_pruning_in_other_time_zones(spark, session):
    days = [datetime.datetime(2024, 3, 9 + d, h) for d in range(4) for h in (0, 5, 23)]
    rows = spark.createDataFrame([(i, d, d.date()) for i, d in enumerate(days)], "i long, n timestamp_ntz, d date").withColumn("t", F.col("n").cast("timestamp"))
    f = session.create_dataset("t", hash_dims={"t": 5}, range_dims={"n": 3_600_000_000, "d": 86_400_000_000}, global_id="i")
    f.write(rows)
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            again = session.read("t").table
            for c in "ndt":
                for op in ("=", "<", ">=", "BETWEEN"):
                    for x in (days[4], days[6].date()):
                        p = parse((c, op, [x, days[9]] if op == "BETWEEN" else x))
                        assert values(again.dataframe(p), "i") == values(again.dataframe(p, prune=False), "i"), (zone, c, op, x)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_never_ended_is_not_read(spark, session):
    f = session.create_dataset("t", hash_dims={"k": 2})
    f.write({"k": ["a", "b"]})
    before = f.table.files.read("_meta/table.json")
    f.write({"k": ["c"]})
    f.filter(col("k") == "a").delete()
    f.table.files.write("_meta/table.json", before)  # as if both had crashed before their commit
    again = session.read("t")
    assert again.count() == 2 and again.df().filter("k = 'a'").count() == 1
    again.write({"k": ["c"]})
    assert values(session.read("t").df(), "global_id", "k") == [(0, "a"), (1, "b"), (2, "c")]
    again.table.vacuum()
    assert session.read("t").count() == 3 and len(again.table.files.names("data/__tid=2")) == 1 and not again.table.files.names("_patches")
    again.table.compact()
    assert session.read("t").count() == 3 and session.read("t", as_of=2).count() == 3
    with pytest.raises(ValueError, match="compaction"):
        session.read("t", as_of=1).count()
    again.table.vacuum()
    again.write({"k": ["d"], "more": [1]})
    assert session.read("t").count() == 4 and session.read("t", as_of=2).df().filter("more is null").count() == 3


def test_locks(spark, session):
    files = session.create_dataset("t").table.files
    with files.lock() as one, pytest.raises(TimeoutError, match="locked"):
        one.check()
        with files.lock(patience=0.3):
            pass
    files.write("_meta/lock", {"owner": "dead", "until": time.time() - 1})
    with files.lock(patience=5.0) as two:
        files.write("_meta/lock", {"owner": "thief", "until": time.time() + 1})
        with pytest.raises(TimeoutError, match="lost"):
            two.check()
    assert files.read("_meta/lock")["owner"] == "thief"  # a lock that was lost is not removed
    assert session.read("t").write({"x": [1]}) == 1


def test_filters_after_steps_skip_partitions(spark, session, capsys):
    f = session.create_dataset("t", chunk_rows=10, hash_dims={"k": 2}, global_id="i")
    f.write({"i": list(range(30)), "k": [i % 3 for i in range(30)], "v": [float(i) for i in range(30)]})
    filters = lambda g: g.df()._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    late = f.with_column("w", col("v") * 2).filter(col("w") > 4).select("i", "w").filter(col("i") == 5)
    assert "__range_i" in filters(late) and values(late.df(), "i", "w") == [(5, 10.0)]
    assert "__range_i" not in filters(f.limit(20).filter(col("i") == 5))
    assert "__range_i" not in filters(f.select((col("i") + 1).alias("i")).filter(col("i") == 5))
    assert values(f.select((col("i") + 10).alias("i")).filter(col("i") == 15).df(), "i") == [(15,)]
    assert "__range_i" not in filters(f.apply({"op": "scalar_op", "column": "v", "operation": "add", "value": 1, "name": "i"}).filter(col("i") == 5))
    late.explain()
    assert "also skipping partitions by" in (said := capsys.readouterr().out) and "Physical Plan" in said


def test_frame_steps(spark, session):
    f = session.create_dataset("t", chunk_rows=10, hash_dims={"k": 2}, global_id="i")
    f.write({"i": list(range(30)), "k": [i % 3 for i in range(30)], "v": [[float(j) for j in range(5)]] * 30})
    g = f.with_column("m", col("v")[1:4].v_reduce("sum")).filter(col("m") == 6).select("i", "m")
    assert g.count() == 30 and g.df().columns == ["i", "m"] and f[1, 10:20].count() == 4 and f[..., 5:7].count() == 2
    assert f.top_k("i", 2).select("i").to_pandas()["i"].tolist() == [29, 28] and g.collect().num_rows == 30
    with pytest.raises(ValueError):
        f.with_column("k", col("i"))
    assert f.table.cache().count() == 30 and f.table.valid_ids(("i", "<", 3)).count() == 3


def test_streams_of_one_name(spark, session, tmp_path):
    """Progress folders of one base name, and a batch that is sent again after its commit."""
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "i").write.parquet(str(tmp_path / f"in{k}"))
    f = session.create_dataset("t", global_id="i")
    for k in range(2):
        append_stream(spark.readStream.schema("i long").parquet(str(tmp_path / f"in{k}")), f.table, str(tmp_path / f"{k}" / "progress")).awaitTermination()
    assert values(f.df(), "i") == [(i,) for i in sorted(range(20), key=str)]
    stream, number = max(f.table.meta["streams"].items())
    assert f.table.write(spark.range(5).withColumnRenamed("id", "i"), (stream, number)) == 2 and f.count() == 20


def test_stream_is_appended_once(spark, session, tmp_path):
    spark.range(50).withColumnRenamed("id", "i").write.parquet(str(tmp_path / "in"))
    f = session.create_dataset("t", global_id="i")
    for _ in range(2):
        append_stream(spark.readStream.schema("i long").parquet(str(tmp_path / "in")), f.table, str(tmp_path / "progress")).awaitTermination()
    assert Table(spark, f.table.path).scan().count() == 50


def test_fine_dimensions_make_few_directories(spark, session):
    """Buckets of which nearly every row has its own: a write keeps some as columns, and reads and prunes as before."""
    f = session.create_dataset("t", chunk_rows=1, hash_dims={"k": 3, "s": 2}, range_dims={"x": 1}, global_id="i")
    rows = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") * 7 % 50).alias("k"), F.when(F.col("id") % 9 > 0, (F.col("id") % 11).cast("string")).alias("s"), (F.col("id") % 1700).cast("double").alias("x"))
    f.write(rows)
    assert len(f.table.candidates()) < 200
    f.write(rows.limit(40).withColumns({"i": F.col("i") + 3000, "more": F.lit(1)}))  # few rows: all buckets are directories
    again = session.read("t")
    assert [sorted(w["keys"]) for w in again.table.meta["writes"]] == [["__hash_k", "__hash_s"], ["__hash_k", "__hash_s", "__range_i", "__range_x"]]
    assert again.count() == 3040 and again.df().columns == ["i", "k", "s", "x", "more"] and session.read("t", as_of=1).count() == 3000
    for p in [("i", "=", 3003), ("i", "BETWEEN", [2990, 3010]), ("x", "<", 1.2), ("x", "=", 3.0), ("k", "=", 14), ("s", "=", "5"), [("x", ">", 1690), "OR", ("s", "IN", ["1", "2"])], [("k", "=", 7), ("i", ">=", 2000)]]:
        kept = values(again.table.dataframe(parse(p)), "i", "x", "more")
        assert kept and kept == values(again.table.dataframe(parse(p), prune=False), "i", "x", "more"), p
    kinds = {d.column: d.bucket(F.col(d.source), again.table.schema[d.source].dataType) for d in again.table.dims}
    assert again.table.dataframe().filter(" or ".join(f"{c} is null" for c in kinds)).count() == 0
    assert all(again.table.dataframe().filter(F.col(c) != b).count() == 0 for c, b in kinds.items())
    plan = again.filter(("x", "=", 3.0)).df()._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(__range_x,3)" in plan  # skips row groups and pages where it is a column
    assert 0 < len(again.table.candidates(("k", "=", 7))) < len(again.table.candidates())
    again.filter(col("i") < 2000).delete()
    again.filter(col("i") == 3003).update({"x": -1.0})
    again.table.compact()
    again.table.vacuum()
    assert session.read("t").count() == 1040 and values(session.read("t").filter(("x", "<", 0)).df(), "i") == [(3003,)]
    g = session.create_dataset("u", chunk_rows=1, global_id="i")
    g.write(rows)  # no bucket of which there are few
    assert g.table.meta["writes"][0]["keys"] == [] and g.count() == 3000 and g.filter(("i", "=", 7)).count() == 1


def test_writes_that_name_no_directories(spark, session):
    """A description from before writes named the buckets that are directories: all of them were."""
    f = session.create_dataset("t", hash_dims={"k": 2}, global_id="i")
    f.write({"i": [1, 2, 3], "k": ["a", "b", "c"]})
    meta = f.table.files.read("_meta/table.json")
    f.table.files.write("_meta/table.json", meta | {"writes": [{n: w[n] for n in ("tid", "try")} for w in meta["writes"]]})
    again = session.read("t")
    again.write({"i": [4], "k": ["a"]})
    assert values(again.df(), "i", "k") == [(1, "a"), (2, "b"), (3, "c"), (4, "a")] and again.filter(("k", "=", "a")).count() == 2
