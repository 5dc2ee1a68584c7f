"""One query for each operator of the engine, over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.functions import col
from gridspan.operators import vector as v
from gridspan.operators.registry import apply_arrow, apply_step
from gridspan.session import Frame, Session
from gridspan.sources.files import workspace
from gridspan.sources.table import Table
from gridspan.streaming.sink import append_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> Frame:
    """events as a stored table: id event_id, hashed by user, in ranges of the event's value."""
    rows = _read(spark, sf_dir, "events")
    frame = Session(spark, workspace(spark)).create_dataset("events", chunk_rows=max(1, rows.count() // 8), hash_dims={"event_type": 4}, range_dims={"user_id": 1000}, global_id="event_id")
    frame.write(rows)
    return frame


def _orders(spark: SparkSession, sf_dir: str, **options) -> Frame:
    frame = Session(spark, workspace(spark)).create_dataset("orders", **({"hash_dims": {"o_orderstatus": 3}, "global_id": "o_orderkey", "chunk_rows": 100_000} | options))
    frame.write(_read(spark, sf_dir, "orders"))
    return frame


def _lines(spark: SparkSession, sf_dir: str) -> Frame:
    frame = Session(spark, workspace(spark)).create_dataset("lineitem", hash_dims={"l_returnflag": 3}, chunk_rows=1_000_000)
    frame.write(_read(spark, sf_dir, "lineitem"))
    return frame


_EVENT = "event_id, ts, user_id, event_type, value, props"
_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


# Scans and sinks -----------------------------------------------------------


@query(f"SELECT {_EVENT} FROM events")
def scan_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).df()


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def scan_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice").df()


@query("SELECT count(*) AS n, min(global_id) AS low, max(global_id) AS high FROM (SELECT row_number() OVER () - 1 AS global_id FROM lineitem)")
def scan_surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).agg(n=F.count_distinct("global_id"), low=F.min("global_id"), high=F.max("global_id")).df()


@query("SELECT event_id FROM events WHERE user_id BETWEEN 20 AND 60")
def scan_valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).table.valid_ids(("user_id", "BETWEEN", [20, 60]))


@query("SELECT event_id, value, value * 2 AS twice FROM events WHERE event_type = 'click'")
def scan_with_arrow_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.compute as pc

    df = _events(spark, sf_dir).filter(col("event_type") == "click").df().select("event_id", "value")
    return apply_arrow(df, lambda t: t.append_column("twice", pc.multiply(t["value"], 2.0)), "event_id long, value double, twice double")


@query(f"SELECT {_ORDER}, o_orderkey % 7 AS extra FROM orders UNION ALL SELECT {_ORDER}, NULL FROM orders WHERE o_orderstatus = 'F'")
def scan_append_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    frame = Session(spark, workspace(spark)).create_dataset("orders", hash_dims={"o_orderstatus": 3}, global_id="o_orderkey")
    frame.write(rows.filter("o_orderstatus = 'F'"))
    frame.write(rows.withColumn("extra", F.col("o_orderkey") % 7))
    return frame.df()


@query(f"SELECT {_EVENT} FROM events")
def scan_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = workspace(spark)
    rows = _read(spark, sf_dir, "events")
    rows.write.parquet(f"{place}/in")
    frame = Session(spark, place).create_dataset("events", hash_dims={"event_type": 4}, global_id="event_id")
    append_stream(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), frame.table, f"{place}/progress").awaitTermination()
    return frame.df()


@query("SELECT o_orderkey // 1000 AS chunk, CAST(('0x' || substr(sha256(o_orderstatus), 1, 16)) AS UBIGINT) % 3 AS by_text, o_custkey % 5 AS by_number, CAST(floor(o_totalprice / 5000) AS BIGINT) AS by_range, count(*) AS n FROM orders GROUP BY ALL")
def scan_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _orders(spark, sf_dir, hash_dims={"o_orderstatus": 3, "o_custkey": 5}, range_dims={"o_totalprice": 5000}, chunk_rows=1000).table
    names = {"__range_o_orderkey": "chunk", "__hash_o_orderstatus": "by_text", "__hash_o_custkey": "by_number", "__range_o_totalprice": "by_range"}
    return table.dataframe().groupBy(*(F.col(c).alias(n) for c, n in names.items())).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice AS price, o_custkey AS customer FROM orders")
def select_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders(spark, sf_dir)
    return f.select("o_orderkey", col("o_totalprice").alias("price"), (col("o_custkey") + 0).alias("customer")).df()


@query("SELECT o_totalprice FROM orders")
def select_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)[col("o_totalprice")].df()


# Filters and projections ---------------------------------------------------


@query("SELECT event_id, value * 2 AS twice FROM events WHERE event_id BETWEEN 100 AND 300 AND event_type = 'click'")
def filter_after_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _events(spark, sf_dir).with_column("twice", col("value") * 2)
    return f.filter(col("event_id").between(100, 300)).filter(col("event_type") == "click").select("event_id", "twice").df()


@query(f"SELECT {_ORDER} FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 200000 AND o_orderstatus <> 'F' AND o_orderkey >= 10 AND o_custkey < 1000000 AND o_orderpriority = '1-URGENT'")
def filter_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders(spark, sf_dir).filter(col("o_totalprice") > 50000).filter(col("o_totalprice") <= 200000)
    return f.filter((col("o_orderstatus") != "F") & (col("o_orderkey") >= 10)).filter(col("o_custkey") < 1_000_000).filter(col("o_orderpriority") == "1-URGENT").df()


@query(f"SELECT {_ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_totalprice < 20000 OR o_orderpriority IN ('2-HIGH', '5-LOW'))")
def filter_nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = [[("o_orderstatus", "=", "F"), "OR", ("o_orderstatus", "=", "P")], "AND", [("o_totalprice", "<", 20000), "OR", ("o_orderpriority", "in", ["2-HIGH", "5-LOW"])]]
    return _orders(spark, sf_dir).filter(tree).df()


@query("SELECT event_id, value * 2.0 + 10 AS score FROM events WHERE value * 2.0 + 10 > 50")
def filter_on_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).with_column("score", col("value") * 2.0 + 10).filter(col("score") > 50).select("event_id", "score").df()


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id >= 10 AND user_id < 400 AND event_id < 5000")
def filter_axis_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)["click", 10:400, :5000].select("event_id", "user_id").df()


@query("SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 17)")
def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).limit(17).agg(n=F.count(F.lit(1))).df()


def _count(spark: SparkSession, sf_dir: str, *filters) -> DataFrame:
    frame = _events(spark, sf_dir)
    for f in filters:
        frame = frame.filter(f)
    return frame.agg(n=F.count(F.lit(1))).df()


@query("SELECT count(*) AS n FROM events WHERE event_id = 500")
def prune_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir, col("event_id") == 500)


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def prune_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir, col("event_type") == "click")


@query("SELECT count(*) AS n FROM events WHERE event_id = 500 AND event_type = 'click'")
def prune_point_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir, col("event_id") == 500, col("event_type") == "click")


@query("SELECT count(*) AS n FROM events")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir)


@query("SELECT count(*) AS n FROM events WHERE event_id >= 100 AND event_id <= 700 AND event_type = 'view'")
def prune_range_and_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir, col("event_id") >= 100, col("event_id") <= 700, col("event_type") == "view")


@query("SELECT count(*) AS n FROM events WHERE event_id BETWEEN 0 AND 1000000 AND event_type IN ('view', 'click')")
def prune_wide_range_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir, col("event_id").between(0, 1_000_000), col("event_type").isin("view", "click"))


@query("SELECT count(*) AS n FROM events WHERE (user_id < 50 OR event_id > 900) AND event_type <> 'view'")
def prune_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(spark, sf_dir, (col("user_id") < 50) | (col("event_id") > 900), col("event_type") != "view")


# Joins, aggregates, order ---------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def join_column_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _orders(spark, sf_dir)
    return frame.select("o_orderkey", "o_totalprice").join(frame.select("o_orderkey", "o_orderpriority"), "o_orderkey").df()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return _orders(spark, sf_dir).join(customers, "o_custkey").select("o_orderkey", "c_name").df()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).df()
    return _read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").filter("c_acctbal > 5000").withColumnRenamed("c_custkey", "o_custkey")
    return _orders(spark, sf_dir).join(customers, "o_custkey", "left").select("o_orderkey", "c_name").df()


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer").filter("c_acctbal > 5000").withColumnRenamed("c_custkey", "o_custkey")
    return _orders(spark, sf_dir).join(customers, "o_custkey", "left_anti").select("o_orderkey").df()


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = Session(spark, workspace(spark)).create_dataset("customer", global_id="c_custkey")
    frame.write(_read(spark, sf_dir, "customer"))
    nations = F.broadcast(_read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"))  # 25 rows whatever the scale
    return frame.join(nations, "c_nationkey").select("c_custkey", "n_name").df()


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, round(avg(l_quantity * l_discount), 6) AS weighed FROM lineitem GROUP BY l_returnflag")
def agg_sum_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _lines(spark, sf_dir).group_by("l_returnflag")
    return f.agg(total=F.round(F.sum("l_extendedprice"), 2), mean=F.round(F.avg("l_extendedprice"), 4), weighed=F.round(F.avg(F.col("l_quantity") * F.col("l_discount")), 6)).df()


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def agg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).group_by("event_type").agg(n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4), low=F.min("value"), high=F.max("value")).df()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(n=F.count(F.lit(1))).df()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).cube("l_returnflag", "l_linestatus").agg(n=F.count(F.lit(1))).df()


@query("SELECT DISTINCT user_id FROM events")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id").distinct().df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", "o_totalprice").top_k("o_totalprice", 25).df()


# Arithmetic -----------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity + 5 AS l_quantity_add_5, l_extendedprice / 3 AS third, l_quantity + l_tax AS l_quantity_plus_l_tax, l_quantity - l_tax AS l_quantity_minus_l_tax, l_quantity * l_tax AS l_quantity_mul_l_tax FROM lineitem")
def scalar_and_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem")
    for step in (
        {"op": "scalar_op", "column": "l_quantity", "operation": "add", "value": 5},
        {"op": "scalar_op", "column": "l_extendedprice", "operation": "div", "value": 3, "name": "third"},
        {"op": "element_wise_add", "a": "l_quantity", "b": "l_tax"},
        {"op": "element_wise_sub", "a": "l_quantity", "b": "l_tax"},
        {"op": "element_wise_mul", "a": "l_quantity", "b": "l_tax"},
    ):
        df = apply_step(df, step)
    return df.select("l_orderkey", "l_linenumber", "l_quantity_add_5", "third", "l_quantity_plus_l_tax", "l_quantity_minus_l_tax", "l_quantity_mul_l_tax")


@query("SELECT l_orderkey, l_linenumber, l_quantity - 2 AS l_quantity_sub_2, l_quantity * 3 AS l_quantity_mul_3, l_quantity + 1 AS more FROM lineitem")
def scalar_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _lines(spark, sf_dir)
    for operation, value, name in (("sub", 2, None), ("mul", 3, None), ("add", 1, "more")):
        f = f.apply({"op": "scalar_op", "column": "l_quantity", "operation": operation, "value": value} | ({"name": name} if name else {}))
    return f.select("l_orderkey", "l_linenumber", "l_quantity_sub_2", "l_quantity_mul_3", "more").df()


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_discount + l_tax AS sum_l_quantity_l_discount_l_tax, l_quantity * l_discount * l_tax AS prod_l_quantity_l_discount_l_tax, l_quantity * 0.5 + l_tax * 2.0 AS weighted_sum FROM lineitem")
def sums_and_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "lineitem")
    three = ["l_quantity", "l_discount", "l_tax"]
    for step in ({"op": "sum", "columns": three}, {"op": "product", "columns": three}, {"op": "weighted_sum", "columns": ["l_quantity", "l_tax"], "weights": [0.5, 2.0]}):
        df = apply_step(df, step)
    return df.select("l_orderkey", "l_linenumber", "sum_l_quantity_l_discount_l_tax", "prod_l_quantity_l_discount_l_tax", "weighted_sum")


@query("SELECT o_orderkey, o_custkey // 7 AS whole, o_totalprice * (1 - 0.1) AS less, 2 * o_custkey + 1 AS odd FROM orders")
def expression_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders(spark, sf_dir).with_column("whole", col("o_custkey") / 7).with_column("less", col("o_totalprice") * (1 - 0.1)).with_column("odd", 2 * col("o_custkey") + 1)
    return f.select("o_orderkey", "whole", "less", "odd").df()


# Vectors --------------------------------------------------------------------

_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
_LIST = "[" + ", ".join(map(str, _QUERY)) + "]"
_E = "CAST(embedding AS DOUBLE[])"


def _elements(df: DataFrame, *arrays: str) -> DataFrame:
    """A row for each element of some arrays, as tables of plain values are easier to compare."""
    parts = [df.select("vec_id", F.lit(a).alias("name"), F.posexplode(a).alias("place", "x")) for a in arrays]
    return sum_union([p.withColumn("place", F.col("place").cast("long")).withColumn("x", F.col("x").cast("double")) for p in parts])


def sum_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _elements_sql(**arrays: str) -> str:
    return " UNION ALL ".join(
        f"SELECT vec_id, '{name}' AS name, unnest(range(len(a))) AS place, CAST(unnest(a) AS DOUBLE) AS x FROM (SELECT vec_id, {sql} AS a FROM embeddings)" for name, sql in arrays.items()
    )


def _vectors(spark: SparkSession, sf_dir: str) -> Frame:
    frame = Session(spark, workspace(spark)).create_dataset("embeddings", hash_dims={"label": 4}, global_id="vec_id")
    frame.write(_read(spark, sf_dir, "embeddings"))
    return frame


@query(f"SELECT vec_id, round(list_cosine_similarity({_E}, {_LIST}), 6) AS score FROM embeddings")
def vector_cosine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).with_column("s", col("embedding").cosine_sim(_QUERY)).df().select("vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity({_E}, {_LIST}), 6) AS score FROM embeddings WHERE list_cosine_similarity({_E}, {_LIST}) > 0.1 AND label < 5")
def vector_search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir).filter(col("label") < 5).with_column("s", col("embedding").cosine_sim(_QUERY)).filter(col("s") > 0.1)
    return f.df().select("vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity({_E}, {_LIST}) DESC, vec_id LIMIT 10")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).with_column("s", col("embedding").cosine_sim(_QUERY)).top_k("s", 10).select("vec_id").df()


@query(f"SELECT vec_id, round(list_cosine_similarity({_E}, list_reverse({_E})), 6) AS score FROM embeddings")
def vector_cosine_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).df().withColumn("back", F.reverse("embedding"))
    return df.select("vec_id", F.round(v.cosine_pair(F.col("embedding"), F.col("back")), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(list_cosine_similarity([l_quantity, l_tax], [l_discount, l_extendedprice]), 6) AS score FROM lineitem")
def vector_cosine_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = apply_step(_read(spark, sf_dir, "lineitem"), {"op": "cosine_similarity", "left": ["l_quantity", "l_tax"], "right": ["l_discount", "l_extendedprice"]})
    return df.select("l_orderkey", "l_linenumber", F.round("cosine_sim", 6).alias("score"))


@query(_elements_sql(part="embedding[11:20]", tail="embedding[61:64]"))
def vector_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir).with_column("part", col("embedding")[10:20]).with_column("tail", col("embedding").v_slice(60, 100))
    return _elements(f.df(), "part", "tail")


@query(_elements_sql(part="[embedding[9], embedding[11], embedding[17], embedding[19]]"))
def vector_slice_nd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_vectors(spark, sf_dir).with_column("part", col("embedding").v_slice_nd((8, 8), (1, 3), slice(0, 4, 2))).df(), "part")


@query(f"SELECT vec_id, round(list_avg({_E}), 6) AS mean, round(list_sum({_E}), 5) AS total, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high, len(embedding) AS n, round(list_avg({_E}[1:16]), 6) AS head FROM embeddings")
def vector_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = col("embedding")
    f = _vectors(spark, sf_dir)
    for name, how in (("a", "mean"), ("b", "sum"), ("low", "min"), ("high", "max")):
        f = f.with_column(name, e.v_reduce(how))
    f = f.with_column("n", e.v_len()).with_column("c", e.v_slice(0, 16).v_reduce("mean"))
    return f.df().select("vec_id", F.round("a", 6).alias("mean"), F.round("b", 5).alias("total"), "low", "high", F.col("n").cast("long").alias("n"), F.round("c", 6).alias("head"))


@query("SELECT vec_id FROM embeddings WHERE embedding[4] BETWEEN -0.1 AND 0.1")
def vector_filter_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).apply({"op": "filter_by_index", "column": "embedding", "index": 3, "condition": "BETWEEN", "bound": [-0.1, 0.1]}).select("vec_id").df()


@query(
    " UNION ALL ".join(f"SELECT vec_id, '{op}' AS test FROM embeddings WHERE embedding[2] {op} 0.05" for op in (">", ">=", "<", "<="))
    + " UNION ALL SELECT vec_id, '=' FROM embeddings WHERE len(embedding) = 64 UNION ALL SELECT vec_id, '!=' FROM embeddings WHERE embedding[2] <> 0"
)
def vector_filter_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir)
    tests = [f.apply({"op": "filter_by_index", "column": "embedding", "index": 1, "condition": op, "bound": 0.05}).df().select("vec_id", F.lit(op).alias("test")) for op in (">", ">=", "<", "<=")]
    tests.append(f.with_column("n", col("embedding").v_len()).filter(col("n") == 64).df().select("vec_id", F.lit("=").alias("test")))
    tests.append(f.apply({"op": "filter_by_index", "column": "embedding", "index": 1, "condition": "!=", "bound": 0}).df().select("vec_id", F.lit("!=").alias("test")))
    return sum_union(tests)


@query("SELECT vec_id, r AS row, CAST(list_sum(CAST(embedding[r * 16 + 1:r * 16 + 16] AS DOUBLE[])) * 1000 AS BIGINT) AS total FROM embeddings, (SELECT unnest(range(4)) AS r)")
def vector_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).apply({"op": "matrix", "column": "embedding", "width": 16, "name": "rows"}).df()
    df = df.select("vec_id", F.posexplode("rows").alias("row", "part"))
    return df.select("vec_id", F.col("row").cast("long").alias("row"), F.round(v.reduce_array(F.col("part"), "sum") * 1000).cast("long").alias("total"))


@query("SELECT vec_id, 'any' AS kind FROM embeddings WHERE len(list_filter(embedding[1:8], lambda x: x > 0.2)) > 0 UNION ALL SELECT vec_id, 'all' FROM embeddings WHERE len(list_filter(embedding[1:3], lambda x: x > 0)) = 3")
def vector_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir)
    some = f.apply({"op": "filter_range", "column": "embedding", "start": 0, "stop": 8, "condition": ">", "bound": 0.2}).df()
    each = f.apply({"op": "filter_range", "column": "embedding", "start": 0, "stop": 3, "condition": ">", "bound": 0, "quantifier": "ALL"}).df()
    return some.select("vec_id", F.lit("any").alias("kind")).union(each.select("vec_id", F.lit("all")))


@query(_elements_sql(more=f"list_transform({_E}, lambda x: x + 1.5)", twice=f"list_transform({_E}, lambda x: x * 2.0)"))
def vector_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = col("embedding")
    return _elements(_vectors(spark, sf_dir).with_column("more", e.v_transform("add", 1.5)).with_column("twice", e.v_transform("mul", 2)).df(), "more", "twice")


@query(f"SELECT vec_id, round(list_sum(list_transform({_E}, lambda x: ln(abs(x) + 1))), 5) AS total FROM embeddings")
def vector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).df().withColumn("up", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1))
    return df.select("vec_id", F.round(v.reduce_array(v.transform_elements(F.col("up"), "log"), "sum"), 5).alias("total"))


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def vector_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", "embedding").apply({"op": "unnest", "column": "embedding"}).df()


@query(_elements_sql(ends="list_concat(embedding[1:2], embedding[63:64])"))
def vector_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir).with_column("a", col("embedding")[0:2]).with_column("b", col("embedding")[62:64])
    return f.apply({"op": "concat", "a": "a", "b": "b", "name": "ends"}).df().transform(lambda df: _elements(df, "ends"))


# Updates and deletes --------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * (1 - 0.15) ELSE o_totalprice END AS o_totalprice FROM orders")
def update_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders(spark, sf_dir)
    f.filter(col("o_orderstatus") == "F").update({"o_totalprice": col("o_totalprice") * (1 - 0.15)})
    return f.select("o_orderkey", "o_orderstatus", "o_totalprice").df()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_orderkey ELSE o_custkey END AS o_custkey FROM orders WHERE NOT (CASE WHEN o_totalprice > 100000 THEN 'P' ELSE o_orderstatus END = 'P' AND o_orderpriority = '5-LOW')")
def update_dimension_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders(spark, sf_dir)
    f.filter(col("o_totalprice") > 100000).update({"o_orderstatus": "P", "o_custkey": col("o_orderkey")})
    f.filter((col("o_orderstatus") == "P") & (col("o_orderpriority") == "5-LOW")).delete()
    return f.select("o_orderkey", "o_orderstatus", "o_custkey").df()


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(4 AS DOUBLE) ELSE value END AS value FROM events")
def update_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _events(spark, sf_dir)
    for i in range(5):
        f.filter(col("event_type") == "click").update({"value": i})
    return f.select("event_id", "value").df()


@query("SELECT event_id, value FROM events WHERE NOT coalesce(event_type = 'view' OR value > 80, false)")
def delete_then_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _events(spark, sf_dir)
    f.filter((col("event_type") == "view") | (col("value") > 80)).delete()
    f.table.compact()
    f.table.vacuum()
    return Frame(Table(spark, f.table.path)).select("event_id", "value").df()


@query("SELECT 1 AS at, count(*) AS n FROM events UNION ALL SELECT 2, count(*) FROM events WHERE event_type <> 'click' UNION ALL SELECT 3, 0")
def read_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _events(spark, sf_dir)
    f.filter(col("event_type") == "click").delete()
    f.delete()
    counts = [Frame(f.table, as_of=t).agg(n=F.count(F.lit(1))).df().select(F.lit(t).alias("at"), "n") for t in (1, 2, 3)]
    return counts[0].union(counts[1]).union(counts[2])


@query(f"SELECT vec_id, label FROM embeddings WHERE NOT (list_cosine_similarity({_E}, {_LIST}) > 0.05)")
def delete_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir)
    f.filter(col("embedding").cosine_sim(_QUERY) > 0.05).delete()
    return f.select("vec_id", "label").df()


@query(f"SELECT vec_id, CASE WHEN list_cosine_similarity({_E}, {_LIST}) > 0.05 THEN label + 100 ELSE label END AS label FROM embeddings")
def update_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _vectors(spark, sf_dir)
    f.filter(col("embedding").cosine_sim(_QUERY) > 0.05).update({"label": col("label") + 100})
    return f.select("vec_id", "label").df()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END AS first, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END AS second FROM orders")
def update_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of an update are of the row before it."""
    rows = _read(spark, sf_dir, "orders").withColumns({"first": F.col("o_orderkey"), "second": F.col("o_custkey")})
    f = Session(spark, workspace(spark)).create_dataset("orders", hash_dims={"o_orderstatus": 3}, global_id="o_orderkey")
    f.write(rows)
    f.filter(col("o_orderstatus") == "F").update({"first": col("second"), "second": col("first")})
    return f.select("o_orderkey", "first", "second").df()


@query("SELECT 'before' AS at, o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'after', o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderstatus <> 'P'")
def reopened_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes outlive the session that made them, beside a write that never ended."""
    f = _orders(spark, sf_dir)
    f.update({"o_totalprice": col("o_totalprice") + 1})
    f.filter(col("o_orderstatus") == "P").delete()
    f.table._put(f.table.dataframe().select(*f.table.schema.names), 4)
    again, then = Frame(Table(spark, f.table.path)), Frame(Table(spark, f.table.path), as_of=1)
    old = then.select("o_orderkey", "o_totalprice").df().select(F.lit("before").alias("at"), "o_orderkey", "o_totalprice")
    return old.union(again.select("o_orderkey", "o_totalprice").df().select(F.lit("after"), "o_orderkey", "o_totalprice"))
