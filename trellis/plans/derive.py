"""Graphs and matrices that the relational test tables hold, each with the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import canon, tiles

SUPPLIER_BASE = 1_000_000_000
STAGES = list(range(1, 11))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): parts that share an order, once for every two lines that do."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    y = x.withColumnRenamed("a", "b")
    return x.join(y, "l_orderkey").where("a < b").select("a", "b")


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): parts that share an order."""
    return co_purchase_pairs(spark, sf_dir).distinct()


def co_purchase_cells(spark: SparkSession, sf_dir: str) -> tiles.Packed:
    """The same graph in cells."""
    return tiles.packed(co_purchase_pairs(spark, sf_dir))


CO_PURCHASE = "SELECT DISTINCT l1.l_partkey AS a, l2.l_partkey AS b FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_partkey < l2.l_partkey"


def co_supply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): suppliers that share an order, once for every two lines that do."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"))
    y = x.withColumnRenamed("a", "b")
    return x.join(y, "l_orderkey").where("a < b").select("a", "b")


def co_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): suppliers that share an order."""
    return co_supply_pairs(spark, sf_dir).distinct()


CO_SUPPLY = "SELECT DISTINCT l1.l_suppkey AS a, l2.l_suppkey AS b FROM lineitem l1 JOIN lineitem l2 ON l1.l_orderkey = l2.l_orderkey AND l1.l_suppkey < l2.l_suppkey"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): customer to supplier, weighted by order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    e = lines.join(orders, "l_orderkey").groupBy("src", (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst"))
    return e.agg(F.count("*").cast("double").alias("weight"))


TRADE = f"SELECT o_custkey AS src, l_suppkey + {SUPPLIER_BASE} AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


def trade_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, block): nations of customers 0 .. 24 and of suppliers 25 .. 49."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").cast("long").alias("block"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIER_BASE).alias("node"), (F.col("s_nationkey") + 25).cast("long").alias("block"))
    return c.unionByName(s)


TRADE_BLOCKS = f"SELECT c_custkey AS node, CAST(c_nationkey AS BIGINT) AS block FROM customer UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, CAST(s_nationkey + 25 AS BIGINT) FROM supplier"


def nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) between nations: a graph of 50 nodes."""
    e, p = trade(spark, sf_dir), trade_blocks(spark, sf_dir)
    return e.join(p.toDF("src", "s"), "src").join(p.toDF("dst", "d"), "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrix (i = user, j = key of the event's properties, v = events)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("i"), F.get_json_object("props", "$.k").cast("long").alias("j"))
    return e.where("j is not null").groupBy("i", "j").agg(F.count("*").cast("double").alias("v"))


VISITS = "SELECT user_id AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2"


def staged_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight, stage): user to key, stages of three days, the last open."""
    e = table(spark, sf_dir, "events")
    stage = F.least(F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3) + 1, F.lit(10)).cast("int")
    dst = F.get_json_object("props", "$.k").cast("long") + 1_000_000
    return e.select(F.col("user_id").alias("src"), dst.alias("dst"), F.lit(1.0).alias("weight"), stage.alias("stage")).where("dst is not null")


STAGED_VISITS = """SELECT user_id AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1000000 AS dst, 1.0 AS weight,
  CAST(least(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) + 1, 10) AS INTEGER) AS stage
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, neuron, val): embedding entries above 0.1, neurons from 1."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("p", "x"))
    return e.where(F.col("x") > F.lit(0.1).cast("float")).select("img", (F.col("p") + 1).cast("long").alias("neuron"), F.col("x").cast("double").alias("val"))


FEATURES = """SELECT vec_id AS img, CAST(p AS BIGINT) AS neuron, CAST(embedding[p] AS DOUBLE) AS val
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS p FROM embeddings) WHERE embedding[p] > CAST(0.1 AS FLOAT)"""
NEURONS, LAYERS, NET_BIAS = 64, 3, -0.03125


def network(spark: SparkSession) -> DataFrame:
    """(layer, i, j, w): weights in sixteenths, so products of few terms stay exact."""
    n = spark.range(NEURONS * NEURONS * LAYERS)
    layer, i, j = F.floor(F.col("id") / (NEURONS * NEURONS)) + 1, F.floor(F.col("id") / NEURONS) % NEURONS + 1, F.col("id") % NEURONS + 1
    n = n.select(layer.cast("int").alias("layer"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    w = (((F.col("i") * 7 + F.col("j") * 13 + F.col("layer") * 5) % 11 - 4) / 16.0).alias("w")
    return n.select("layer", "i", "j", w).where((F.col("i") * 3 + F.col("j") * 5 + F.col("layer")) % 4 == 0).where("w <> 0")


NETWORK = f"""SELECT layer, i, j, ((i * 7 + j * 13 + layer * 5) % 11 - 4) / 16.0 AS w
  FROM (SELECT unnest(generate_series(1, {LAYERS})) AS layer), (SELECT unnest(generate_series(1, {NEURONS})) AS i), (SELECT unnest(generate_series(1, {NEURONS})) AS j)
  WHERE (i * 3 + j * 5 + layer) % 4 = 0 AND (i * 7 + j * 13 + layer * 5) % 11 <> 4"""


def part_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brand and size class of all parts as two partitions."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("block")), p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 5).cast("long").alias("block"))


PART_TABLE = "SELECT p_brand AS t, CAST(p_size % 5 AS BIGINT) AS a, count(*) AS n FROM part GROUP BY 1, 2"


def symmetric_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.symmetric(co_purchase(spark, sf_dir))
