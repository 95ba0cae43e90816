"""Sparse neural-network inference: Y <- min(max(Y W + bias, 0), cap), over triples.

Features are (img, neuron, val), layers (layer, i, j, w); the bias applies where the product is not zero.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import materialize, release

CAP = 32.0
# Neurons -> bias of the published networks.
BIAS = {1024: -0.3, 4096: -0.35, 16384: -0.4, 65536: -0.45}
#: Weights that are broadcast at most: 64 MB at 64 bytes each once hashed.
BROADCAST_ROWS = (64 << 20) // 64
CUT_EVERY = 8


def layer_step(y: DataFrame, w: DataFrame, bias: float, cap: float = CAP, small: bool = False) -> DataFrame:
    """One layer.  With a small (checked) W and Y partitioned by img no row of Y is exchanged."""
    w = w.select(F.col("i").alias("neuron"), "j", "w")
    z = y.join(F.broadcast(w) if small else w, "neuron").groupBy("img", "j").agg(F.sum(F.col("val") * F.col("w")).alias("z")).where("z <> 0")
    val = F.least(F.greatest(F.col("z") + F.lit(bias), F.lit(0.0)), F.lit(cap))
    return z.select("img", F.col("j").alias("neuron"), val.alias("val")).where("val > 0")


def infer(y0: DataFrame, weights: DataFrame, layers: int, bias: float, cap: float = CAP) -> DataFrame:
    """All layers 1 .. n in turn.  A layer of at most BROADCAST_ROWS weights is broadcast, a larger one joined."""
    sizes = {r["layer"]: r["n"] for r in weights.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    y = y0.select("img", "neuron", "val").repartition("img")
    cut = None
    for k in range(1, layers + 1):
        y = layer_step(y, weights.where(F.col("layer") == k), bias, cap, sizes.get(k, 0) <= BROADCAST_ROWS)
        if k % CUT_EVERY == 0 and k < layers:  # plans stay short; the partitioning is made anew
            new = materialize(y, "dnn")
            if cut is not None:
                release(cut)
            cut, y = new, new.repartition("img")
    return y


def categories(y: DataFrame) -> DataFrame:
    """Images with any activation left."""
    return y.groupBy("img").agg(F.sum("val").alias("total")).where("total <> 0").select(F.col("img").alias("category"))


def verify(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(category, side) of those that only one side has: empty if the challenge is passed."""
    a = found.exceptAll(truth).withColumn("side", F.lit("found"))
    return a.unionByName(truth.exceptAll(found).withColumn("side", F.lit("truth")))


def pad(y: DataFrame, neurons: int) -> DataFrame:
    """Entries of an image whose neuron is beyond the declared number are an error of the input, not dropped."""
    inside = (F.col("neuron") >= 1) & (F.col("neuron") <= neurons)
    wrong = F.raise_error(F.concat(F.lit(f"a neuron beyond the {neurons} declared: "), F.col("neuron").cast("string")))
    return y.withColumn("neuron", F.when(inside, F.col("neuron")).otherwise(wrong.cast("long")))


def run_challenge(y0: DataFrame, weights: DataFrame, truth: DataFrame, layers: int, bias: float) -> dict:
    """Inference with the customary figures: edges, seconds and rates of reading and inference, and whether it passed."""
    began = time.perf_counter()
    weights = materialize(weights.where(F.col("layer") <= layers), "dnn-weights")
    edges, images = weights.count(), y0.select("img").distinct().count()
    read = time.perf_counter() - began
    began = time.perf_counter()
    cats = materialize(categories(infer(y0, weights, layers, bias)), "categories")
    took = time.perf_counter() - began
    return {"edges": edges, "images": images, "read_seconds": read, "read_rate": edges / read, "seconds": took, "rate": images * edges / took, "passed": verify(cats, truth).isEmpty()}
