"""Command line: python -m trellis triangles|ktruss|partition|design|generate|network ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from trellis import session
from trellis.operators import blockmodel, canon, dnn, evaluation, kronecker, triangles, truss
from trellis.sources import binary, matrix_market, text
from trellis.streaming import staged


def _graph(spark: SparkSession, path: str, form: str) -> DataFrame:
    if form == "mm":
        return matrix_market.read_graph(spark, path)
    if form == "bin":
        return binary.read_edges(spark, path)
    return text.read_edges(spark, path)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trellis")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("triangles", "ktruss"):
        c = commands.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format", choices=("tsv", "mm", "bin"), default="tsv")
        c.add_argument("--k", type=int, default=3)
        c.add_argument("--output")
    c = commands.add_parser("partition", help="a file of edges, or a folder of stages with --parts")
    c.add_argument("path")
    c.add_argument("--parts", type=int)
    c.add_argument("--truth")
    c.add_argument("--seed", type=int, default=1)
    c.add_argument("--sweeps", type=int, default=blockmodel.SWEEPS)
    c.add_argument("--output")
    for name in ("design", "generate"):
        c = commands.add_parser(name)
        c.add_argument("leaves", type=int, nargs="+")
        c.add_argument("--kind", type=int, choices=(0, 1, 2), default=2)
        c.add_argument("--output")
    c = commands.add_parser("network")
    c.add_argument("features")
    c.add_argument("layers", help="pattern of layer files")
    c.add_argument("--count", type=int, required=True)
    c.add_argument("--neurons", type=int, default=1024)
    c.add_argument("--truth")
    return p


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = session.prepare(SparkSession.builder.getOrCreate())
    if a.command == "triangles":
        und = canon.undirected(_graph(spark, a.path, a.format))
        tri = session.materialize(triangles.enumerate_triangles(und), "triangles")
        print("triangles:", tri.count())
        for r in triangles.k_counts(tri, None).orderBy("k").collect():
            print(f"K[{r['k']}] = {r['n']}")
        if a.output:
            text.write_table(tri, a.output)
    elif a.command == "ktruss":
        kept = truss.ktruss(canon.undirected(_graph(spark, a.path, a.format)), a.k)
        print("edges:", kept.count())
        if a.output:
            text.write_table(kept, a.output)
    elif a.command == "partition":
        edges = staged.read_stages(spark, a.path, a.parts).select("src", "dst", "weight") if a.parts else text.read_edges(spark, a.path)
        found = blockmodel.partition(edges, a.seed, a.sweeps)
        print("blocks:", found.select("block").distinct().count())
        if a.truth:
            table = session.materialize(evaluation.contingency(text.read_partition(spark, a.truth), found), "contingency")
            print("accuracy:", evaluation.accuracy(table).first()[0])
            for df in (evaluation.pair_counts(table), evaluation.information(table)):
                for k, v in df.first().asDict().items():
                    print(f"{k}: {v}")
        if a.output:
            text.write_partition(found, a.output)
    elif a.command == "design":
        for k, v in kronecker.theory(a.leaves, a.kind).items():
            print(f"{k}: {v}")
        if a.output:
            text.write_named_counts(kronecker.degree_table(spark, a.leaves, a.kind), a.output)
    elif a.command == "generate":
        half = (len(a.leaves) + 1) // 2
        text.write_triples(kronecker.generate(spark, a.leaves[:half], a.leaves[half:], a.kind), a.output)
    else:
        y, w = text.read_features(spark, a.features), text.read_layers(spark, a.layers)
        if a.truth:
            print(dnn.run_challenge(y, w, text.read_categories(spark, a.truth), a.count, dnn.BIAS[a.neurons]))
        else:
            print("categories:", dnn.categories(dnn.infer(y, w, a.count, dnn.BIAS[a.neurons])).count())


if __name__ == "__main__":
    main()
