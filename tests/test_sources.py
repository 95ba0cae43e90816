"""Readers, writers and streams."""

import struct

import pytest

from trellis.sources import binary, matrix_market, text
from trellis.streaming import staged


def test_edges_without_weights(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("1\t2\n2\t3\n\n")
    e = text.read_edges(spark, str(tmp_path / "g.tsv"))
    assert sorted(map(tuple, e.collect())) == [(1, 2, 1.0), (2, 3, 1.0)]
    assert tuple(text.edge_stats(e).first()) == (3, 2)


def test_partition_file(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\t1\n2\t3\n3\t-1\n")
    p = text.read_partition(spark, str(tmp_path / "p.tsv"))
    assert sorted(map(tuple, p.collect())) == [(1, 0), (2, 2), (3, None)]
    text.write_partition(p, str(tmp_path / "q"))
    assert sorted(map(tuple, text.read_partition(spark, str(tmp_path / "q")).collect())) == [(1, 0), (2, 2), (3, None)]


def test_triples_sum_duplicates(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\t1\t2\n1\t1\t3\n2\t2\t1\n2\t2\t-1\n")
    assert [tuple(r) for r in text.read_triples(spark, str(tmp_path / "t.tsv")).collect()] == [(1, 1, 5.0)]


SYMMETRIC = "%%MatrixMarket MATRIX Coordinate PATTERN symmetric\n% a comment\n%\n\n3 3 3\n2 1\n3 1\n3 3\n"


def test_matrix_market_symmetric(spark, tmp_path):
    (tmp_path / "m.mtx").write_text(SYMMETRIC)
    e = matrix_market.read_graph(spark, str(tmp_path / "m.mtx"))
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [(1, 2), (1, 3), (2, 1), (3, 1), (3, 3)]


@pytest.mark.parametrize(
    "banner",
    ["%%MatrixMarket matrix array real general", "%%MatrixMarket matrix coordinate real hermitian", "%%MatrixMarket matrix array pattern general", "%%Matrix matrix coordinate real general", "%%MatrixMarket vector coordinate real general", "%%MatrixMarket matrix coordinate real"],
)
def test_matrix_market_refuses(spark, tmp_path, banner):
    (tmp_path / "m.mtx").write_text(banner + "\n2 2 1\n1 1 1 1\n")
    with pytest.raises(matrix_market.FormatError):
        matrix_market.read_matrix(spark, str(tmp_path / "m.mtx"))


def cells(m):
    return {(r["i"], r["j"]): complex(r["v"], r["im"]) if "im" in m.columns else r["v"] for r in m.collect()}


@pytest.mark.parametrize("symmetry", ["general", "symmetric", "skew-symmetric"])
@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_matrix_market_arrays(spark, tmp_path, symmetry, size):
    """Arrays are stored by columns, symmetric ones as lower triangles; what is written reads back."""
    want = {(i, j): float(10 * i + j) for i in range(1, size + 1) for j in range(1, size + 1) if (i + j) % 3}
    if symmetry != "general":
        sign = -1 if symmetry == "skew-symmetric" else 1
        want = {(i, j): v for (i, j), v in want.items() if i > j or (i == j and sign > 0)}
    kind = matrix_market.Kind("array", "real", symmetry)
    m = spark.createDataFrame([(i, j, v) for (i, j), v in want.items()], "i long, j long, v double")
    matrix_market.write_matrix(m, str(tmp_path / "a"), size, size, kind, "by columns")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*"))).splitlines()
    assert lines[:3] == [f"%%MatrixMarket matrix array real {symmetry}", "% by columns", f"{size} {size}"]
    cellwise = [(i, j) for j in range(1, size + 1) for i in range(1, size + 1) if symmetry == "general" or i > j or (i == j and symmetry == "symmetric")]
    assert [float(x) for x in lines[3:]] == [want.get(c, 0.0) for c in cellwise]
    head, back = matrix_market.read_matrix(spark, str(tmp_path / "a"))
    assert head.kind == kind and cells(back) == want
    if symmetry == "skew-symmetric":
        assert cells(matrix_market.expand_symmetry(head, back)) == want | {(j, i): -v for (i, j), v in want.items()}


def test_matrix_market_complex(spark, tmp_path):
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 3 0\n2 1 1.5 -2\n")
    head, m = matrix_market.read_matrix(spark, str(tmp_path / "c.mtx"))
    assert cells(m) == {(1, 1): 3, (2, 1): 1.5 - 2j}
    assert cells(matrix_market.expand_symmetry(head, m)) == {(1, 1): 3, (2, 1): 1.5 - 2j, (1, 2): 1.5 + 2j}
    matrix_market.write_matrix(m, str(tmp_path / "d"), 2, 2, head.kind)
    assert cells(matrix_market.read_matrix(spark, str(tmp_path / "d"))[1]) == cells(m)
    matrix_market.write_matrix(m, str(tmp_path / "e"), 2, 2, matrix_market.Kind("array", "complex", "general"))
    assert cells(matrix_market.read_matrix(spark, str(tmp_path / "e"))[1]) == cells(m)


def test_matrix_market_in_parts(spark, tmp_path, monkeypatch):
    """A folder of many parts, and the triangles that graph readers keep."""
    monkeypatch.setattr(matrix_market, "PART_ENTRIES", 10)
    want = {(i, j): float(i * 100 + j) for i in range(1, 9) for j in range(1, 9) if (i * j) % 3}
    m = spark.createDataFrame([(i, j, v) for (i, j), v in want.items()], "i long, j long, v double")
    for layout in ("coordinate", "array"):
        path = str(tmp_path / layout)
        matrix_market.write_matrix(m, path, 8, 8, matrix_market.Kind(layout, "real", "general"))
        assert len(list((tmp_path / layout).glob("part-*"))) > 3
        assert cells(matrix_market.read_matrix(spark, path)[1]) == want
        assert cells(matrix_market.read_matrix(spark, path, "lower")[1]) == {(i, j): v for (i, j), v in want.items() if i > j}
        assert cells(matrix_market.read_matrix(spark, path, "upper")[1]) == {(i, j): v for (i, j), v in want.items() if i < j}


def test_matrix_market_wants_square_graphs(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 3 1\n1 3 4\n")
    assert matrix_market.read_matrix(spark, str(tmp_path / "m.mtx"))[1].first()["v"] == 4.0
    with pytest.raises(matrix_market.FormatError):
        matrix_market.read_graph(spark, str(tmp_path / "m.mtx"))


def test_matrix_market_writer(spark, tmp_path):
    m = spark.createDataFrame([(2, 1, 1.5), (1, 2, -2.0)], "i long, j long, v double")
    matrix_market.write_matrix(m, str(tmp_path / "o"), 2, 2, comment="two cells")
    head, back = matrix_market.read_matrix(spark, str(tmp_path / "o"))
    assert (head.rows, head.cols, head.entries) == (2, 2, 2)
    assert sorted(map(tuple, back.collect())) == [(1, 2, -2.0), (2, 1, 1.5)]


def test_binary_edges(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(struct.pack("<6q", 0, 1, 1, 2, 5, 0))
    e = binary.read_edges(spark, str(tmp_path / "e.bin"))
    assert sorted(map(tuple, e.collect())) == [(0, 1), (1, 2), (5, 0)]
    assert sorted(map(tuple, binary.read_edges(spark, str(tmp_path / "e.bin"), whole=16).collect())) == [(0, 1), (1, 2), (5, 0)]
    assert binary.slice_bounds(10, 3) == [(0, 4), (4, 3), (7, 3)]


def test_layers(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"n4-l{k}.tsv").write_text(f"1\t2\t{k}.5\n")
    got = text.read_layers(spark, str(tmp_path / "n4-l*.tsv"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 1.5), (2, 1, 2, 2.5)]


def test_streamed_stages_equal_the_batch(spark, tmp_path):
    pieces = {1: [(1, 2), (2, 3)], 2: [(1, 3), (3, 4)], 3: [(2, 4), (4, 4), (1, 2)]}
    for k, p in pieces.items():
        (tmp_path / f"g_{k}.tsv").write_text("".join(f"{a}\t{b}\t1\n" for a, b in p))
    batch = staged.read_stages(spark, str(tmp_path))
    assert sorted(map(tuple, staged.cumulative_stats(batch, [1, 2, 3]).collect())) == [(1, 3, 2, 2), (2, 4, 4, 4), (3, 4, 7, 5)]
    assert sorted(map(tuple, staged.cumulative_triangles(batch, [1, 2, 3]).collect())) == [(1, 0), (2, 1), (3, 2)]
    totals = []
    counter = staged.TriangleCounter(str(tmp_path / "state"), lambda _, n: totals.append(n))
    run = staged.stream_stages(spark, str(tmp_path)).writeStream.foreachBatch(counter).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert counter.total(spark) == 2
    assert totals == sorted(totals)


def test_triangle_counts_survive_restarts_and_replays(spark, tmp_path):
    """Every batch goes to a sink made anew; some come twice, with other rows the first time."""
    batches = [[(1, 2), (2, 3), (2, 1)], [(1, 3), (3, 4), (3, 3)], [(2, 4), (4, 1), (1, 2)], []]
    want = [0, 1, 4, 4]
    for k, b in enumerate(batches):
        for rows in ([(7, 8), (8, 9), (7, 9), (1, 3)], b) if k % 2 else (b,):
            df = spark.createDataFrame(rows, "src long, dst long")
            staged.TriangleCounter(str(tmp_path / "state"))(df, k)
        assert staged.TriangleCounter(str(tmp_path / "state")).total(spark) == want[k]


def test_windows_drop_what_is_late(spark, tmp_path):
    schema = "src long, ts timestamp"

    def arrive(name, *rows):
        df = spark.createDataFrame(list(rows), "src long, t string").selectExpr("src", "to_timestamp(t) as ts")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        counts = staged.windowed_counts(stream, "1 hour", "2 hours")
        counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {r["start"].hour: r["edges"] for r in sink.rows(spark, "start timestamp, edges long, sources long").collect()}

    sink = staged.LatestRows(str(tmp_path / "out"), ["start"])
    arrive("a", (1, "2024-01-01 01:10:00"), (2, "2024-01-01 01:20:00"), (1, "2024-01-01 05:30:00"))
    assert run() == {1: 2, 5: 1}
    arrive("b", (3, "2024-01-01 04:10:00"), (3, "2024-01-01 01:30:00"), (3, "2024-01-01 05:59:00"))
    assert run() == {1: 2, 4: 1, 5: 2}  # 01:30 is over two hours late
    sink(spark.createDataFrame([(1,)], "x long").selectExpr("to_timestamp('2024-01-01 05:00:00') as start", "2L as edges", "2L as sources"), 99)
    sink(spark.createDataFrame([(1,)], "x long").selectExpr("to_timestamp('2024-01-01 05:00:00') as start", "3L as edges", "2L as sources"), 99)
    assert {r["start"].hour: r["edges"] for r in sink.rows(spark, "start timestamp, edges long, sources long").collect()} == {1: 2, 4: 1, 5: 3}


@pytest.mark.parametrize("content", ["", "x", "one\ntwo\n", "é\n\n日"])
def test_whole_text(spark, tmp_path, content):
    text.write_whole(spark, content, str(tmp_path / "w"))
    assert "".join(r[0] for r in text.read_whole(spark, str(tmp_path / "w")).collect()) == content


def test_binary_files_refuse_what_does_not_fit(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (3, 1 << 56)], "src long, dst long")
    with pytest.raises(Exception, match=r"2\*\*56"):
        binary.write_edges(edges, str(tmp_path / "e"))
    (tmp_path / "odd.bin").write_bytes(b"x" * 40)
    for whole in (binary.WHOLE, 16):
        with pytest.raises(Exception, match="16 bytes"):
            binary.read_edges(spark, str(tmp_path / "odd.bin"), whole=whole).collect()


def test_neurons_beyond_the_declared_ones_are_an_error(spark):
    from trellis.operators import dnn

    y = spark.createDataFrame([(1, 3, 1.0), (2, 9, 1.0)], "img long, neuron long, val double")
    assert dnn.pad(y, 9).count() == 2
    with pytest.raises(Exception, match="beyond"):
        dnn.pad(y, 8).collect()
