"""Worked examples, properties and brute force for the graph and matrix operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trellis.operators import canon, dnn, generate, kronecker, linalg, triangles, truss

EXAMPLE = [(1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]
TRUSS = {1: (1, 2), 2: (2, 3), 3: (1, 4), 4: (3, 4), 5: (1, 3), 6: (2, 5)}


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [(0, 0)], "src long, dst long").where("src <> dst" if not pairs else "true")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randint(1, n), rng.randint(1, n)) for _ in range(m)]


def brute_triangles(pairs):
    e = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    vs = sorted({x for p in e for x in p})
    return [t for t in itertools.combinations(vs, 3) if all(x in e for x in itertools.combinations(t, 2))]


def test_example_graph(spark):
    und = canon.undirected(edges(spark, EXAMPLE + [(5, 1), (3, 3)]))
    assert rows(und) == sorted(EXAMPLE)
    tri = triangles.enumerate_triangles(und)
    assert rows(tri) == [(2, 4, 5), (3, 4, 5)]
    assert rows(triangles.vertex_degrees(tri)) == [(2, 1), (3, 1), (4, 2), (5, 2)]
    assert rows(triangles.edge_support(und, tri)) == [(1, 5, 0), (2, 4, 1), (2, 5, 1), (3, 4, 1), (3, 5, 1), (4, 5, 2)]
    assert rows(triangles.k_counts(tri, triangles.k_cap(5))) == [(3, 2)]
    assert rows(triangles.listing(tri)) == [(5, 4, 2), (5, 4, 3)]
    adjacency = canon.symmetric(und)
    assert triangles.count_by_trace(adjacency).first()[0] == 2
    assert triangles.count_by_incidence(adjacency, canon.incidence(canon.edge_index(und))).first()[0] == 2
    assert triangles.clique_bound(triangles.k_counts(tri, None)).first()[0] == 3


def test_truss_example(spark):
    inc = spark.createDataFrame([(e, v, 1.0) for e, p in TRUSS.items() for v in p], "i long, j long, v double")
    assert {r[0] for r in rows(truss.ktruss_incidence(inc, 3), "i")} == {1, 2, 3, 4, 5}
    assert truss.ktruss_incidence(inc, 4).isEmpty()
    assert {r[0] for r in rows(truss.ktruss_incidence(inc, 2), "i")} == set(TRUSS)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_match_brute_force(spark, seed):
    pairs = random_pairs(25, 140, seed)
    und = canon.undirected(edges(spark, pairs)).cache()
    want = brute_triangles(pairs)
    tri = triangles.enumerate_triangles(und)
    assert rows(tri) == want
    assert triangles.vertex_degrees(tri).agg(F.sum("triangles")).first()[0] == 3 * len(want)
    assert triangles.k_counts(tri, None).agg(F.sum("n")).first()[0] == len(want)
    last = None
    for k in (3, 4, 5):
        e = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
        while True:
            weak = {x for x in e if sum((min(x[0], w), max(x[0], w)) in e and (min(x[1], w), max(x[1], w)) in e for w in range(1, 26)) < k - 2}
            if not weak:
                break
            e -= weak
        got = set(rows(truss.ktruss(und, k)))
        assert got == e
        assert last is None or got <= last
        last = got
    numbers = {(a, b): t for a, b, t in rows(truss.truss_numbers(und))}
    assert {x for x, t in numbers.items() if t >= 5} == last


def test_empty_graph(spark):
    und = canon.undirected(edges(spark, []))
    assert triangles.count(und).first()[0] == 0
    assert truss.ktruss(und, 3).isEmpty()
    assert canon.edge_index(und).isEmpty()


def test_dense_index_and_blocks(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 57)], "x long").repartition(5)
    got = rows(canon.dense_index(df, ["x"], "n"))
    assert [n for _, n in got] == list(range(57))
    parts = rows(canon.row_blocks(df, "x", 4), "part")
    assert [sum(p[0] == k for p in parts) for k in range(4)] == [15, 14, 14, 14]


def matrix(spark, cells):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in cells.items()], "i long, j long, v double")


def test_algebra_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.integers(-2, 3, (4, 6)), rng.integers(-2, 3, (6, 5))

    def df(m):
        return matrix(spark, {(i + 1, j + 1): v for (i, j), v in np.ndenumerate(m)}).where("v <> 0")

    def dense(d, shape):
        out = np.zeros(shape)
        for r in d.collect():
            assert r["v"] != 0
            out[r["i"] - 1, r["j"] - 1] = r["v"]
        return out

    assert (dense(linalg.spgemm(df(a), df(b)), (4, 5)) == a @ b).all()
    assert (dense(linalg.kron(df(a), df(b), 6, 5, block_rows=7), (24, 30)) == np.kron(a, b)).all()
    assert (dense(linalg.subtract(df(a), df(a)), (4, 6)) == 0).all()
    assert (dense(linalg.clamp(df(a), 0, 1), (4, 6)) == a.clip(0, 1)).all()
    assert (dense(linalg.transpose(df(a)), (6, 4)) == a.T).all()
    sq = a @ a.T
    assert (dense(linalg.lower(df(sq), strict=False), (4, 4)) == np.tril(sq)).all()
    assert (dense(linalg.hadamard(df(sq), df(sq)), (4, 4)) == sq * sq).all()
    lists = rows(linalg.spgemm_collect(df(np.abs(a)), df(np.abs(b)), 1))
    assert all(list(k) == [x + 1 for x in range(6) if a[i - 1, x] and b[x, j - 1]] for i, j, k in lists)


@pytest.mark.parametrize("chunk", [50, 1 << 22])
def test_products_in_tiles_equal_joined_ones(spark, monkeypatch, chunk):
    """Dense products go by tiles, sparse ones by joins, with hot inner indices dealt; all agree with numpy."""
    import numpy as np

    rng = np.random.default_rng(7)
    a = rng.integers(-3, 4, (40, 6)) * (rng.random((40, 6)) < 0.9)
    b = rng.integers(-3, 4, (6, 30)) * (rng.random((6, 30)) < 0.9)
    b[2:5] *= rng.random((3, 30)) < 0.1
    x = matrix(spark, {(i * 7 + 1, k): v for (i, k), v in np.ndenumerate(a)}).where("v <> 0")
    y = matrix(spark, {(k, j * 3 + 5): v for (k, j), v in np.ndenumerate(b)}).where("v <> 0")
    want = {(i * 7 + 1, j * 3 + 5, float(v)) for (i, j), v in np.ndenumerate(a @ b) if v}
    monkeypatch.setattr(linalg, "CHUNK", chunk)
    plans = []
    for dense in (0, 10**9):
        monkeypatch.setattr(linalg, "DENSE", dense)
        product = linalg.spgemm(x, y)
        plans.append(product._jdf.queryExecution().toString())
        assert set(rows(product, "i", "j", "v")) == want
    assert "CoGroups" in plans[0] and "CoGroups" not in plans[1]
    assert linalg.spgemm(x.where("false"), y).isEmpty()
    got = linalg.tile_product(*(np.array(c) for c in zip(*[(i, k, float(a[i, k])) for i, k in zip(*np.nonzero(a), strict=True)], strict=True)), *(np.array(c) for c in zip(*[(k, j, float(b[k, j])) for k, j in zip(*np.nonzero(b), strict=True)], strict=True)))
    assert {(int(i), int(j), v) for i, j, v in zip(*got, strict=True)} == {(i, j, float(v)) for (i, j), v in np.ndenumerate(a @ b) if v}


def test_truss_numbers_peel_on(spark):
    pairs = random_pairs(18, 150, 4)
    und = canon.undirected(edges(spark, pairs))
    found = {(r["a"], r["b"]): r["truss"] for r in truss.truss_numbers(und).collect()}
    live = {(r["a"], r["b"]) for r in und.collect()}
    want, k = dict.fromkeys(live, 2), 3
    while live:
        while True:
            near = {}
            for a, b in live:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
            weak = {(a, b) for a, b in live if len(near[a] & near[b]) < k - 2}
            live -= weak
            if not weak:
                break
        want.update(dict.fromkeys(live, k))
        k += 1
    assert found == want
    assert max(want.values()) > 4


THEORY = {
    (3, 4): [(20, 48, 0, 0), (20, 62, 12, None), (20, 62, 1, 3)],
    (3, 4, 5): [(120, 480, 0, 0), (120, 692, 287, None), (120, 692, 7, 12)],
    (3, 4, 5, 9): [(1200, 8640, 0, 0), (1200, 13166, 9107, None), (1200, 13166, 35, 39)],
}


@pytest.mark.parametrize("design", list(THEORY))
def test_kronecker_theory(design):
    for kind in range(3):
        t = kronecker.theory(list(design), kind)
        assert tuple(t.values()) == THEORY[design][kind]
        n = kronecker.degree_counts(list(design), kind)
        assert sum(n.values()) == t["vertices"]
        assert sum(d * c for d, c in n.items()) == t["edges"]
    if design == (3, 4):
        assert kronecker.degree_counts([3, 4], 2) == {1: 6, 2: 5, 3: 4, 4: 2, 6: 1, 8: 1, 12: 1}


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_kronecker_measured(spark, kind):
    g = kronecker.generate(spark, [3], [4], kind, workers=3).cache()
    assert kronecker.check_degrees(g, [3, 4], kind).isEmpty()
    r = kronecker.check_counts(g, [3, 4], kind).first()
    assert (r["vertices"], r["edges"], r["triangles"]) == (r["theory_vertices"], r["theory_edges"], r["theory_triangles"])
    assert r["truss_edges"] == (0, 19, 3)[kind]


def test_small_designs_are_saved(spark, tmp_path):
    from trellis.sources import text

    out = kronecker.save_small(spark, kronecker.sub_designs([3, 4]), 2, str(tmp_path), below=60)
    assert [p.rsplit("/", 1)[1] for p in out] == ["3-type2", "4-type2"]
    assert text.read_triples(spark, out[0]).count() == kronecker.theory([3], 2)["edges"]


def test_command_line(spark, tmp_path, capsys):
    from trellis.__main__ import main

    (tmp_path / "g.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in EXAMPLE))
    main(["triangles", str(tmp_path / "g.tsv")])
    assert "triangles: 2" in capsys.readouterr().out
    main(["ktruss", str(tmp_path / "g.tsv"), "--k", "3"])
    assert "edges: 5" in capsys.readouterr().out
    main(["design", "3", "4", "--kind", "2"])
    assert "triangles: 1" in capsys.readouterr().out


def test_huge_design(spark):
    t = kronecker.theory_table(spark, [[3, 4, 5, 9, 16, 25, 81, 256, 625, 2401]], (2,)).first()
    assert t["edges"] > 10**18


def test_network(spark):
    y = spark.createDataFrame([(1, 1, 1.0), (2, 1, 100.0)], "img long, neuron long, val double")
    w = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 0.1)], "layer int, i long, j long, w double")
    out = {(r["img"], r["neuron"]): round(r["val"], 9) for r in dnn.infer(y, w, 1, -0.3).collect()}
    assert out == {(1, 1): 0.7, (2, 1): 32.0, (2, 2): 9.7}
    truth = spark.createDataFrame([(1,), (2,)], "category long")
    assert dnn.run_challenge(y, w, truth, 1, -0.3)["passed"]


def test_network_keeps_going_past_the_cut(spark):
    n = dnn.CUT_EVERY + 2
    y = spark.createDataFrame([(1, 1, 1.0)], "img long, neuron long, val double")
    w = spark.createDataFrame([(k, 1, 1, 1.5) for k in range(1, n + 1)], "layer int, i long, j long, w double")
    v = 1.0
    for _ in range(n):
        v = min(max(v * 1.5 - 0.3, 0), 32)
    assert dnn.infer(y, w, n, -0.3).first()["val"] == pytest.approx(v)


def test_rmat(spark):
    g = generate.rmat(spark, 7, 8)
    assert g.count() == 8 << 7
    assert g.agg(F.max(F.greatest("src", "dst"))).first()[0] < 1 << 7
    assert rows(g) == rows(generate.rmat(spark, 7, 8))
    raw = generate.rmat(spark, 7, 8, shuffle=False)
    assert raw.where("src < 64 and dst < 64").count() > 0.45 * (8 << 7)


def test_sbm_prefers_its_own_block(spark):
    e, truth = generate.sbm(spark, 200, seed=3)
    t = truth.toDF("node", "b")
    j = e.join(t.toDF("src", "x"), "src").join(t.toDF("dst", "y"), "dst")
    inside = j.where("x = y").count() / j.count()
    sizes = [r["count"] for r in truth.groupBy("block").count().collect()]
    assert inside > 1.3 * sum((s / 200) ** 2 for s in sizes)


def test_stage_splitters(spark):
    e = edges(spark, [p for p in random_pairs(40, 120, 9) if p[0] != p[1]]).distinct()
    snow = generate.snowball_stages(e, stages=4)
    assert snow.count() == e.count()
    first = {}
    for s, d, st in rows(snow, "src", "dst", "stage"):
        for x in (s, d):
            first[x] = min(first.get(x, 99), st)
    n = len(first)
    assert all(sum(v <= k for v in first.values()) <= n * k // 4 for k in range(1, 5))
    assert {r[0] for r in rows(generate.emerging_stages(e, 3), "stage")} == {1, 2, 3}
    names = rows(generate.arrival_index(snow), "at")
    assert [x[0] for x in names] == list(range(1, n + 1))
    assert generate.reindexed(snow).count() == e.count()


def test_matrix_accessors(spark):
    m = matrix(spark, {(1, 2): 3.0, (2, 1): -1.5, (3, 3): 0.0})
    assert tuple(linalg.shape(m).first()) == (2, 2, 2)
    assert (linalg.element(m, 1, 2), linalg.element(m, 9, 9)) == (3.0, 0.0)
    assert linalg.render(m, 2, 3) == "   0    3    0\n-1.5    0    0"
