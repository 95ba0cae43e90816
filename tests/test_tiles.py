"""Tiles against brute force, with ranges and tiles so small that every kind of tile occurs."""

import itertools

import numpy as np
import pytest

from trellis import session
from trellis.operators import canon, linalg, tiles, triangles, truss
from trellis.streaming import staged


@pytest.fixture(params=[(1 << 19, 1 << 20, 1 << 23), (200, 40, 100)], ids=["one tile", "many"])
def sizes(request, monkeypatch):
    for name, value in zip(("LEAST", "RANGE", "HELD"), request.param, strict=True):
        monkeypatch.setattr(tiles, name, value)


@pytest.fixture
def graph(spark):
    """Negative and large ids, a hub, and repeated edges."""
    r = np.random.default_rng(1)
    e = np.concatenate([r.integers(-25, 40, (500, 2)), np.stack([np.full(60, 7), np.arange(-20, 40)], 1), r.integers(0, 8, (40, 2)) + (1 << 60)])
    e = np.sort(e[e[:, 0] != e[:, 1]], axis=1).tolist()
    return spark.createDataFrame(e, "a long, b long"), {tuple(x) for x in e}


def brute(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return {tuple(sorted((a, b, c))) for a, b in edges for c in near[a] & near[b]}


def support(edges):
    n = dict.fromkeys(edges, 0)
    for t in brute(edges):
        for e in itertools.combinations(t, 2):
            n[e] += 1
    return n


def test_payloads_hold_any_long():
    a, b, w = np.array([-(1 << 63), -5, -5, 3]), np.array([(1 << 63) - 1, -4, 9, 4]), np.array([0, 1, 300, 1 << 41])
    assert [x.tolist() for x in tiles.unpack(tiles.pack(a, b, w))] == [a.tolist(), b.tolist(), w.tolist()]
    many = np.arange(100_000)
    assert len(tiles.pack(many // 100, many // 100 + 1 + many % 100, many * 0)) < 4 * len(many)


def test_triangles_and_supports(graph, sizes):
    df, edges = graph
    g, want = tiles.packed(df), brute(edges)
    assert sorted(tuple(x) for x in tiles.listed(g).collect()) == sorted(want)
    assert tiles.counted(g).first()[0] == triangles.count(df).first()[0] == len(want)
    assert {(x["a"], x["b"]): x["w"] for x in tiles.edges(tiles.supported(g)).collect()} == support(edges)
    at = {}
    for v in itertools.chain(*want):
        at[v] = at.get(v, 0) + 1
    assert {x["vertex"]: x["triangles"] for x in tiles.at_vertices(g).collect()} == at


def test_k_counts_as_by_joins(graph, sizes):
    df, _ = graph
    by_joins = {(x["k"], x["n"]) for x in triangles.k_counts(triangles.enumerate_triangles(df), None).collect()}
    assert {(x["k"], x["n"]) for x in triangles.k_counts_of_graph(tiles.packed(df), capped=False)[0].collect()} == by_joins


def test_parts_without_common_edges_are_tiles(spark, monkeypatch):
    """Ranges begin where no edge crosses, and then a truss takes one search of the tiles."""
    r = np.random.default_rng(3)
    e = np.concatenate([np.sort(r.integers(0, 20, (90, 2)), axis=1) + 20 * k - 60 for k in range(12)])
    e = sorted({tuple(x) for x in e[e[:, 0] != e[:, 1]].tolist()})
    df = spark.createDataFrame(e, "a long, b long").repartition(5)
    monkeypatch.setattr(tiles, "LEAST", 20)
    monkeypatch.setattr(tiles, "RANGE", 40)
    g = tiles.packed(df)
    assert len(g.bounds) == 11 and all(any(x <= 20 * k - 60 for x in g.bounds) for k in range(1, 12))
    assert not any(a < x <= b for a, b in e for x in g.bounds)
    searches, real = [], tiles.supported
    monkeypatch.setattr(tiles, "supported", lambda *a, **k: searches.append(1) or real(*a, **k))
    edges = set(e)
    while (left := {x for x, n in support(edges).items() if n >= 2}) != edges:
        edges = left
    assert {(x["a"], x["b"]) for x in tiles.edges(tiles.truss(g, 4)).collect()} == edges and edges
    assert len(searches) == 1


def test_truss_count_of_parts_takes_one_search(spark, monkeypatch):
    e = [(10 * k + a, 10 * k + b) for k in range(9) for a, b in itertools.combinations(range(5 + k % 3), 2)]
    monkeypatch.setattr(tiles, "LEAST", 9)
    monkeypatch.setattr(tiles, "RANGE", 9)
    g = tiles.packed(spark.createDataFrame(e, "a long, b long").repartition(4))
    searches, real = [], tiles.supported
    monkeypatch.setattr(tiles, "supported", lambda *a, **k: searches.append(1) or real(*a, **k))
    assert tiles.edge_count(tiles.truss(g, 6)).first()[0] == 3 * (15 + 21)
    assert len(searches) == 1


def test_truss_of_parts_and_one_that_is_cut(spark, monkeypatch):
    """Some cells go to one tile and some to several: what falls in the first is followed at once, and the rest is counted again."""
    r = np.random.default_rng(5)
    e = np.concatenate([r.integers(0, 15, (60, 2)) + 20 * k for k in range(6)] + [r.integers(0, 60, (500, 2)) + 500])
    e = {tuple(sorted(x)) for x in e.tolist() if x[0] != x[1]}
    monkeypatch.setattr(tiles, "LEAST", 100)
    monkeypatch.setattr(tiles, "RANGE", 40)
    g = tiles.packed(spark.createDataFrame(sorted(e), "a long, b long").repartition(4))
    cut = [x for x in g.bounds.tolist() if any(a < x <= b for a, b in e)]
    alone = tiles._plan(g).alone
    assert cut and min(cut) > 500 and len(cut) < len(g.bounds) and alone.any()
    while (left := {x for x, n in support(e).items() if n >= 2}) != e:
        e = left
    assert {(x["a"], x["b"]) for x in tiles.edges(tiles.truss(g, 4)).collect()} == e and e


def test_incidence_of_parts_takes_one_search(spark, monkeypatch):
    e = sorted((10 * k + a, 10 * k + b) for k in range(9) for a, b in itertools.combinations(range(4 + k % 3), 2))
    monkeypatch.setattr(tiles, "LEAST", 5)
    monkeypatch.setattr(tiles, "RANGE", 5)
    g = tiles.packed(spark.createDataFrame(e, "a long, b long").repartition(4))
    searches, real = [], tiles.supported
    monkeypatch.setattr(tiles, "supported", lambda *a, **k: searches.append(1) or real(*a, **k))
    got = sorted((x["i"], x["j"]) for x in truss.ktruss_incidence_of_graph(g, 5).collect())
    assert got == [(i, v) for i, x in enumerate(e) if (x[0] // 10) % 3 for v in x]
    assert len(searches) == 1


@pytest.mark.parametrize("cuts", [10, 1 << 19], ids=["many", "one tile"])
def test_closed_triangles_of_dense_tiles_are_not_listed(spark, tmp_path, monkeypatch, cuts):
    """Dense tiles are multiplied; tiles without a new edge are not searched; an edge is that of its first batch."""
    r = np.random.default_rng(6)
    e = [(int(a), int(b)) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.8] + [(100, 101), (101, 102), (100, 102)]
    batches = [e[::2] + e[:9], e[1::2] + [(b, a) for a, b in e[::3]] + [(7, 7)], e[:5]]
    monkeypatch.setattr(tiles, "LEAST", cuts)
    monkeypatch.setattr(tiles, "RANGE", cuts)
    monkeypatch.setattr(tiles, "MULTIPLIED", 1 << 40)
    monkeypatch.setattr(tiles, "_plan", lambda g, marked=False, real=tiles._plan: plans.append(real(g, marked)) or plans[-1])
    counter, plans = staged.TriangleCounter(str(tmp_path)), []
    for k, b in enumerate(batches):
        counter(spark.createDataFrame(b, "src long, dst long"), k)
        assert counter.total(spark) == len(brute({tuple(sorted(x)) for y in batches[: k + 1] for x in y if x[0] != x[1]}))
    assert plans[0].tiles and plans[1].tiles and (cuts > 10) == (plans[1].tiles == 1)


def test_dense_counts_equal_searched_ones():
    r = np.random.default_rng(7)
    a, b = np.nonzero(np.triu(r.random((90, 90)) < 0.3, 1))
    for tile in (0, 1):  # all in one range; between two
        t = tiles._open(tile, np.array([45]) if tile else np.zeros(0, np.int64), True, 1, 2 if tile else 1, [0], [tiles.pack(a, b, a * 0 + (b % 3 == 0))])
        p, q, e, src, dst, spoke = t.sides
        listed = sum(len(x[0]) for x in t.found)
        assert tiles._dense(p, q, src, dst, len(t.vertex)) == t.count() == listed > 100
        assert tiles._dense(p, q, src, dst, 1 << 20) is None


def test_spans_are_joined_where_they_are_closest(monkeypatch):
    low, high = np.array([0, 10, 12, 40, -(1 << 62)]), np.array([5, 11, 20, 41, -5])
    assert [x.tolist() for x in tiles._parts(low, high, low * 0 + 1)] == [[-(1 << 62), 0, 10, 12, 40], [-5, 5, 11, 20, 41], [1] * 5]
    monkeypatch.setattr(tiles, "SPANS", 3)
    spans = [x.tolist() for x in tiles._parts(np.array([0, 10, 12, 40]), np.array([5, 11, 20, 41]), np.ones(4, np.int64))]
    assert spans == [[0, 10, 40], [5, 20, 41], [1, 2, 1]]


@pytest.mark.parametrize("k", [3, 4, 6])
def test_truss(graph, sizes, k):
    df, edges = graph
    while True:
        left = {e for e, n in support(edges).items() if n >= k - 2}
        if left == edges:
            break
        edges = left
    got = [tuple(x) for x in truss.ktruss(df, k).collect()]
    assert sorted(got) == sorted(edges)


def test_stages(spark, graph, sizes):
    _, edges = graph
    stage = {e: (e[0] + e[1]) % 4 + 1 for e in edges}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in stage.items()], "src long, dst long, stage int")
    want = {u: len(brute({e for e in edges if stage[e] <= u})) for u in range(1, 5)}
    assert {x["upto"]: x["triangles"] for x in staged.cumulative_triangles(df, [1, 2, 3, 4]).collect()} == want


def test_no_wedge_is_joined(graph):
    plan = triangles.enumerate_triangles(graph[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("HashJoin") == 1  # that of cells with the list of tiles


def test_lists_are_made_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(linalg, "LIST_PAIRS", 500)
    monkeypatch.setattr(linalg, "DENSE", 0)
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2, (40, 30)), r.integers(0, 2, (30, 50))
    df = [spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double") for m in (a, b)]
    lists = linalg.spgemm_collect(*df, 5)
    assert "FlatMapCoGroupsInArrow" in lists._jdf.queryExecution().executedPlan().toString()  # no pair is moved
    want = {(i, j): ks.tolist() for i in range(40) for j in range(50) if len(ks := np.flatnonzero(a[i] & b[:, j])) >= 5}
    assert {(x["i"], x["j"]): x["ks"] for x in lists.collect()} == want


@pytest.mark.parametrize("kind", ["dense", "large numbers", "sparse", "repeated"])
def test_sums_of_lists_need_no_list(spark, monkeypatch, kind):
    monkeypatch.setattr(linalg, "DENSE", 0)
    monkeypatch.setattr(linalg, "SPAN_CELLS", 100)
    r = np.random.default_rng(4)
    share = 0.02 if kind == "sparse" else 0.2
    a, b = r.random((40, 160)) < share, r.random((160, 50)) < share
    a[0] = b[:, 0] = False
    a[0, [3, 159]] = b[[3, 159], 0] = True
    k = np.arange(160) * (10**9 if kind == "large numbers" else 1) - 70
    x, y = ([(int(p), int(q)) for p, q in zip(*np.nonzero(m), strict=True)] for m in (a, b))
    if kind == "repeated":
        x += x[::3]
    df = spark.createDataFrame([(i, int(k[p]), 1.0) for i, p in x], "i long, j long, v double"), spark.createDataFrame([(int(k[p]), j, 1.0) for p, j in y], "i long, j long, v double")
    sums = linalg.spgemm_collect_sums(*df, 2)
    lists = {(x["i"], x["j"]): x["ks"] for x in linalg.spgemm_collect(*df, 2).collect()}
    if kind == "dense":
        monkeypatch.setattr(linalg, "_lists", None)
        sums = linalg.spgemm_collect_sums(*df, 2)
    assert "FlatMapCoGroupsInArrow" in sums._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in sums.collect()} == {(*c, len(ks), ks[0], ks[-1], sum(ks)) for c, ks in lists.items()}
    assert {int(k[3]), int(k[159])} == set(lists[0, 0])


def test_lists_move_each_side_a_few_times(spark, monkeypatch):
    """Many pairs ask for many tiles, but no more than LIST_SIDE a side, and no value is moved."""
    monkeypatch.setattr(linalg, "DENSE", 0)
    monkeypatch.setattr(linalg, "TILE_PAIRS", 1)
    grids, real = [], linalg._in_tiles
    monkeypatch.setattr(linalg, "_in_tiles", lambda x, y, rows, columns, *rest: grids.append((rows, columns)) or real(x, y, rows, columns, *rest))
    m = spark.createDataFrame([(i, k, 1.0) for i in range(60) for k in range(i % 7, 9)], "i long, j long, v double")
    want = {(i, j): list(range(max(i % 7, j % 7), 9)) for i in range(60) for j in range(60)}
    assert {(x["i"], x["j"]): x["ks"] for x in linalg.spgemm_collect(m, linalg.transpose(m)).collect()} == want
    assert grids == [(linalg.LIST_SIDE, linalg.LIST_SIDE)]


def test_entries_of_tiled_lists(spark, monkeypatch):
    monkeypatch.setattr(linalg, "LIST_PAIRS", 500)
    monkeypatch.setattr(linalg, "DENSE", 0)
    m = spark.range(2000).selectExpr("id % 40 as i", "id div 40 as j", "1.0d as v")
    e = linalg.spgemm_collect(m, linalg.transpose(m)).selectExpr("i", "j", "explode(ks) as k")
    assert "ObjectHashAggregate" not in e._jdf.queryExecution().executedPlan().toString()
    assert e.count() == e.distinct().count() == 40 * 40 * 50


def test_stages_join_no_triangle(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 2)], "src long, dst long, stage int")
    plan = staged.cumulative_triangles(df, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2 and "v1" not in plan  # cells with tiles, stages with counts


def test_stream_counts_batches(spark, graph, tmp_path, monkeypatch):
    searched, search = [], tiles.closed
    monkeypatch.setattr(tiles, "closed", lambda g: searched.append(g) or search(g))
    _, edges = graph
    e = sorted(edges)
    counter = staged.TriangleCounter(str(tmp_path))
    for n, part in enumerate((e[::2], e[1::3], e)):  # the last holds known edges too
        counter(spark.createDataFrame([(b, a) for a, b in part], "src long, dst long"), n)
    assert counter.total(spark) == len(brute(edges))
    assert len(searched) == 3  # one search of tiles a batch


def test_incidence_without_the_product(spark, graph, monkeypatch):
    df, edges = graph
    df = df.distinct()
    adjacency, incidence = canon.symmetric(df), canon.incidence(canon.edge_index(df))
    few = incidence.where("j % 3 = 0")
    by_product = linalg.where_equal(linalg.spgemm(adjacency, few), 2.0).count() // 3
    doubled = triangles.count_by_incidence(adjacency.selectExpr("i", "j", "2.0d as v"), incidence).first()[0]
    assert doubled == linalg.where_equal(linalg.spgemm(adjacency.selectExpr("i", "j", "2.0d as v"), incidence), 2.0).count() // 3
    monkeypatch.setattr(linalg, "spgemm", None)
    assert triangles.count_by_incidence(adjacency, incidence).first()[0] == len(brute(edges))
    assert triangles.count_by_incidence(adjacency, few).first()[0] == by_product


def executed(frames, monkeypatch):
    """The plans of all tables that ``materialize`` writes from now on."""
    write = session.materialize

    def noted(df, name="step"):
        frames.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    for module in (canon, tiles, triangles, truss):
        monkeypatch.setattr(module, "materialize", noted)


def test_a_trace_computes_its_matrix_once(spark, graph, monkeypatch):
    df, edges = graph
    plans = []
    executed(plans, monkeypatch)
    adjacency = canon.symmetric(df.distinct())
    assert triangles.count_by_trace(adjacency).first()[0] == len(brute(edges))
    assert sum("Aggregate" in x for x in plans) == 1  # one pass over the distinct edges, for ranges and cells alike
    looped = adjacency.union(spark.createDataFrame([(7, 7, 1.0)], adjacency.schema))
    cube = np.linalg.matrix_power(dense_of(looped), 3)
    assert triangles.count_by_trace(looped).first()[0] * 6 == np.trace(cube)


def dense_of(m):
    rows = m.collect()
    place = {v: n for n, v in enumerate(sorted({x for r in rows for x in (r["i"], r["j"])}))}
    out = np.zeros((len(place), len(place)))
    for r in rows:
        out[place[r["i"]], place[r["j"]]] = r["v"]
    return out


def test_truss_incidence_exchanges_no_rows(spark, graph, sizes, monkeypatch):
    df, edges = graph
    number = {e: n for n, e in enumerate(sorted(edges))}
    by_rows = linalg.transpose(canon.incidence(canon.edge_index(df.distinct())))
    plans = []
    executed(plans, monkeypatch)
    for k in (2, 4, 6):
        want = sorted(tuple(x) for x in truss.ktruss_incidence(by_rows, k).collect())
        plans.clear()
        found = truss.ktruss_incidence_of_graph(tiles.packed(df), k)
        assert sorted(tuple(x) for x in found.collect()) == want and (k != 4 or want)
        assert {x["i"] for x in found.collect()} <= set(number.values())
        assert not any("Aggregate" in x for x in [*plans, found._jdf.queryExecution().optimizedPlan().toString()])


def test_stages_of_repeated_edges(spark, sizes):
    """An edge counts from its first stage on, however often it comes, and no edge is made distinct by an exchange of rows."""
    r = np.random.default_rng(4)
    e = [(int(a), int(b), int(s)) for a, b, s in zip(*r.integers(0, 30, (2, 900)), r.integers(1, 5, 900), strict=True) if a != b]
    df = spark.createDataFrame([*e, (1, 2, None)], "src long, dst long, stage int").repartition(5)
    first = {}
    for a, b, s in e:
        first[min(a, b), max(a, b)] = min(s, first.get((min(a, b), max(a, b)), 9))
    want = {s: len(brute({x for x, at in first.items() if at <= s})) for s in (1, 2, 3, 4)}
    plans = []
    with pytest.MonkeyPatch.context() as m:
        executed(plans, m)
        assert {x["upto"]: x["triangles"] for x in staged.cumulative_triangles(df, [1, 2, 3, 4]).collect()} == want
    assert not any("Aggregate" in x for x in plans)


def test_products_leave_tiles_in_pieces(spark, monkeypatch):
    """Neither the cells of a tile nor its lists are ever held whole, and entries are moved packed."""
    r = np.random.default_rng(6)
    for sparse, whole in ((0.9, True), (0.9, False), (0.02, False)):
        a, b = (r.integers(1, 5, n) * (r.random(n) < sparse) * (1 if whole else 0.3) for n in ((60, 20), (20, 70)))
        i, k = np.nonzero(a)
        ky, j = np.nonzero(b)
        t = linalg._Tile(i, k, a[i, k], ky, j, b[ky, j])
        monkeypatch.setattr(linalg, "CHUNK", 300)
        monkeypatch.setattr(linalg, "LIST_PAIRS", 300)
        parts, got = list(linalg._products(t)), np.zeros((60, 70))
        assert max(len(x[0]) for x in parts) <= 300 and len(parts) > (3 if sparse > 0.5 else 0)
        for x in parts:
            got[x[0], x[1]] += x[2]
        assert np.allclose(got, a @ b) and sum(len(x[0]) for x in parts) == np.count_nonzero(a @ b)
        for least in (1, 3):
            lists = list(linalg._lists(t, least))
            assert max(len(x[3]) for x in lists) <= 300 + 70 * 20
            found = {(int(p), int(q)): x[3][s:e].tolist() for x in lists for p, q, s, e in zip(x[0], x[1], x[2], x[2][1:], strict=False)}
            assert found == {(p, q): ks.tolist() for p in range(60) for q in range(70) if len(ks := np.flatnonzero((a[p] != 0) & (b[:, q] != 0))) >= least}
    m = spark.range(4000).selectExpr("id % 400 as i", "id div 400 as j", "1.0d as v")
    monkeypatch.setattr(linalg, "DENSE", 0)
    for made in (linalg.spgemm(m, linalg.transpose(m)), linalg.spgemm_collect(m, linalg.transpose(m))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "payload" in plan and made.count() == 400 * 400


def test_products_keep_rows_without_a_number(spark, monkeypatch):
    monkeypatch.setattr(linalg, "DENSE", 0)
    m = spark.createDataFrame([(None, 1, 2.0), (3, 1, 5.0)], "i long, j long, v double")
    assert {tuple(x) for x in linalg.spgemm(m, linalg.transpose(m)).collect()} == {(None, None, 4.0), (None, 3, 10.0), (3, None, 10.0), (3, 3, 25.0)}
