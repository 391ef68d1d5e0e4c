"""Graph algorithms against brute force on small graphs, fixed examples and cross-checks."""

import heapq
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from weftgraph import generators as gen
from weftgraph.algorithms import clustering, components, cores, eccentricity, hypergraphs, ranking, traversal
from weftgraph.model import Graph, Hypergraph
from weftgraph.operators import buckets, edgemap, hyper, sequences


def make(spark, edges, n=None, symmetric=False, weighted=False):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long" + (", w int" if weighted else "")), n=n, symmetric=symmetric)


@pytest.fixture(scope="module")
def plain():
    """A random undirected graph of 30 vertices with an isolated one: {vertex: {neighbour: weight}}."""
    rng = random.Random(5)
    adj = {v: {} for v in range(30)}
    for _ in range(40):
        a, b = rng.randrange(29), rng.randrange(29)
        if a != b:
            w = rng.randint(1, 9)
            adj[a][b] = adj[b][a] = w
    return adj


@pytest.fixture(scope="module")
def graph(spark, plain):
    return make(spark, [(a, b, w) for a in plain for b, w in plain[a].items()], n=30, symmetric=True, weighted=True)


def values(df, column="value"):
    return {r["id"]: r[column] for r in df.collect()}


def levels(adj, root):
    dist = {root: 0}
    queue = deque([root])
    while queue:
        v = queue.popleft()
        for u in adj[v]:
            if u not in dist:
                dist[u] = dist[v] + 1
                queue.append(u)
    return dist


def test_bfs(graph, plain):
    dist = levels(plain, 0)
    for r in traversal.bfs(graph, 0).collect():
        assert r.level == dist.get(r.id)
        if r.id in dist and r.id:
            assert r.parent == min(u for u in plain[r.id] if dist.get(u) == dist[r.id] - 1)


def test_shortest_paths(graph, plain):
    dist, heap = {}, [(0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for u, w in plain[v].items():
                heapq.heappush(heap, (d + w, u))
    want = {v: dist.get(v) for v in plain}
    assert values(traversal.shortest_paths(graph, 0), "dist") == want
    assert values(traversal.delta_stepping(graph, 0, 4), "dist") == want


def test_negative_cycle_and_chain(spark):
    bad = make(spark, [(0, 1, 1), (1, 2, -3), (2, 0, 1)], weighted=True)
    assert {(r.dist, r.negative_cycle) for r in traversal.shortest_paths(bad, 0).collect()} == {(None, True)}
    chain = make(spark, [(k, k + 1, -1) for k in range(4)], weighted=True)
    assert values(traversal.shortest_paths(chain, 0), "dist") == {k: -k for k in range(5)}


def test_components(spark, graph, plain):
    want = {v: min(levels(plain, v)) for v in plain}
    assert values(components.components(graph), "label") == want
    assert values(components.propagate(graph), "label") == want
    assert values(components.propagate(graph, shortcut=True), "label") == want
    assert values(components.components(make(spark, [(2, 0), (0, 1)])), "label") == {0: 0, 1: 0, 2: 2}


def test_dependency(graph, plain):
    dist = levels(plain, 0)
    sigma = {0: 1}
    for v in sorted(dist, key=dist.get):
        if v:
            sigma[v] = sum(sigma[u] for u in plain[v] if dist.get(u) == dist[v] - 1)
    score = dict.fromkeys(dist, 0.0)
    for v in sorted(dist, key=dist.get, reverse=True):
        for u in plain[v]:
            if dist.get(u) == dist[v] - 1:
                score[u] += sigma[u] / sigma[v] * (1 + score[v])
    got = {r.id: r for r in traversal.dependency(graph, 0).collect()}
    for v in plain:
        assert (got[v].score is None) == (v not in dist)
        if v in dist:
            assert got[v].score == pytest.approx(score[v]) and got[v].sigma == sigma[v]


def test_radii_and_eccentricities(graph, plain):
    reach = {v: levels(plain, v) for v in plain}
    ecc = {v: max(reach[v].values()) for v in plain}
    assert values(eccentricity.exact(graph, 1)) == ecc
    assert values(eccentricity.bounded(graph, 4)) == ecc
    assert values(eccentricity.kbfs(graph)) == ecc  # more bits than vertices
    for estimate in (eccentricity.kbfs(graph, two_phase=False), eccentricity.lower_bounds(graph), eccentricity.registers(graph), eccentricity.sketch(graph)):
        assert all(v <= ecc[i] for i, v in values(estimate).items())
    assert all(ecc[i] / 2 <= v <= 2 * ecc[i] for i, v in values(eccentricity.two_approximation(graph)).items())
    near = values(eccentricity.near_set_estimate(graph))
    assert set(near) == set(ecc) and all(abs(near[i] - ecc[i]) <= 2 for i in ecc)
    starts = traversal.radius_sources(30)
    assert values(traversal.radii(graph)) == {v: max((reach[s][v] for s in starts if v in reach[s]), default=None) for v in plain}


def test_pagerank(spark, graph, plain):
    p = dict.fromkeys(plain, 1 / 30)
    for _ in range(15):
        p = {v: 0.85 * sum(p[u] / len(plain[u]) for u in plain[v]) + 0.15 / 30 for v in plain}
    got = values(ranking.pagerank(graph, max_iters=15, epsilon=0), "score")
    assert all(got[v] == pytest.approx(p[v]) for v in plain)
    delta = values(ranking.pagerank_delta(graph), "score")
    assert all(delta[v] == pytest.approx(p[v], rel=0.1) for v in plain)
    assert values(ranking.pagerank(make(spark, [(0, 1)])), "score")[1] == pytest.approx(0.075 * 1.85)


def test_factorize(graph, plain):
    latent = dict.fromkeys(plain, [0.5, 0.5, 0.5])
    for _ in range(2):
        new = {}
        for v in plain:
            err = [0.0] * 3
            for u, w in plain[v].items():
                gap = w - sum(a * b for a, b in zip(latent[u], latent[v]))
                err = [e + gap * x for e, x in zip(err, latent[u])]
            new[v] = [x + 0.01 * (-0.001 * x + e) for x, e in zip(latent[v], err)]
        latent = new
    got = values(ranking.factorize(graph, k=3, num_iter=2, step=0.01), "latent")
    assert all(got[v] == pytest.approx(latent[v]) for v in plain)
    assert ranking.squared_error(graph, ranking.factorize(graph, k=3, num_iter=2, step=0.01)).first().error < ranking.squared_error(graph, ranking.factorize(graph, k=3, num_iter=0)).first().error


def test_cores(graph, plain):
    want, left, k = {}, {v: dict(plain[v]) for v in plain}, 0
    while left:
        v = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[v]))
        want[v] = k
        for u in left.pop(v):
            left[u].pop(v, None)
    assert values(cores.kcore(graph)) == want
    assert values(cores.kcore_peel(graph)) == want


def test_independent_set(graph, plain):
    chosen = set()
    for v in sorted(plain):
        if not chosen & set(plain[v]):
            chosen.add(v)
    got = cores.maximal_independent_set(graph)
    assert {v for v, x in values(got, "in_set").items() if x} == chosen
    assert tuple(cores.check_independent_set(graph, got).first()) == (0, 0)


def test_triangles(graph, plain):
    found = [(a, b, c) for a in plain for b in plain[a] for c in plain[b] if a < b < c and c in plain[a]]
    assert cores.triangles(graph).first().triangles == len(found)
    assert values(cores.triangles_per_vertex(graph), "triangles") == {v: sum(c == v for _, _, c in found) for v in plain}


def test_set_cover(graph, plain):
    cover = {v for v, x in values(cores.set_cover(graph), "in_cover").items() if x}
    assert set().union(*(plain[v] for v in cover)) == {v for v in plain if plain[v]}
    assert len(cover) <= 16


def test_hypergraph_examples(spark):
    members = {0: [0, 1, 2], 1: [2, 3], 2: [1, 3, 4], 3: [4, 5]}
    hg = Hypergraph.from_incidence(spark.createDataFrame([(v, h) for h, m in members.items() for v in m], "v long, h long"), spark.range(7))
    side = lambda df, kind, c: {r.id: r[c] for r in df.where(F.col("kind") == kind).collect()}
    found = hypergraphs.hyper_bfs(hg, 0)
    assert side(found, "v", "level") == {0: 0, 1: 2, 2: 2, 3: 4, 4: 4, 5: 6, 6: None} and side(found, "h", "level") == {0: 1, 1: 3, 2: 3, 3: 5}
    assert side(hypergraphs.hyper_components(hg), "v", "label") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6}
    assert values(hypergraphs.hyper_kcore(hg)) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    assert side(hypergraphs.hyper_pagerank(hg, 2), "v", "score")[4] == pytest.approx(0.173931, abs=1e-6)
    assert side(hypergraphs.hyper_dependency(hg, 0), "v", "score") == {0: 5.0, 1: 3.5, 2: 1.5, 3: 1.0, 4: 2.0, 5: 1.0, 6: None}
    assert {v for v, x in side(hypergraphs.hyper_bpath(hg, 0), "v", "reached").items() if x} == {0}
    assert values(hypergraphs.hyper_independent_set(hg), "flag") == {0: 1, 1: 2, 2: 8, 3: 1, 4: 2, 5: 1, 6: 6}
    assert side(hypergraphs.hyper_shortest_paths(hg, 0), "v", "dist") == {0: 0, 1: 2, 2: 2, 3: 4, 4: 4, 5: 6, 6: None}
    pair = Hypergraph.from_incidence(spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "v long, h long, w int"))
    assert {r.dist for r in hypergraphs.hyper_shortest_paths(pair, 0).where("kind = 'v'").collect()} == {0, 2}
    lists = {(r.kind, r.id): r.outgoing for r in hypergraphs.incidence_lists(hg).collect()}
    assert lists["h", 2] == [1, 3, 4] and lists["v", 6] == []


def test_directed_bpath(spark):
    vs = spark.range(6).select(F.col("id").alias("v"))
    hs = spark.range(3).select(F.col("id").alias("h"))
    v2h = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (4, 2)], "v long, h long")
    h2v = spark.createDataFrame([(0, 1), (1, 2), (2, 5)], "h long, v long")
    got = {(r.kind, r.id) for r in hypergraphs.hyper_bpath(Hypergraph(vs, hs, v2h, h2v), 0).where("reached").collect()}
    assert got == {("v", 0), ("v", 1), ("v", 2), ("h", 0), ("h", 1)}


def test_local_clustering(graph, plain):
    deg = {v: len(plain[v]) for v in plain}
    q = {0: 1.0}
    for _ in range(5):
        new = {}
        for v, x in q.items():
            if x > deg[v] * 1e-3:
                new[v] = new.get(v, 0) + x / 2
                for u in plain[v]:
                    new[u] = new.get(u, 0) + x / (2 * deg[v])
        q = new
    got = values(clustering.nibble(graph, 0, 5, 1e-3), "score")
    assert got.keys() == q.keys() and all(got[v] == pytest.approx(q[v]) for v in q)
    p, r = {}, {0: 1.0}
    while active := {v: x for v, x in r.items() if x > deg[v] * 1e-2}:
        for v, x in active.items():
            p[v] = p.get(v, 0) + 0.15 * x
            r[v] -= (1 + 0.15) / 2 * x
        for v, x in active.items():
            for u in plain[v]:
                r[u] = r.get(u, 0) + (1 - 0.15) / 2 * x / deg[v]
    got = values(clustering.push_pagerank(graph, 0, epsilon=1e-2), "score")
    assert got.keys() == p.keys() and all(got[v] == pytest.approx(p[v]) for v in p)
    walks = values(clustering.heat_walks(graph, 0, walks=50), "score")
    assert sum(walks.values()) == pytest.approx(1) and set(walks) <= set(levels(plain, 0))
    with pytest.raises(ValueError):
        clustering.nibble(graph, 29)


def test_sweep_cut(graph, plain, spark):
    rng = random.Random(2)
    scores = {v: rng.random() for v in plain if plain[v]}
    order = sorted(scores, key=lambda v: (-scores[v] / len(plain[v]), v))
    m, best = sum(map(len, plain.values())), None
    for k in range(1, len(order) + 1):
        s = set(order[:k])
        vol, cross = sum(len(plain[v]) for v in s), sum(u not in s for v in s for u in plain[v])
        low = min(vol, m - vol)
        c = 1.0 if not cross or low <= 0 else cross / low
        if best is None or c < best[0] - 1e-12:
            best = (c, k, vol, m, cross)
    got = tuple(clustering.sweep_cut(graph, spark.createDataFrame(list(scores.items()), "id long, score double")).first())
    assert got[0] == pytest.approx(best[0]) and got[1:] == best[1:]


def test_empty_graph(spark):
    empty = Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"), True)
    one = Graph(spark.range(1), spark.createDataFrame([], "src long, dst long"), True)
    assert components.components(empty).count() == 0 and cores.triangles(empty).first().triangles == 0
    assert values(ranking.pagerank(one, max_iters=3), "score")[0] == pytest.approx(0.15)
    assert values(cores.kcore(one)) == {0: 0} and values(cores.maximal_independent_set(one), "in_set") == {0: True}
    assert values(components.components(one), "label") == {0: 0}
    assert ranking.pagerank(empty).count() == 0 and ranking.pagerank_delta(empty).count() == 0
    hollow = Hypergraph.from_incidence(spark.createDataFrame([], "v long, h long"))
    assert hypergraphs.hyper_pagerank(hollow).count() == 0
    some = Hypergraph.from_incidence(spark.createDataFrame([(0, 0), (1, 0)], "v long, h long"))
    assert {(r.kind, r.id): r.score for r in hypergraphs.hyper_pagerank(some, max_iters=0).collect()} == {("v", 0): 0.5, ("v", 1): 0.5, ("h", 0): 0.0}


def test_heat_thresholds_are_the_sums():
    from math import factorial as f

    for levels in (1, 2, 6):
        want = [sum(f(k) * 3.0**m / f(m + k) for m in range(levels - k)) for k in range(levels)]
        assert clustering.heat_coefficients(3.0, levels) == pytest.approx(want)


def test_heat_kernel_matches_brute_force(spark, graph, plain):
    levels, t, epsilon = 5, 3.0, 1e-4
    psi, r, x = clustering.heat_coefficients(t, levels), {0: 1.0}, {}
    for j in range(levels):
        bound = math.exp(t) * epsilon / (2 * levels * psi[j])
        active = {v: a for v, a in r.items() if plain[v] and (j == 0 or a >= len(plain[v]) * bound)}
        r = {}
        for v, a in active.items():
            x[v] = x.get(v, 0) + a
            for u in plain[v]:
                r[u] = r.get(u, 0) + (a / len(plain[v]) if j + 1 == levels else t / (j + 1) * a / len(plain[v]))
    for v, a in r.items():
        x[v] = x.get(v, 0) + a
    got = values(clustering.heat_kernel(graph, 0, t, epsilon, levels), "score")
    assert got.keys() == x.keys() and all(got[v] == pytest.approx(a) for v, a in x.items())


def test_hyper_entropy_matches_brute_force(spark):
    pairs = [(0, 0), (1, 0), (1, 1), (2, 1), (3, 1), (0, 2), (3, 2)]
    hg = Hypergraph.from_incidence(spark.createDataFrame(pairs, "v long, h long"))
    rows = hypergraphs.hyper_pagerank(hg, entropy=True).collect()
    score = {(r.kind, r.id): r.score for r in rows}
    for r in rows:
        if r.kind == "h":
            parts = [score["v", v] / r.score for v, h in pairs if h == r.id]
            assert r.entropy == pytest.approx(sum(p * math.log2(p) for p in parts))


def test_frontier_operators(spark, graph, plain):
    front = edgemap.vertex_subset(graph, [0, 1, 2])
    assert edgemap.size(front) == 3 and not edgemap.is_empty(front)
    assert {r.id for r in edgemap.to_sparse(edgemap.to_dense(graph, front)).collect()} == {0, 1, 2}
    want = {}
    for v in (0, 1, 2):
        for u in plain[v]:
            want[u] = want.get(u, 0) + 1
    for strategy in edgemap.STRATEGIES:
        got = edgemap.edge_map(graph, front, {"value": "count(1)"}, strategy=strategy)
        assert values(got) == want
    with pytest.raises(ValueError):
        edgemap.edge_map(graph, front, strategy="unknown")
    packed, degrees = edgemap.pack_edges(graph, front, "w > 4")
    assert values(degrees, "degree") == {v: sum(w > 4 for w in plain[v].values()) for v in (0, 1, 2)}
    assert packed.edges.count() == sum(w > 4 or v > 2 for v in plain for w in plain[v].values())
    assert values(graph.out_degrees(), "degree") == {v: len(plain[v]) for v in plain}
    state = buckets.make_buckets(graph.out_degrees(), "degree")
    at, members = buckets.next_bucket(state)
    assert at == 0 and {r.id for r in members.collect()} == {v for v in plain if not plain[v]}
    moved = buckets.update_buckets(state, members.withColumn("bkt", F.lit(None).cast("long")))
    assert buckets.next_bucket(moved)[0] == min(len(x) for x in plain.values() if x)


def test_multigraph(spark):
    g = make(spark, [(0, 1), (0, 1), (1, 1)])
    assert g.m == 3 and g.dedup().edges.count() == 2
    assert {tuple(r) for r in g.symmetrize().edges.collect()} == {(0, 1), (1, 0)}
    assert {tuple(r) for r in g.transpose().edges.distinct().collect()} == {(1, 0), (1, 1)}


def test_hub(spark):
    star = make(spark, [(0, k) for k in range(1, 3001)] + [(k, 0) for k in range(1, 3001)], symmetric=True)
    assert components.components(star).select("label").distinct().count() == 1
    assert cores.kcore(star).agg(F.max("value")).first()[0] == 1
    assert cores.triangles(star).first().triangles == 0


def test_hyper_operators(spark):
    hg = Hypergraph.from_incidence(spark.createDataFrame([(0, 0), (1, 0), (1, 1), (2, 1)], "v long, h long"))
    packed, degrees = hyper.vertex_filter_ngh(hg, spark.createDataFrame([(1,)], "id long"), "dst = 0")
    assert values(degrees, "degree") == {1: 1} and packed.v2h.count() == 3 and packed.h2v.count() == 4
    assert values(hyper.vertex_prop_count(hg, spark.createDataFrame([(0,), (1,)], "id long"))) == {0: 2, 1: 1}


def test_sequences(spark):
    rows = [(k, (k * 37) % 11) for k in range(200)]
    df = spark.createDataFrame(rows, "i long, x long").repartition(5)
    total, want = 0, {}
    for i, x in rows:
        want[i] = total
        total += x
    assert {r.i: r.value for r in sequences.scan(df, "i", "x").collect()} == want
    assert {r.i: r.value for r in sequences.scan(df, "i", "x", inclusive=True, backward=True).collect()} == {i: total - want[i] for i, _ in rows}
    assert sorted(r.position for r in sequences.pack_index(df, "i", "x > 5").collect()) == list(range(sum(x > 5 for _, x in rows)))
    assert sequences.scan(df.limit(0), "i", "x").count() == 0


def test_generators(spark):
    grid = gen.grid(spark, 16, 2)
    assert {r.degree for r in grid.out_degrees().collect()} == {4}
    for make_one in (lambda: gen.rmat(spark, 60, 300).edges, lambda: gen.random_local(spark, 50, 200, 2).edges, lambda: gen.random_hypergraph(spark, 20, 30, 4).v2h):
        assert tuple(gen.check_table(make_one()).first()) == tuple(gen.check_table(make_one().repartition(3)).first())
    assert gen.rmat(spark, 60, 300).edges.where("src >= 64 or dst >= 64 or src < 0 or dst < 0").isEmpty()
    weighted = gen.add_weights(grid)
    there = {(r.src, r.dst): r.w for r in weighted.edges.collect()}
    assert all(there[b, a] == w and 1 <= w <= 4 for (a, b), w in there.items())


def test_queries_over_whole_tables(spark):
    from weftgraph.plans import queries

    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    whole = lines.select("l_partkey", "l_orderkey").distinct().count()
    assert queries.QUERIES["u14_mesh_op"](spark, d).count() == whole
    assert queries.QUERIES["u10_add_hyper_weights_op"](spark, d).count() == whole
    hyper = queries.QUERIES["g04_hyper_cc_op"](spark, d)
    assert hyper.where("kind = 'h'").count() == lines.select("l_orderkey").distinct().count()
    assert queries.QUERIES["a11_pagerank_ps_10it"](spark, d).count() == sum(spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("part", "supplier"))


def test_local_clustering_runs_at_the_default_epsilon(spark, monkeypatch):
    from weftgraph.algorithms import clustering
    from weftgraph.plans import queries

    used = []
    for name in ("nibble", "push_pagerank"):
        monkeypatch.setattr(clustering, name, lambda g, root, **more: used.append(more) or g.vertices.selectExpr("id", "0.5D score"))
    for name in ("l01_nibble_co45", "l02_push_pagerank_optimised_co45", "l03_push_pagerank_co45"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(used) == 3 and not any("epsilon" in more for more in used)


def test_factorisation_of_the_whole_table(spark):
    from weftgraph.plans import queries

    rows = queries.QUERIES["a06_factorize_ps"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 200 and all(len(r.latent) == 20 for r in rows)
    assert len({tuple(r.latent) for r in rows}) > 100
