"""Readers, writers and codecs: round trips and bad input."""

import random

import numpy as np
import pytest
import scalar_codecs
from pyspark.sql import functions as F

from weftgraph.model import Graph, Hypergraph
from weftgraph.sources import codecs, text


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(300), rng.randrange(300)): rng.randint(1, 9) for _ in range(900)}
    return Graph(spark.range(301), spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w int"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("weighted", [False, True])
def test_adjacency_round_trip(spark, graph, tmp_path, weighted):
    columns = ["src", "dst", "w"] if weighted else ["src", "dst"]
    g = Graph(graph.vertices, graph.edges.select(*columns))
    text.write_adjacency(g, str(tmp_path / "g"))
    back = text.read_adjacency(spark, str(tmp_path / "g"))
    assert back.n == 301 and rows(back.edges, *columns) == rows(g.edges, *columns)


def test_adjacency_in_one_line_and_bad_files(spark, tmp_path):
    (tmp_path / "one").write_text("AdjacencyGraph 3 2 0 1 1\t1 2\n")
    assert rows(text.read_adjacency(spark, str(tmp_path / "one")).edges, "src", "dst") == [(0, 1), (2, 2)]
    (tmp_path / "short").write_text("AdjacencyGraph\n3\n2\n0\n1\n")
    (tmp_path / "kind").write_text("Other\n1\n0\n0\n")
    for name in ("short", "kind"):
        with pytest.raises(ValueError):
            text.read_adjacency(spark, str(tmp_path / name))


def test_hyper_adjacency(spark, tmp_path):
    (tmp_path / "h").write_text("AdjacencyHypergraph\n7\n10\n4\n10\n0 1 3 5 7 9 10\n0 0 2 0 1 1 2 2 3 3\n0 3 5 8\n0 1 2 2 3 1 3 4 4 5\n")
    hg = text.read_hyper_adjacency(spark, str(tmp_path / "h"), True)
    assert (hg.nv, hg.nh, hg.mv, hg.mh) == (7, 4, 10, 10)
    assert rows(hg.v2h, "v", "h") == sorted((v, h) for h, v in rows(hg.h2v, "h", "v"))
    text.write_hyper_adjacency(hg, str(tmp_path / "again"))
    assert rows(text.read_hyper_adjacency(spark, str(tmp_path / "again")).h2v, "h", "v") == rows(hg.h2v, "h", "v")
    text.write_mesh(hg, str(tmp_path / "mesh"))
    assert rows(spark.read.schema("h long, v long").csv(str(tmp_path / "mesh")), "h", "v") == rows(hg.h2v, "h", "v")
    pairs = text.clique_expansion(hg).edges
    assert pairs.count() == 6 + 2 + 6 + 2 and not pairs.where("src = dst").count()


def test_lists(spark, tmp_path):
    (tmp_path / "e").write_text("# head\n0 3 7\n3\t1 2\n# later\n\n1 0 5\n")
    assert rows(text.read_edges(spark, str(tmp_path / "e"), weighted=True).edges, "src", "dst", "w") == [(0, 3, 7), (1, 0, 5), (3, 1, 2)]
    assert text.read_edges(spark, str(tmp_path / "e"), symmetric=True).edges.count() == 6
    (tmp_path / "m").write_text("10 20 30\n5\n20 40\n6\n")
    assert rows(text.read_members(spark, str(tmp_path / "m"), weighted=True).v2h, "v", "h", "w") == [(0, 0, 5), (1, 0, 5), (1, 1, 6), (2, 0, 5), (3, 1, 6)]
    (tmp_path / "k").write_text("% bip\n4 9 3 100\n8 9 2 100\n8 11 1 100\n")
    assert rows(text.read_bipartite(spark, str(tmp_path / "k"), weighted=True).v2h, "v", "h", "w") == [(0, 0, 3), (1, 0, 2), (1, 1, 1)]


@pytest.mark.parametrize("kind", codecs.KINDS)
@pytest.mark.parametrize("weighted", [False, True])
def test_codecs(kind, weighted):
    rng = random.Random(3)
    for _ in range(300):
        owner = rng.randrange(10**6)
        members = sorted(rng.sample(range(10 ** rng.randint(2, 6)), rng.randint(0, 90)))
        weights = [rng.randint(-500, 500) for _ in members] if weighted else None
        code = codecs.encode(owner, members, kind, weights)
        assert codecs.decode(owner, code, len(members), kind, weighted) == (members, weights or [])
        assert code == scalar_codecs.encode(owner, members, kind, weights)
        assert scalar_codecs.decode(owner, code, len(members), kind, weighted) == (members, weights or [])
    assert codecs.encode(5, [4, 6, 300], "byte") == bytes([0x41, 2, 0xA6, 2])
    with pytest.raises(ValueError):
        codecs.encode(0, [1], "other")


@pytest.mark.parametrize("kind", codecs.KINDS)
@pytest.mark.parametrize("weighted", [False, True])
def test_many_lists_at_once(kind, weighted):
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 10 ** rng.integers(1, 9), rng.choice([0, 0, 1, 3, 70, 300]))) for _ in range(200)]
    owners, degrees = rng.integers(0, 10**6, 200), np.array([len(v) for v in lists])
    members = np.concatenate(lists)
    weights = rng.integers(-(10**6), 10**6, len(members)) if weighted else None
    data, offsets = codecs.encode_lists(owners, degrees, members, kind, weights)
    at = np.concatenate([[0], np.cumsum(degrees)])
    for k in range(200):
        own = None if weights is None else weights[at[k] : at[k + 1]].tolist()
        assert data[offsets[k] : offsets[k + 1]].tobytes() == scalar_codecs.encode(int(owners[k]), lists[k].tolist(), kind, own)
    got, w = codecs.decode_lists(owners, degrees, data, offsets, kind, weighted)
    assert (got == members).all() and (weights is None or (w == weights).all())


@pytest.mark.parametrize("kind", codecs.KINDS)
def test_compressed_file_round_trip(spark, graph, tmp_path, kind):
    codecs.write_compressed_file(graph, str(tmp_path / "c"), kind)
    back = codecs.read_compressed_file(spark, str(tmp_path / "c"), kind, weighted=True)
    assert back.n == graph.n and rows(back.edges, "src", "dst", "w") == rows(graph.edges.where("src <> dst"), "src", "dst", "w")


def test_lists_go_on_over_batches(spark):
    edges = [(v, u) for v in (0, 3, 4) for u in range(5, 2500) if u % (v + 1) == 0]
    g = Graph(spark.range(2500), spark.createDataFrame(edges, "src long, dst long"), False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        coded = codecs.compress(g, "run")
        assert coded.where("degree > 0").count() == 3
        assert rows(codecs.decompress(coded, "run"), "src", "dst") == sorted(edges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("weighted", [False, True])
def test_binary_hypergraph(spark, tmp_path, weighted):
    pairs = [(0, 0, 4), (1, 0, 4), (1, 1, -7), (2, 1, -7), (5, 1, -7)]
    table = spark.createDataFrame(pairs, "v long, h long, w int")
    hg = Hypergraph.from_incidence(table if weighted else table.drop("w"), spark.range(6))
    codecs.write_hyper_binary(hg, str(tmp_path / "h"))
    assert (tmp_path / "h.config").read_text() == "6 5 2 5" and (tmp_path / "h.vidx").stat().st_size == 24
    back = codecs.read_hyper_binary(spark, str(tmp_path / "h"), weighted)
    names = ["v", "h", "w"] if weighted else ["v", "h"]
    assert rows(back.v2h, *names) == rows(hg.v2h, *names) == rows(back.h2v, *names) and (back.nv, back.nh) == (6, 2)


def test_conversions_from_the_command_line(spark, tmp_path):
    from weftgraph import cli

    (tmp_path / "e").write_text("# snap\n0 1\n1 2\n3 4\n")
    cli.convert(spark, "edges", "adjacency", str(tmp_path / "e"), str(tmp_path / "a"), symmetric=True)
    cli.convert(spark, "adjacency", "binary", str(tmp_path / "a"), str(tmp_path / "b"), symmetric=True)
    cli.convert(spark, "binary", "compressed-file", str(tmp_path / "b"), str(tmp_path / "c"), symmetric=True)
    back = codecs.read_compressed_file(spark, str(tmp_path / "c"), "run")
    assert rows(back.edges, "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1), (3, 4), (4, 3)]
    (tmp_path / "m").write_text("7 9\n9 12 7\n")
    cli.convert(spark, "members", "hyper-adjacency", str(tmp_path / "m"), str(tmp_path / "ha"))
    cli.convert(spark, "hyper-adjacency", "hyper-binary", str(tmp_path / "ha"), str(tmp_path / "hb"), symmetric=True)
    assert rows(codecs.read_hyper_binary(spark, str(tmp_path / "hb")).v2h, "v", "h") == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 1)]
    cli.convert(spark, "members", "clique", str(tmp_path / "m"), str(tmp_path / "q"))
    assert text.read_adjacency(spark, str(tmp_path / "q")).m == 8
    cli.convert(spark, "members", "mesh", str(tmp_path / "m"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv")).count() == 5
    with pytest.raises(ValueError):
        cli.convert(spark, "edges", "mesh", str(tmp_path / "e"), str(tmp_path / "x"))


@pytest.mark.parametrize("kind", codecs.KINDS)
def test_compressed_table(spark, graph, tmp_path, kind):
    codecs.write_compressed(graph, str(tmp_path / kind), kind)
    back = codecs.read_compressed(spark, str(tmp_path / kind))
    assert rows(back.edges, "src", "dst", "w") == rows(graph.edges.where("src <> dst"), "src", "dst", "w")
    assert codecs.size_report(codecs.compress(graph, kind)).first().edges == back.edges.count()


def test_compressed_file(spark, tmp_path):
    lists = {0: [1, 5], 1: [], 2: [0, 1, 700]}
    codes = [codecs.encode(v, m, "byte") for v, m in lists.items()]
    at = [0]
    for c in codes:
        at.append(at[-1] + len(c))
    whole = lambda x, n: x.to_bytes(n, "little")
    data = whole(3, 8) + whole(5, 8) + whole(at[-1], 8) + b"".join(whole(a, 4) for a in at) + b"".join(whole(len(m), 4) for m in lists.values()) + b"".join(codes)
    (tmp_path / "c").write_bytes(data)
    assert rows(codecs.read_compressed_file(spark, str(tmp_path / "c")).edges, "src", "dst") == [(0, 1), (0, 5), (2, 0), (2, 1), (2, 700)]


@pytest.mark.parametrize("weighted", [False, True])
def test_binary_files(spark, graph, tmp_path, weighted):
    columns = ["src", "dst", "w"] if weighted else ["src", "dst"]
    g = Graph(graph.vertices, graph.edges.select(*columns))
    codecs.write_binary(g, str(tmp_path / "b"))
    assert rows(codecs.read_binary(spark, str(tmp_path / "b"), weighted).edges, *columns) == rows(g.edges, *columns)


def test_eccentricity_lines(spark, tmp_path):
    from weftgraph.algorithms.eccentricity import write_values

    write_values(spark.createDataFrame([(2, 5), (0, 3), (1, None)], "id long, value int"), str(tmp_path / "v"))
    assert [r.value for r in text.lines(spark, str(tmp_path / "v")).orderBy("n").collect()] == ["3", "-1", "5"]


def test_compressed_hypergraph(spark, tmp_path):
    pairs = [(0, 0), (1, 0), (1, 1), (2, 1), (5, 1)]
    hg = Hypergraph.from_incidence(spark.createDataFrame(pairs, "v long, h long"), spark.range(6))
    codecs.write_compressed_hyper(hg, str(tmp_path / "h"), "run")
    back = codecs.read_compressed_hyper(spark, str(tmp_path / "h"))
    assert rows(back.v2h, "v", "h") == pairs and rows(back.h2v, "h", "v") == sorted((h, v) for v, h in pairs) and back.nv == 6


def test_command_line(spark, tmp_path, capsys):
    from weftgraph import cli

    (tmp_path / "e").write_text("0 1\n1 2\n3 4\n")
    got = cli.run(spark, ["components", str(tmp_path / "e"), "--format", "edges", "-s", "--rounds", "1", "--out", str(tmp_path / "out")])
    assert rows(got, "id", "label") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)] == rows(spark.read.parquet(str(tmp_path / "out")), "id", "label")
    assert capsys.readouterr().out.count("Running time") == 1
    with pytest.raises(ValueError):
        cli.run(spark, ["bfs", str(tmp_path / "e"), "--format", "members"])
