"""Neighbour-list codecs: gaps in bytes, run-length bytes and nibbles; and the binary and compressed files made of them.

A list is sorted and free of repeats.  Its first member is coded relative to the owner and
may be below it; each following one by its gap to the one before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph, Hypergraph
from weftgraph.operators.sequences import running
from weftgraph.storage import durable

KINDS = ("byte", "run", "nibble")
#: Numbers in a block of a binary file, and vertices in a range of a compressed one, that a task reads at once.
BLOCK, VERTICES = 1 << 20, 10_000


def _varints(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of ``bits`` bits, lowest first, the next bit set where a value goes on; and the number of units of each value."""
    values = values.astype(np.uint64)
    counts = np.ones(len(values), np.int64)
    rest = values >> np.uint64(bits)
    while rest.any():
        counts += rest > 0
        rest >>= np.uint64(bits)
    starts = np.cumsum(counts) - counts
    units = np.empty(int(counts.sum()), np.uint8)
    some = np.arange(len(values))
    for k in range(int(counts.max(initial=0))):
        some = some[counts[some] > k]
        more = (counts[some] > k + 1).astype(np.uint8) << bits
        units[starts[some] + k] = ((values[some] >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.uint8) | more
    return units, counts


def _values(units: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of such units, and the unit at which each ends."""
    ends = np.flatnonzero(units >> bits == 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out, counts = np.zeros(len(ends), np.uint64), ends - starts + 1
    for k in range(int(counts.max(initial=0))):
        some = np.flatnonzero(counts > k)
        out[some] |= (units[starts[some] + k] & np.uint8((1 << bits) - 1)).astype(np.uint64) << np.uint64(bits * k)
    return out, ends


def _fold(x: np.ndarray, kind: str) -> np.ndarray:
    """Signed numbers as numbers of zero or more: the sign is bit 6 under the larger bits, or for nibbles the lowest bit (set from zero on)."""
    size = np.abs(x).astype(np.uint64)
    if kind == "nibble":
        return (size << np.uint64(1)) | (x >= 0).astype(np.uint64)
    return ((size >> np.uint64(6)) << np.uint64(7)) | ((x < 0).astype(np.uint64) << np.uint64(6)) | (size & np.uint64(63))


def _unfold(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "nibble":
        size, negative = x >> np.uint64(1), x & np.uint64(1) == 0
    else:
        size, negative = ((x >> np.uint64(7)) << np.uint64(6)) | (x & np.uint64(63)), (x >> np.uint64(6)) & np.uint64(1) == 1
    return np.where(negative, -size.astype(np.int64), size.astype(np.int64))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def encode_lists(owners: np.ndarray, degrees: np.ndarray, members: np.ndarray, kind: str = "byte", weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the codes of many lists at once; weights follow their members in the signed form (after all of them for runs)."""
    if kind not in KINDS:
        raise ValueError(f"unknown codec {kind!r}")
    members, degrees = members.astype(np.int64), degrees.astype(np.int64)
    n, m = len(owners), len(members)
    of = np.repeat(np.arange(n), degrees)
    first = np.ones(m, bool)
    first[1:] = of[1:] != of[:-1]
    value = np.empty(m, np.uint64)
    value[first] = _fold(members[first] - owners[of[first]], kind)
    later = np.flatnonzero(~first)
    value[later] = (members[later] - members[later - 1]).astype(np.uint64)
    bits = 3 if kind == "nibble" else 7
    if kind != "run":
        per = 1
        if weights is not None:
            per, folded = 2, np.empty(2 * m, np.uint64)
            folded[::2], folded[1::2] = value, _fold(weights.astype(np.int64), kind)
            value = folded
        units, counts = _varints(value, bits)
        size = np.bincount(np.repeat(of, per), counts, minlength=n).astype(np.int64)
        if kind == "byte":
            return units, np.concatenate([[0], np.cumsum(size)])
        even = size + size % 2
        flat = np.zeros(int(even.sum()), np.uint8)
        flat[_spread(np.cumsum(even) - even, size)] = units
        return (flat[::2] << 4) | flat[1::2], np.concatenate([[0], np.cumsum(even // 2)])
    # runs: a header of width - 1 and length - 1 before up to 64 gaps of one width in bytes
    width = 1 + sum((value >> np.uint64(8 * k) > 0).astype(np.int64) for k in range(1, 4))
    if (value[later] >> np.uint64(32)).any():
        raise ValueError("a gap of a run takes four bytes at most")
    fresh = np.zeros(m, bool)
    fresh[later] = first[later - 1] | (width[later] != width[later - 1])
    at = np.arange(m)
    since = at - np.maximum.accumulate(np.where(fresh | first, at, 0))
    fresh |= ~first & (since % 64 == 0)
    starts = np.flatnonzero(fresh)
    stop = np.append(np.flatnonzero(fresh | first), m)
    length = stop[np.searchsorted(stop, starts, "right")] - starts
    front, front_size = _varints(value[first], 7)
    tail, tail_size = _varints(_fold(weights.astype(np.int64), kind), 7) if weights is not None else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    size = np.where(first, 0, width + fresh)
    size[first] = front_size
    body = np.bincount(of, size, minlength=n).astype(np.int64)
    behind = np.bincount(of, tail_size, minlength=n).astype(np.int64) if weights is not None else np.zeros(n, np.int64)
    offsets = np.concatenate([[0], np.cumsum(body + behind)])
    out = np.empty(int(offsets[-1]), np.uint8)
    inside = np.cumsum(size) - size
    base = np.zeros(n, np.int64)
    base[of[first]] = inside[first]
    place = offsets[of] + inside - base[of]
    out[_spread(place[first], front_size)] = front
    out[place[starts]] = (width[starts] - 1) | ((length - 1) << 2)
    for k in range(4):
        some = later[width[later] > k]
        out[place[some] + fresh[some] + k] = (value[some] >> np.uint64(8 * k)).astype(np.uint8)
    if weights is not None:
        out[_spread((offsets[:-1] + body)[behind > 0], behind[behind > 0])] = tail
    return out, offsets


def _runs(data: np.ndarray, offsets: np.ndarray, degrees: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first values folded, gaps in list order, where each list's runs end): a run of every list at a time."""
    some = np.flatnonzero(degrees > 0)
    at, first = offsets[:-1].copy(), np.zeros(len(degrees), np.uint64)
    open_, shift = some, 0
    while len(open_):
        b = data[at[open_]]
        first[open_] |= (b & np.uint8(127)).astype(np.uint64) << np.uint64(shift)
        at[open_] += 1
        open_, shift = open_[b >= 128], shift + 7
    gaps = np.zeros(int(np.maximum(degrees - 1, 0).sum()), np.int64)
    to = np.cumsum(np.maximum(degrees - 1, 0)) - np.maximum(degrees - 1, 0)
    left = degrees - 1
    open_ = np.flatnonzero(left > 0)
    while len(open_):
        b = data[at[open_]].astype(np.int64)
        width, length = (b & 3) + 1, (b >> 2) + 1
        for k in range(4):
            wide = width > k
            spots = _spread(to[open_[wide]], length[wide])
            inside = spots - np.repeat(to[open_[wide]], length[wide])
            gaps[spots] |= data[np.repeat(at[open_[wide]] + 1 + k, length[wide]) + inside * np.repeat(width[wide], length[wide])].astype(np.int64) << (8 * k)
        at[open_] += 1 + width * length
        to[open_] += length
        left[open_] -= length
        open_ = open_[left[open_] > 0]
    return first, gaps, at


def decode_lists(owners: np.ndarray, degrees: np.ndarray, data: np.ndarray, offsets: np.ndarray, kind: str = "byte", weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(members, weights) of many lists of known degrees, one after the other."""
    if kind not in KINDS:
        raise ValueError(f"unknown codec {kind!r}")
    degrees = degrees.astype(np.int64)
    m, some = int(degrees.sum()), degrees > 0
    starts = (np.cumsum(degrees) - degrees)[some]
    weights = np.zeros(0, np.int64)
    step = np.zeros(m, np.int64)
    if kind == "run":
        first, gaps, at = _runs(data, offsets, degrees)
        rest = np.ones(m, bool)
        rest[starts] = False
        step[rest] = gaps
        step[starts] = _unfold(first[some], kind) + owners[some]
        if weighted:
            weights = _unfold(_values(data[_spread(at, offsets[1:] - at)], 7)[0], kind)
    else:
        per = 2 if weighted else 1
        if kind == "nibble":
            units = np.empty(2 * len(data), np.uint8)
            units[::2], units[1::2] = data >> 4, data & 15
            values, ends = _values(units, 3)
            list_of = np.searchsorted(2 * offsets[1:], ends, "right")
            # a filling nibble at a list's end is no value
            index = np.arange(len(values)) - np.searchsorted(list_of, list_of)
            values = values[index < per * degrees[list_of]]
        else:
            values, _ = _values(data, 7)
        if weighted:
            weights = _unfold(values[1::2], kind)
            values = values[::2]
        step[:] = values.astype(np.int64)
        step[starts] = _unfold(values[starts], kind) + owners[some]
    total = np.cumsum(step)
    before = np.zeros(len(degrees), np.int64)
    before[some] = total[starts] - step[starts]
    return total - np.repeat(before, degrees), weights


def encode(owner: int, members: list[int], kind: str = "byte", weights: list[int] | None = None) -> bytes:
    """The code of one list."""
    data, _ = encode_lists(np.array([owner]), np.array([len(members)]), np.array(members, np.int64), kind, np.array(weights, np.int64) if weights else None)
    return data.tobytes()


def decode(owner: int, data: bytes, degree: int, kind: str = "byte", weighted: bool = False) -> tuple[list[int], list[int]]:
    """(members, weights) of one list of known degree."""
    members, weights = decode_lists(np.array([owner]), np.array([degree]), np.frombuffer(data, np.uint8), np.array([0, len(data)]), kind, weighted)
    return members.tolist(), weights.tolist()


def _codes(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1 + column.offset)[column.offset :]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def compress(graph: Graph, kind: str = "byte", keep_self: bool = False) -> DataFrame:
    """(id, degree, code): every vertex's list, coded; repeats and, unless kept, self-loops are dropped, the least weight stays.

    The edges are sorted by vertex and coded as they stream by, many lists at a time.
    """
    rest = ["w"] if graph.weighted else []
    there = graph.edges if keep_self else graph.edges.where("src <> dst")
    edges = Graph(graph.vertices, there.select("src", "dst", *rest)).dedup().edges

    def run(batches):
        def coded(columns):
            src = columns[0]
            first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            degree = np.diff(np.append(first, len(src)))
            data, offsets = encode_lists(src[first], degree, columns[1], kind, columns[2] if rest else None)
            return pa.RecordBatch.from_arrays([pa.array(src[first]), pa.array(degree), _codes(data, offsets)], ["src", "degree", "code"])

        held: list[list[np.ndarray]] = []  # the last list may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))  # where the last list begins
            if held and held[-1][0][-1] != columns[0][0]:
                yield coded([np.concatenate(c) for c in zip(*held)])
                held = []
            if cut:
                held.append([c[:cut] for c in columns])
                yield coded([np.concatenate(c) for c in zip(*held)])
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield coded([np.concatenate(c) for c in zip(*held)])

    sorted_ = edges.select("src", "dst", *rest).repartition("src").sortWithinPartitions("src", "dst")
    lists = sorted_.mapInArrow(run, "src long, degree long, code binary")
    return graph.vertices.join(lists, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("code", F.lit(b"")).alias("code"))


def decompress(coded: DataFrame, kind: str = "byte", weighted: bool = False) -> DataFrame:
    """(src, dst[, w]) from (id, degree, code)."""

    def run(batches):
        for batch in batches:
            ids, degree = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            members, weights = decode_lists(ids, degree, *_bytes_of(batch.column(2)), kind, weighted)
            arrays = [pa.array(np.repeat(ids, degree)), pa.array(members)] + ([pa.array(weights.astype(np.int32))] if weighted else [])
            yield pa.RecordBatch.from_arrays(arrays, ["src", "dst"] + (["w"] if weighted else []))

    return coded.select("id", "degree", "code").mapInArrow(run, "src long, dst long" + (", w int" if weighted else ""))


def size_report(coded: DataFrame) -> DataFrame:
    """One row: edges, code bytes and bits per edge."""
    return coded.agg(F.sum("degree").alias("edges"), F.sum(F.octet_length("code")).alias("bytes")).withColumn("bits_per_edge", F.try_divide(8 * F.col("bytes"), F.col("edges")))


def write_compressed(graph: Graph, path: str, kind: str = "byte") -> None:
    """The coded lists as a Parquet table with their kind, which is splittable and self-describing."""
    compress(graph, kind).select("id", "degree", "code", F.lit(kind).alias("kind"), F.lit(graph.weighted).alias("weighted"), F.lit(graph.symmetric).alias("symmetric")).write.parquet(path)


def read_compressed(spark: SparkSession, path: str) -> Graph:
    coded = spark.read.parquet(path)
    head = coded.select("kind", "weighted", "symmetric").first()
    kind, weighted, symmetric = head if head else ("byte", False, False)
    return Graph(coded.select("id"), decompress(coded, kind, weighted), symmetric)


def write_compressed_hyper(hg: Hypergraph, path: str, kind: str = "byte") -> None:
    """Both sides' coded lists as one table; only repeats are dropped, since the two sides' ids are of different spaces."""
    sides = [compress(side, kind, keep_self=True).select(F.lit(name).alias("side"), "id", "degree", "code") for name, side in (("v", hg.v_side()), ("h", hg.h_side()))]
    sides[0].union(sides[1]).select("*", F.lit(kind).alias("kind"), F.lit(hg.weighted).alias("weighted"), F.lit(hg.symmetric).alias("symmetric")).write.parquet(path)


def read_compressed_hyper(spark: SparkSession, path: str) -> Hypergraph:
    coded = spark.read.parquet(path)
    head = coded.select("kind", "weighted", "symmetric").first()
    kind, weighted, symmetric = head if head else ("byte", False, False)
    v, h = (coded.where(F.col("side") == name) for name in ("v", "h"))
    v2h = decompress(v, kind, weighted).withColumnsRenamed({"src": "v", "dst": "h"})
    h2v = decompress(h, kind, weighted).withColumnsRenamed({"src": "h", "dst": "v"})
    return Hypergraph(v.select(F.col("id").alias("v")), h.select(F.col("id").alias("h")), v2h, h2v, symmetric)


def _size(spark: SparkSession, path: str) -> tuple[str, int]:
    """The full name of a file and its bytes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
    return status.getPath().toString(), status.getLen()


def _open(name: str):
    """A file in shared storage, opened for reading at any place."""
    if name.startswith("file:"):
        return open("/" + name[5:].lstrip("/"), "rb")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(name)
    return system.open_input_file(path)


def _records(spark: SparkSession, path: str, width: int, signed: bool = True) -> DataFrame:
    """(i, x): the numbers of ``width`` bytes in a file with their positions; each task reads its own blocks of it."""
    name, size = _size(spark, path)
    count, kind = size // width, f"<{'i' if signed else 'u'}{width}"

    def run(batches):
        with _open(name) as f:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    f.seek(block * BLOCK * width)
                    x = np.frombuffer(f.read(min(BLOCK, count - block * BLOCK) * width), kind).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(block * BLOCK, block * BLOCK + len(x))), pa.array(x)], ["i", "x"])

    blocks = -(-count // BLOCK)
    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(run, "i long, x long")


def read_compressed_file(spark: SparkSession, path: str, kind: str = "byte", symmetric: bool = True, offset_bytes: int = 4, weighted: bool = False) -> Graph:
    """A compressed graph file: n, m, bytes (64 bits each), n + 1 offsets, n degrees, the codes; then, unless symmetric, an in-edge part that isn't needed.

    Each task reads the index and the codes of its own ranges of vertices.
    """
    name, _ = _size(spark, path)
    with _open(name) as f:
        n = int(np.frombuffer(f.read(8), "<i8")[0])

    def run(batches):
        with _open(name) as f:

            def numbers(at: int, count: int, form: str) -> np.ndarray:
                f.seek(at)
                return np.frombuffer(f.read(count * np.dtype(form).itemsize), form).astype(np.int64)

            base = 24 + offset_bytes * (n + 1) + 4 * n
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    at, end = k * VERTICES, min(n, (k + 1) * VERTICES)
                    offsets = numbers(24 + offset_bytes * at, end - at + 1, f"<u{offset_bytes}")
                    degrees = numbers(24 + offset_bytes * (n + 1) + 4 * at, end - at, "<u4")
                    f.seek(base + int(offsets[0]))
                    data = np.frombuffer(f.read(int(offsets[-1] - offsets[0])), np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, end)), pa.array(degrees), _codes(data, offsets - offsets[0])], ["id", "degree", "code"])

    ranges = -(-n // VERTICES)
    coded = spark.range(0, ranges, 1, max(1, min(ranges, 10_000))).mapInArrow(run, "id long, degree long, code binary")
    return Graph(spark.range(n), decompress(coded, kind, weighted), symmetric)


def write_compressed_file(graph: Graph, path: str, kind: str = "byte", offset_bytes: int = 4) -> None:
    """A symmetric graph with dense ids as a compressed file of the layout that ``read_compressed_file`` reads."""
    spark = graph.spark
    coded = durable(compress(graph, kind).withColumn("size", F.octet_length("code").cast("long")))
    placed = durable(running(coded.select("id", "degree", "size"), [F.col("id")], ["size"]).select("id", "degree", (F.col("size_sum") - F.col("size")).alias("o")))
    n, m, total = (int(v or 0) for v in coded.agg(F.count(F.lit(1)), F.sum("degree"), F.sum("size")).first())
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(np.array([n, m, total], "<i8").tobytes()))
    _pass_on(out, placed.orderBy("id"), "o", offset_bytes)
    out.write(bytearray(total.to_bytes(offset_bytes, "little")))
    _pass_on(out, placed.orderBy("id"), "degree", 4)

    def join(batches):
        for batch in batches:
            raw, _ = _bytes_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([raw.tobytes()], pa.binary())], ["block"])

    for r in coded.orderBy("id").select("code").mapInArrow(join, "block binary").toLocalIterator():
        out.write(bytearray(r["block"]))
    out.close()


def _pass_on(out, rows: DataFrame, column: str, width: int) -> None:
    """A column of sorted rows to an open file as little-endian numbers: tasks make blocks of bytes, the driver passes these on one at a time."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy(zero_copy_only=False).astype(f"<i{width}").tobytes()], pa.binary())], ["block"])

    for r in rows.select(F.col(column).cast("long")).mapInArrow(run, "block binary").toLocalIterator():
        out.write(bytearray(r["block"]))


def _export(spark: SparkSession, path: str, parts: list[tuple[DataFrame, str]], width: int) -> None:
    """One file of the columns of sorted tables, in any Hadoop file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for rows, column in parts:
        _pass_on(out, rows, column, width)
    out.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def _export_side(spark: SparkSession, ids: DataFrame, edges: DataFrame, prefix: str, path: str, weighted: bool, offset_bytes: int) -> int:
    """Offsets and sorted targets (then weights) of the lists of ``ids`` (id) from edges (src, dst[, w]); returns the number of edges."""
    degrees = ids.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    placed = durable(running(degrees, [F.col("id")], ["d"]))
    _export(spark, f"{path}.{prefix}idx", [(placed.withColumn("o", F.col("d_sum") - F.col("d")).orderBy("id"), "o")], offset_bytes)
    rows = durable(edges.orderBy("src", "dst")).orderBy("src", "dst")
    _export(spark, f"{path}.{prefix}adj", [(rows, "dst")] + ([(rows, "w")] if weighted else []), 4)
    return rows.count()


def write_binary(graph: Graph, path: str, offset_bytes: int = 4) -> None:
    """``.config`` (n), ``.idx`` (offsets) and ``.adj`` (targets, then weights), fixed-width little-endian."""
    _write_text(graph.spark, path + ".config", str(graph.n))
    _export_side(graph.spark, graph.vertices, graph.edges, "", path, graph.weighted, offset_bytes)


def write_hyper_binary(hg: Hypergraph, path: str, offset_bytes: int = 4) -> None:
    """``.config`` (nv, mv, nh, mh) and, for vertices and for hyperedges, ``.vidx``, ``.vadj``, ``.hidx`` and ``.hadj`` as for graphs.  Ids are dense."""
    rest = ["w"] if hg.weighted else []
    counts = []
    for prefix, ids, own, edges, other in (("v", hg.vertices, "v", hg.v2h, "h"), ("h", hg.hyperedges, "h", hg.h2v, "v")):
        counts.append(_export_side(hg.spark, ids.select(F.col(own).alias("id")), edges.select(F.col(own).alias("src"), F.col(other).alias("dst"), *rest), prefix, path, hg.weighted, offset_bytes))
    _write_text(hg.spark, path + ".config", f"{hg.nv} {counts[0]} {hg.nh} {counts[1]}")


def _read_side(spark: SparkSession, path: str, prefix: str, weighted: bool, offset_bytes: int) -> DataFrame:
    """(src, dst[, w]) of one side's ``idx`` and ``adj`` files."""
    starts = _records(spark, f"{path}.{prefix}idx", offset_bytes, signed=False).withColumnRenamed("x", "a")
    values = _records(spark, f"{path}.{prefix}adj", 4)
    m = _size(spark, f"{path}.{prefix}adj")[1] // (8 if weighted else 4)
    ends = starts.select((F.col("i") - 1).alias("i"), F.col("a").alias("z"))
    spans = starts.join(ends, "i", "left").select(F.col("i").alias("src"), "a", F.coalesce("z", F.lit(m)).alias("z")).where("z > a")
    owners = spans.select("src", F.explode(F.sequence("a", F.col("z") - 1)).alias("i"))
    out = owners.join(values.where(F.col("i") < m).select("i", F.col("x").alias("dst")), "i")
    if weighted:
        out = out.join(values.where(F.col("i") >= m).select((F.col("i") - m).alias("i"), F.col("x").cast("int").alias("w")), "i")
    return out.drop("i")


def read_binary(spark: SparkSession, path: str, weighted: bool = False, symmetric: bool = False, offset_bytes: int = 4) -> Graph:
    """The graph of ``write_binary``'s three files; many tasks read their blocks of them."""
    n = int(spark.read.text(path + ".config").first()[0])
    return Graph(spark.range(n), _read_side(spark, path, "", weighted, offset_bytes), symmetric)


def read_hyper_binary(spark: SparkSession, path: str, weighted: bool = False, symmetric: bool = False, offset_bytes: int = 4) -> Hypergraph:
    """The hypergraph of ``write_hyper_binary``'s five files."""
    nv, _, nh, _ = map(int, spark.read.text(path + ".config").first()[0].split())
    v2h = _read_side(spark, path, "v", weighted, offset_bytes).withColumnsRenamed({"src": "v", "dst": "h"})
    h2v = _read_side(spark, path, "h", weighted, offset_bytes).withColumnsRenamed({"src": "h", "dst": "v"})
    return Hypergraph(spark.range(nv).select(F.col("id").alias("v")), spark.range(nh).select(F.col("id").alias("h")), v2h, h2v, symmetric)
