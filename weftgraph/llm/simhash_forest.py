"""Near-duplicate documents by SimHash and an LSH forest.

Each distinct text gets a 128-bit SimHash of its five-word shingles.  Several tries hold
the fingerprints, each with its bits permuted by itself.

1. At the deep end of the tries: rows that are neighbours in a trie's order share its
   longest prefixes.  The nearest such neighbour of each row is verified, and what is
   verified joins rows to classes.  This takes few tries and no prefix is too dense for it.
2. Climb to shorter prefixes: all rows of unlike class that share a prefix are compared,
   where the prefix is as short as the target recall needs with the tries that there are.
   Density decides the depth: prefixes that hold too much work are left, and their rows
   take part in a deeper forest with more tries, which reaches the same recall for them.
   At the deepest one everything is compared, dealt in bounded pieces to many tasks.

Candidates are verified by the exact Jaccard similarity of their shingle sets, and all
verified links are closed to classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.stars import star_components

from .common import LAST, durable, prepare, trimmed
from .textkernel import U64, buffers, chunks, mix, reduceat, shingles, words

SIMILARITY, SHINGLE = 0.8, 5
BITS, RECALL = 128, 0.998
#: Least chance that a bit of two texts of the given similarity agrees, over all set sizes; but for 4 against 5 shingles.
AGREE, AGREE_TINY = 0.8388, 0.8125
#: Tries whose neighbours are met first, and how many neighbours on one side.
TRIES, REACH = 8, 6
#: Rows of a bucket if fingerprints were spread; forests, and bits by which each is deeper than the one before; rows of a place that tasks may hold.
BUCKET, LEVELS, STEP, MOST = 1024, 3, 4, 65_536
#: Rows compared with a block at once; bits that may differ in the first half of a fingerprint.
WINDOW, NEAR_HALF = 8192, 24

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U64)


def simhash(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) fingerprints and shingle counts of texts; each distinct shingle of a text counts once."""
    terms, bounds = shingles(*words(raw, offsets), SHINGLE)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    fresh = np.ones(len(terms), bool)
    fresh[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    terms = terms[fresh]
    bounds = np.searchsorted(owner[fresh], np.arange(len(bounds)))
    n = np.diff(bounds)
    # pieces of up to 255 shingles are summed in 8 byte-wide lanes of a word at once
    pieces = -(-n // 255)
    first_piece = np.concatenate([[0], np.cumsum(pieces)])
    starts = np.repeat(bounds[:-1], pieces) + 255 * (np.arange(first_piece[-1]) - np.repeat(first_piece[:-1], pieces))
    ones = np.zeros((len(n), BITS), np.int64)
    if len(starts):
        for half, salt in enumerate((U64(0x51ED270B9F2E3A17), U64(0xA0761D6478BD642F))):
            h = mix(terms ^ salt)
            for byte in range(8):
                lanes = np.add.reduceat(_LANES[((h >> U64(8 * byte)) & U64(255)).astype(np.int64)], starts)
                at = 64 * half + 8 * byte
                ones[:, at : at + 8] = reduceat(np.add, lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, 0)
    bits = ones * 2 > n[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(U64), n


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, sim, n): the MD5 of the text (null for a null text), its SimHash and its count of distinct shingles."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            raw, offsets = buffers(pc.utf8_lower(texts.cast(pa.large_string())))
            sims, counts = [], []
            for first, last in chunks(offsets):
                s, n = simhash(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                sims += [row.tobytes() for row in s.astype(">u8")]
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sims, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "key", "sim", "n"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col))).alias("key"))
    return chosen.mapInArrow(trimmed(run), "doc_id long, key binary, sim binary, n long")


def forest_shape(n: int, recall: float = RECALL, bucket: int = BUCKET, agree: float = AGREE, deeper: int = 0) -> tuple[int, int]:
    """(prefix depth, tries) for n fingerprints: the depth that leaves ``bucket`` rows of spread ones, ``deeper`` bits more, and the tries it needs.

    ``agree`` is the least chance that a bit of two similar texts agrees, so ``tries`` tries
    meet such a pair at ``depth`` bits with probability 1 - (1 - agree**depth)**tries.
    """
    depth = max(0, math.floor(math.log2(n / bucket))) + deeper if n > bucket else deeper
    hit = agree**depth
    return depth, 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))


def near_limit(n: np.ndarray) -> np.ndarray:
    """Bits that may differ for a text of n shingles: exceeded by one similar pair in some thousands."""
    return np.where(n < 6, 41, np.where(n < 64, 37, 34))


def permutations(tries: int) -> np.ndarray:
    return np.stack([np.random.default_rng(1000 + t).permutation(BITS) for t in range(tries)])


def alike(sims: np.ndarray, limits: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs may be similar, distances): by distance, and by the ratio of their shingle counts, which bounds the similarity."""
    far = np.bitwise_count(sims[i] ^ sims[j]).sum(1).astype(np.int64)
    low, high = np.minimum(counts[i], counts[j]), np.maximum(counts[i], counts[j])
    return (far <= np.maximum(limits[i], limits[j])) & (low >= SIMILARITY * high - 1e-9), far


def meetings(sims: np.ndarray, limits: np.ndarray, counts: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, window: int = WINDOW):
    """Arrays (i, j) of the candidate pairs of unlike labels between rows ``left`` and ``right`` (each pair once, if these are the same), block by block."""
    same = left is right
    for at in range(0, len(left), 128):
        rows = left[at : at + 128]
        one = labels[rows[0]] if (labels[rows] == labels[rows[0]]).all() else None
        for low in range(0, min(at + 128, len(right)) if same else len(right), window):
            others = right[low : low + window]
            if one is not None and (labels[others] == one).all():
                continue
            i, j = np.nonzero(np.bitwise_count(sims[rows, 0][:, None] ^ sims[others, 0][None, :]) <= NEAR_HALF)
            keep = labels[rows[i]] != labels[others[j]]
            if same:
                keep &= j + low < i + at
            i, j = rows[i[keep]], others[j[keep]]
            keep, _ = alike(sims, limits, counts, i, j)
            if keep.any():
                yield i[keep], j[keep]


def _signed(column: pa.Array) -> np.ndarray:
    """Fingerprints of a column of bytes as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def neighbours(reps: DataFrame, tries: int = TRIES, reach: int = REACH) -> DataFrame:
    """(a, b) with a > b: each row's nearest among its neighbours in the orders of the tries, if it may be similar.

    The tries are cut in ranges, so that no prefix is too dense for a task.
    """
    order = permutations(tries)

    def plant(batches):
        for batch in batches:
            sims = _signed(batch.column(1))
            bits = np.unpackbits(sims, axis=1)
            halves = np.ascontiguousarray(sims).view(">u8").astype(np.uint64).view(np.int64)
            for t in range(tries):
                code = np.ascontiguousarray(np.packbits(bits[:, order[t, :64]], axis=1)).view(">u8").astype(np.uint64).ravel() >> U64(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sims), t, np.int32)), pa.array(code.astype(np.int64)), batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(2)], ["trie", "code", "node", "s0", "s1", "n"])

    def walk(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns]
            fresh = 0
            if held is not None:
                fresh = len(held[0])
                rows = [np.concatenate(c) for c in zip(held, rows)]
            trie, _, node, s0, s1, n = rows
            held = [c[-reach:] for c in rows]
            sims, limits = np.stack([s0, s1], axis=1).view(U64), near_limit(n)
            best, to = np.full(len(node), 1 << 30), np.zeros(len(node), np.int64)
            for lag in range(1, min(reach, len(node) - 1) + 1):
                i = np.arange(max(lag, fresh), len(node))
                keep, far = alike(sims, limits, n, i, i - lag)
                keep &= (trie[i] == trie[i - lag]) & (far < best[i])
                i, far = i[keep], far[keep]
                best[i], to[i] = far, node[i - lag]
            some = np.flatnonzero(best < 1 << 30)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(to[some]), pa.array(best[some])], ["a", "b", "far"])

    planted = reps.select("node", "sim", "n").mapInArrow(trimmed(plant), "trie int, code long, node long, s0 long, s1 long, n long")
    walked = planted.repartitionByRange("trie", "code", "node").sortWithinPartitions("trie", "code", "node").mapInArrow(trimmed(walk), "a long, b long, far long")
    best = walked.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best"))
    return best.select(F.greatest("a", "best.b").alias("a"), F.least("a", "best.b").alias("b")).distinct()


def places(sims: np.ndarray, counts: np.ndarray, order: np.ndarray, depth: int, tries: int):
    """The bucket of each fingerprint (rows of bytes), trie by trie; tries beyond ``tries`` hold the smallest texts alone.  -1 where a row isn't in a trie."""
    bits = np.unpackbits(sims, axis=1)
    weights = np.int64(1) << np.arange(depth, dtype=np.int64)
    tiny = (counts == 4) | (counts == 5)
    for t in range(len(order)):
        where = ((bits[:, order[t, :depth]].astype(np.int64) @ weights) << 13) | t
        yield where if t < tries else np.where(tiny, where, -1)


def dense_places(reps: DataFrame, order: np.ndarray, depth: int, tries: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of more than ``most`` rows, in order, and their sizes; there are at most rows x tries / ``most`` of them."""

    def count(batches):
        def flush(held):
            where, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(n, pa.int64())], ["place", "n"])

        held, size = [], 0
        for batch in batches:
            for where in places(_signed(batch.column(0)), batch.column(1).to_numpy(), order, depth, tries):
                held.append(where[where >= 0])
                size += len(held[-1])
            if size > 1 << 20:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    counts = reps.select("sim", "n").mapInArrow(trimmed(count), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    rows = sorted((r["place"], r["n"]) for r in counts.collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def compared(reps: DataFrame, n: int, recall: float, bucket: int, deeper: int, last: bool, most: int, work: int) -> DataFrame:
    """(a, b) pairs a > b of unlike labels that meet in a forest over n rows (node, sim, n, label); rows of a place left for a deeper forest come as (node, null).

    A place is left if it holds more than ``most`` rows or more than ``work`` comparisons.
    The last forest leaves none: a place of many rows is cut in groups, and each two groups
    meet in a task of their own.
    """
    depth, tries = forest_shape(n, recall, bucket, deeper=deeper)
    # sets of 4 and 5 shingles agree less: the tries beyond those for all are for them
    order = permutations(max(tries, forest_shape(n, recall, bucket, AGREE_TINY, deeper)[1]))
    most = max(most, n * len(order) >> 20)  # so that at most 2**20 places can be dense
    dense, sizes = dense_places(reps, order, depth, tries, most) if n > most else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    shipped = reps.sparkSession.sparkContext.broadcast((dense, -(-sizes // most)))
    names = ["place", "share", "node", "s0", "s1", "n", "label"]

    def plant(batches):
        dense, parts = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sims, counts = _signed(batch.column(1)), batch.column(2).to_numpy()
            halves = np.ascontiguousarray(sims).view(">u8").astype(U64).view(np.int64)
            node = batch.column(0).to_numpy()
            columns = [node, halves[:, 0], halves[:, 1], counts, batch.column(3).to_numpy()]
            left = np.zeros(len(node), bool)
            for where in places(sims, counts, order, depth, tries):
                rows, share = np.flatnonzero(where >= 0), 0
                if len(dense):
                    at = np.minimum(np.searchsorted(dense, where[rows]), len(dense) - 1)
                    times = np.where(dense[at] == where[rows], parts[at], 1)
                    if not last:
                        left[rows[times > 1]] = True
                        rows = rows[times == 1]
                    else:  # group g of a place meets each group, itself too
                        rows = np.repeat(rows, times)
                        other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                        times = np.repeat(times, times)
                        own = (mix(node[rows].astype(U64)) % times.astype(U64)).astype(np.int64)
                        share = (np.minimum(own, other) << 42) | (np.maximum(own, other) << 21) | times
                share = np.broadcast_to(np.asarray(share, np.int64), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (where[rows], share, *(c[rows] for c in columns))], names)
            if left.any():
                rows = np.flatnonzero(left)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (-1 - node[rows], np.zeros(len(rows), np.int64), *(c[rows] for c in columns))], names)

    def buckets(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            place, share = columns[:2]
            if held and (held[-1][0][-1] != place[0] or held[-1][1][-1] != share[0]):
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (share[1:] != share[:-1])) + 1).tolist(), len(place)]
            for first, final in zip(cuts, cuts[1:]):
                held.append([c[first:final] for c in columns])
                if final < len(place):
                    yield [np.concatenate(c) for c in zip(*held)]
                    held = []
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def meet(batches):
        held, size = [], 0

        def flush():
            a, b = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0)], ["a", "b"])

        for place, share, nodes, s0, s1, n, label in buckets(batches):
            _, kin = np.unique(label, return_counts=True)
            if place[0] < 0 or (not last and (len(nodes) ** 2 - int((kin**2).sum())) // 2 > work):
                held.append((nodes, np.full(len(nodes), -1)))
                size += len(nodes)
            elif len(kin) > 1:
                sims, limits, all_ = np.stack([s0, s1], axis=1).view(U64), near_limit(n), np.argsort(label, kind="stable")
                left = right = all_
                if share[0] and share[0] >> 42 != (share[0] >> 21) & ((1 << 21) - 1):
                    own = (mix(nodes[all_].astype(U64)) % U64(share[0] & ((1 << 21) - 1))).astype(np.int64)
                    low = share[0] >> 42
                    left, right = all_[own == low], all_[own != low]
                for i, j in meetings(sims, limits, n, label, left, right):
                    held.append((np.maximum(nodes[i], nodes[j]), np.minimum(nodes[i], nodes[j])))
                    size += len(i)
                    if size > 1 << 16:
                        yield flush()
                        held, size = [], 0
            if size > 1 << 16:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    planted = reps.select("node", "sim", "n", "label").mapInArrow(trimmed(plant), ", ".join(f"{c} long" for c in names))
    return planted.repartition("place", "share").sortWithinPartitions("place", "share", "label", "node").mapInArrow(trimmed(meet), "a long, b long").distinct()


def candidates(reps: DataFrame, n: int, recall: float = RECALL, bucket: int = BUCKET, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """(a, b) candidate pairs a > b of unlike labels from n rows (node, sim, n, label), forest by forest as density asks for."""
    found, rows, left = None, reps, n
    for level in range(levels):
        got = durable(compared(rows, left, recall, bucket, STEP * level, level + 1 == levels, most, (16 * bucket) ** 2 // 2))
        pairs = got.where("b is not null")
        found = pairs if found is None else found.union(pairs)
        if level + 1 < levels:
            marked = durable(got.where("b is null").select(F.col("a").alias("node")).distinct())
            # the depth counts the rows of the whole forest, so that a dense part isn't taken for a small one
            if not marked.limit(1).count():
                break
            rows = durable(reps.join(marked, "node"))
    return found.distinct()


def verify(docs: DataFrame, pairs: DataFrame, keys: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the given Jaccard similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(keys.select("node", "doc_id", "key"), "node")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col))).alias("key"))
    texts = durable(texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["node"]).select("node", "text"))

    def run(batches):
        def sets(column):
            raw, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string())))
            terms, bounds = shingles(*words(raw, offsets), SHINGLE)
            return [np.unique(terms[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]

        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 128):
                for x, y in zip(sets(batch.column(2).slice(at, 128)), sets(batch.column(3).slice(at, 128))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9 and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(trimmed(run), "a long, b long")


def text_classes(docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, bucket: int) -> DataFrame:
    """(key, doc_id, label) for each distinct text: its smallest id and the number of its class."""
    reps = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sim").alias("sim"), F.first("n").alias("n"))
    # a text is known by a number of its own, since texts may share an id; the numbers are written once
    reps = durable(reps.withColumn("node", F.monotonically_increasing_id()))
    taken = reps.where("doc_id is not null and n > 0")
    n = taken.count()
    # first the nearest neighbour of each text; then every candidate pair that the verified links leave apart
    best = durable(neighbours(taken))
    links = durable(verify(docs, best, taken, id_col, text_col, similarity))
    joined = durable(star_components(links, "a", "b"))
    labelled = durable(taken.select("node", "sim", "n").join(joined.select(F.col("id").alias("node"), "label"), "node", "left").select("node", "sim", "n", F.coalesce("label", "node").alias("label")))
    rest = candidates(labelled, n, recall, bucket).join(best, ["a", "b"], "left_anti")
    more = durable(verify(docs, durable(rest), taken, id_col, text_col, similarity))
    classes = star_components(links.union(more), "a", "b")
    return reps.join(classes, F.col("node") == F.col("id"), "left").select("key", "doc_id", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, class_id, text_key) for each row: class_id is the smallest doc_id of its class.

    Equal texts share a class; so do texts joined by a chain of links of at least the given
    similarity.  Texts without words are linked to equal texts only.  A null text is alone
    in its class.  Rows with a null id join the class of equal texts and have a null
    class where no row of it has an id.  Repeated rows stay; unlike texts under one id are
    searched each for itself; a text may have any length; other columns are ignored.  An
    empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    signed = durable(signatures(docs, id_col, text_col))
    texts = durable(text_classes(docs, signed, id_col, text_col, similarity, recall, bucket))
    ids = texts.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = texts.join(ids, "label").select("key", "class_id")
    # equal texts may be a third of all rows: the join on the text's key is salted
    salts = 8
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = signed.select("doc_id", "key").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"), F.lit(0)))
    out = rows.join(spread, ["key", "salt"], "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.col("key").alias("text_key"))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each class stays, of its smallest id, with all its columns.

    Rows of equal id and text are one document, whatever their other columns; unlike texts
    under one id are documents of their own.  Null texts are kept; of texts without any id
    one row stays.  Texts may have any length.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    number, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)), F.col(f"`{text_col}`")
    signed = durable(signatures(docs, id_col, text_col))
    texts = text_classes(docs, signed, id_col, text_col, similarity, RECALL, BUCKET)
    first = texts.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "key")).alias("first"))
    first = first.select(F.col("first.id").alias("_weft_id"), F.col("first.key").alias("_weft_key"))
    # repeats are dropped on the map side first: a third of all rows may be one text
    keyed = docs.where(text.isNotNull()).withColumns({"_weft_id": number, "_weft_key": F.unhex(F.md5(text))}).dropDuplicates(["_weft_id", "_weft_key"])
    stay = keyed.join(first, ["_weft_id", "_weft_key"], "left_semi").select(*[F.col(f"`{c}`") for c in names])
    return stay.unionByName(docs.where(text.isNull()))
