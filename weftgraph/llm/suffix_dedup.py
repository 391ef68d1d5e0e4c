"""Removal of repeated passages with suffix order and longest-previous-factor tests.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in an earlier document.
One suffix array over a whole corpus would need one machine, so its positions are first
split by content: each string position belongs to its minimiser, the position of the
smallest hash among the string's ``GRAM``-byte substrings.  Equal strings have equal
minimisers, so every bucket of minimisers can be sorted by itself.  In a bucket, the
positions are put in suffix order (cut at ``LENGTH`` bytes).  The previous and the next
smaller position in that order, by document, hold a position's longest earlier match: they
give the array of longest previous factors, and where it reaches ``LENGTH`` the string goes.
Surroundings that equal those of an earlier document whole, byte by byte, need no sorting:
all their strings go.

Stages, each of which visits the texts in the same stored blocks:

1. every block sends the distinct minimiser hashes to their buckets and learns which ones
   other blocks have too;
2. it sends the surroundings of those (at most 80 bytes, once per block) with its smallest
   document, and learns which positions have an earlier match;
3. it removes the bytes.

Whatever comes back is aligned with what the block sent; the texts themselves never move
again after they are stored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, prepare, release, shared_dir
from .textkernel import U64, RangeHash, buffers, hash_ranges

LENGTH, GRAM = 50, 20
_SPAN = LENGTH - GRAM + 1
#: Longest surroundings of a minimiser: all strings that it stands for.
_REACH = LENGTH + _SPAN - 1
#: Bytes of text in a stored block, positions worked on at once, and minimisers that a bucket is meant to hold.
BLOCK_BYTES, STEP, BUCKET = 1 << 20, 1 << 19, 100_000
#: String positions that are put in suffix order at once.
STRINGS = 1 << 18


def minimisers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string positions with one minimiser: first position, count, offset of the minimiser from it, its hash."""
    found = []
    n = len(raw)
    room = np.repeat(offsets[1:], np.diff(offsets))  # end of each byte's text
    for at in range(0, max(n - LENGTH + 1, 0), STEP):
        stop = min(at + STEP, n - LENGTH + 1)
        piece = raw[at : stop + LENGTH - 1]
        starts = np.arange(len(piece) - GRAM + 1)
        h = RangeHash(piece).of(starts, starts + GRAM)
        low = ((h >> U64(24)) << U64(24)) | starts.astype(U64)  # ties fall to the leftmost
        width = 1
        while width * 2 <= _SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < _SPAN:
            low = np.minimum(low[: len(low) - (_SPAN - width)], low[_SPAN - width :])
        where = (low & U64((1 << 24) - 1)).astype(np.int64)
        p = np.flatnonzero(np.arange(at, stop) + LENGTH <= room[at:stop])
        if not len(p):
            continue
        a = where[p]
        change = np.ones(len(p), bool)
        change[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(change)
        found.append((p[first] + at, np.diff(np.append(first, len(p))), a[first] - p[first], h[a[first]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


class Block:
    """The minimisers of a stored block of texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ords: np.ndarray):
        self.raw, self.offsets, self.ords = raw, offsets, ords
        self.first, self.count, self.off, self.key = minimisers(raw, offsets)
        self.owner = np.searchsorted(offsets, self.first, "right") - 1

    def keys(self) -> np.ndarray:
        return np.unique(self.key)

    def local(self) -> np.ndarray:
        """Distinct keys that stand in more than one document of this block."""
        order = np.lexsort((self.owner, self.key))
        k, o = self.key[order], self.owner[order]
        again = (k[1:] == k[:-1]) & (o[1:] != o[:-1])
        return np.unique(k[1:][again])

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal surroundings: (group of each run, a run standing for each group, its smallest document order).

        The run that stands for a group is its first one.
        """
        size = self.count + LENGTH - 1
        ctx = hash_ranges(self.raw, self.first, self.first + size)
        order = np.lexsort((np.arange(len(ctx)), size, ctx, self.key))
        k, c, s = self.key[order], ctx[order], size[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        alike = np.flatnonzero(~fresh)  # equal hashes are confirmed on the bytes
        fresh[alike] = ~same_bytes(self.raw, self.first[order[alike]], self.first[order[alike - 1]], s[alike])
        group = np.empty(len(k), np.int64)
        group[order] = np.cumsum(fresh) - 1
        stand = order[fresh]
        least = np.minimum.reduceat(self.ords[self.owner[order]], np.flatnonzero(fresh)) if len(k) else np.zeros(0, np.int64)
        return group, stand, least


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (up to _REACH) from each of ``a`` on equal those from ``b`` on."""
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(_REACH, np.uint8)]), _REACH)
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        s = slice(at, at + (1 << 15))
        out[s] = ((view[a[s]] == view[b[s]]) | (np.arange(_REACH) >= size[s, None])).all(1)
    return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """The last earlier position with a strictly smaller value, -1 where there is none: up and down a tree of minima."""
    n = len(values)
    levels = [values]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = levels[-1] = np.append(low, np.iinfo(np.int64).max)
        levels.append(np.minimum(low[::2], low[1::2]))
    found = np.full(n, -1, np.int64)
    rest = np.arange(n)
    for height, low in enumerate(levels[:-1]):
        node = rest >> height
        # the left sibling of a right child lies just before all that was looked at
        hit = (node % 2 == 1) & (low[np.maximum(node - 1, 0)] < values[rest])
        who, at = rest[hit], node[hit] - 1
        for down in range(height - 1, -1, -1):
            at = 2 * at + 1
            at -= levels[down][at] >= values[who]
        found[who] = at
        rest = rest[~hit]
    return found


def longest_previous_factors(raw: np.ndarray, at: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """For each string position the length, up to LENGTH, of its longest factor that also starts in a smaller document order.

    The positions are put in suffix order.  The nearest smaller positions before and after
    a position in that order, by document order, hold its longest earlier match; its length
    is counted on the bytes.
    """
    view = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    suffix = np.argsort(view[at].view(f"S{LENGTH}").ravel(), kind="stable")
    own = ords[suffix]
    n = len(at)
    before = nearest_smaller(own)
    after = nearest_smaller(own[::-1])[::-1]
    after = np.where(after < 0, -1, n - 1 - after)
    lpf = np.zeros(n, np.int64)
    for other in (before, after):
        some = np.flatnonzero(other >= 0)
        for k in range(0, len(some), 1 << 15):
            here = some[k : k + (1 << 15)]
            unlike = view[at[suffix[here]]] != view[at[suffix[other[here]]]]
            length = np.where(unlike.any(1), unlike.argmax(1), LENGTH)
            lpf[suffix[here]] = np.maximum(lpf[suffix[here]], length)
    return lpf


def earlier_matches(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, keys: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """For each record (``counts`` string positions from ``starts`` on) a bit mask of those with a match in a smaller document order."""
    n = len(starts)
    full = (U64(1) << counts.astype(U64)) - U64(1)
    mask = np.zeros(n, U64)
    hashes = hash_ranges(raw, starts, starts + counts + LENGTH - 1)
    order = np.lexsort((ords, counts, hashes, keys))
    k, h, c = keys[order], hashes[order], counts[order]
    new_key = np.ones(n, bool)
    new_key[1:] = k[1:] != k[:-1]
    new_form = new_key.copy()
    new_form[1:] |= (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    alike = np.flatnonzero(~new_form)  # equal hashes are confirmed on the bytes
    new_form[alike] = ~same_bytes(raw, starts[order[alike]], starts[order[alike - 1]], c[alike] + LENGTH - 1)
    form = np.cumsum(new_form) - 1
    least = ords[order][np.flatnonzero(new_form)]  # sorted by order within a form
    later = ords[order] > least[form]
    mask[order[later]] = full[order[later]]  # the same surroundings stand in an earlier document
    # keys with several forms: the first document of each form is tested string by string
    forms_of_key = np.add.reduceat(new_form.astype(np.int64), np.flatnonzero(new_key)) if n else np.zeros(0, np.int64)
    several = forms_of_key[np.cumsum(new_key) - 1] > 1
    rest = order[several & ~later]
    if len(rest):
        lone = order[np.flatnonzero(new_form & several)]  # one record per form carries its strings
        lone_form = form[np.flatnonzero(new_form & several)]
        form_bits: dict[int, int] = {}
        # strings of different keys differ, so keys are taken a few at a time
        turns = np.flatnonzero(np.concatenate([[True], keys[lone][1:] != keys[lone][:-1]]))
        total = np.concatenate([[0], np.cumsum(counts[lone])])
        first = 0
        while first < len(turns):
            low = turns[first]
            last = max(first + 1, int(np.searchsorted(total[turns], total[low] + STRINGS)))
            high = turns[last] if last < len(turns) else len(lone)
            part = lone[low:high]
            bits = _suffix_test(raw, starts[part], counts[part], ords[part])
            form_bits.update(zip(lone_form[low:high].tolist(), bits.tolist()))
            first = last
        form_at = np.empty(n, np.int64)
        form_at[order] = form
        mask[rest] = [form_bits[f] for f in form_at[rest].tolist()]
    return mask


def _suffix_test(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """Per record, the bits of its string positions whose longest previous factor reaches ``LENGTH``."""
    record = np.repeat(np.arange(len(starts)), counts)
    inside = np.arange(len(record)) - np.repeat(np.cumsum(counts) - counts, counts)
    long = np.flatnonzero(longest_previous_factors(raw, starts[record] + inside, ords[record]) >= LENGTH)
    bits = np.zeros(len(starts), U64)
    np.bitwise_or.at(bits, record[long], U64(1) << inside[long].astype(U64))
    return bits


def block_size(docs: DataFrame) -> int:
    """Bytes of a block: a passage that every block holds sends one record a block to one task, so blocks grow with a very large corpus."""
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(BLOCK_BYTES, min(stored >> 22, 32 * BLOCK_BYTES)) if stored < 1 << 60 else BLOCK_BYTES  # a size not known counts as small


def _store(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The texts in blocks, in a table bucketed by ``part`` so that joins on it don't move them; and the bytes of all texts."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != text_col]
    buckets = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a number for each bucket that Spark's hash puts there, so that tasks fill the buckets evenly
    hashed = spark.range(24 * buckets).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("b"))
    label = {r.b: r.v for r in hashed.groupBy("b").agg(F.min("v").alias("v")).collect()}
    label = [label.get(b, next(iter(label.values()))) for b in range(buckets)]

    def run(batches):
        task = TaskContext.get().partitionId()
        part, serial = label[task % buckets], task << 24
        held, size = [], 0

        def flush():
            nonlocal held, size, serial
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            raw, offsets = buffers(table.column("_weft_text"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.drop_columns(["_weft_text", "_weft_ord"]).schema) as out:
                out.write_table(table.drop_columns(["_weft_text", "_weft_ord"]))
            ords = table.column("_weft_ord").to_numpy()
            serial += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([serial], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([raw.tobytes()], pa.binary()), pa.array([offsets.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(ords).tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["part", "block", "n", "raw", "offsets", "ords", "rest"],
            )

        for batch in batches:
            at = 0
            _, offsets = buffers(batch.column(0))
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes - size, "right")) - 1)
                end = min(end, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(offsets[end] - offsets[at])
                at = end
                if size >= block_bytes or at < batch.num_rows:
                    yield flush()
        if held:
            yield flush()
        release()

    chosen = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_weft_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_weft_ord"), F.col(text_col).isNull().alias("_weft_null"), *[F.col(f"`{c}`") for c in names])
    blocks = chosen.mapInArrow(run, "part int, block long, n long, raw binary, offsets binary, ords binary, rest binary")
    name = f"weftgraph_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/weftgraph/{name}"
    # few blocks to a row group: readers and writers hold a group in memory
    blocks.write.option("path", path).option("compression", "zstd").option("parquet.block.row.count.limit", "8").bucketBy(buckets, "part").saveAsTable(name)
    stored = spark.table(name)
    return stored, stored.agg(F.sum("n")).first()[0] or 0


def _blocks(batch: pa.RecordBatch, *more: str):
    """The stored blocks of a batch one by one, with the values of further columns; bytes aren't copied."""
    view = lambda name, k, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
    for k in range(batch.num_rows):
        yield Block(view("raw", k, np.uint8), view("offsets", k, np.int64), view("ords", k, np.int64)), *(batch.column(c)[k] for c in more)
        release()


def _answers(answers, number: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, got, ids) of the answers for one block of a part."""
    if answers.is_valid:
        rows = answers.values
        for k in np.flatnonzero(rows.field("block").to_numpy() == number):
            yield rows.field("bucket")[k].as_py(), rows.field("got")[k].as_py(), rows.field("ids")[k].as_py()


def _narrow(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the bucket's, as five bytes each."""
    rest = ((keys << U64(bits)) >> U64(24)).astype(">u8")
    return rest.view(np.uint8).reshape(-1, 8)[:, 3:].copy()


def _wide(data: bytes) -> np.ndarray:
    five = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, 3:] = five
    return out.view(">u8").ravel().astype(U64)


def _slices(sorted_buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(sorted_buckets)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sorted_buckets)]):
        if b > a:
            yield int(sorted_buckets[a]), slice(a, b)


def _removed(docs: DataFrame, emit, schema, id_col: str, text_col: str, block_bytes: int | None) -> DataFrame:
    """Run the three stages; ``emit(block, gone, rest)`` makes the record batch of a block, ``gone`` marks its removed bytes."""
    spark = docs.sparkSession
    prepare(spark)
    blocks, total = _store(docs, id_col, text_col, block_bytes or block_size(docs))
    bits = max(3, int(np.ceil(np.log2(max(total / (_SPAN / 2) / BUCKET, 1)))))
    shift = U64(64 - bits)
    answer = "array<struct<block: long, bucket: int, got: binary, ids: binary>>"

    def send_keys(batches):
        for batch in batches:
            for opened, part, block in _blocks(batch, "part", "block"):
                part, block, keys = part.as_py(), block.as_py(), opened.keys()
                rows = list(_slices((keys >> shift).astype(np.int64)))
                five = _narrow(keys, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([five[s].tobytes() for _, s in rows], pa.binary())],
                    ["bucket", "part", "block", "keys"],
                )

    def shared_keys(group: pa.Table) -> pa.Table:
        parts = [_wide(k) for k in group.column("keys").to_pylist()]
        every = np.sort(np.concatenate(parts))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        got = []
        for p in parts:
            at = np.minimum(np.searchsorted(again, p), max(len(again) - 1, 0))
            got.append(np.packbits(again[at] == p).tobytes() if len(again) else b"")
        out = pa.table({"part": group.column("part"), "block": group.column("block"), "bucket": group.column("bucket"), "got": pa.array(got, pa.binary()), "ids": pa.array([b""] * len(got), pa.binary())})
        release()
        return out.filter(pa.array([len(g) > 0 for g in got]))

    back = "part int, block long, bucket int, got binary, ids binary"
    small = blocks.select("part", "block", "raw", "offsets", "ords")
    keyed = small.mapInArrow(send_keys, "bucket int, part int, block long, keys binary")
    known = keyed.groupBy("bucket").applyInArrow(shared_keys, back)

    def per_part(rows: DataFrame) -> DataFrame:
        return rows.groupBy("part").agg(F.collect_list(F.struct("block", "bucket", "got", "ids")).alias("answers")).hint("shuffle_hash")

    def send_contexts(batches):
        for batch in batches:
            for block, part, number, answers in _blocks(batch, "part", "block", "answers"):
                part, number = part.as_py(), number.as_py()
                keys = block.keys()
                shared = np.zeros(len(keys), bool)
                place = dict(_slices((keys >> shift).astype(np.int64)))
                for bucket, got, _ in _answers(answers, number):
                    s = place[bucket]
                    shared[s] = np.unpackbits(np.frombuffer(got, np.uint8))[: s.stop - s.start].astype(bool)
                shared |= np.isin(keys, block.local(), assume_unique=True)
                group, stand, least = block.groups()
                chosen = shared[np.searchsorted(keys, block.key[stand])] if len(stand) else np.zeros(0, bool)
                stand, least = stand[chosen], least[chosen]
                if not len(stand):
                    continue
                first, size = block.first[stand], block.count[stand] + LENGTH - 1
                ends = np.cumsum(size)
                where = (block.key[stand] >> shift).astype(np.int64)  # groups are in key order
                take = np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))
                text = block.raw[take]
                rows = list(_slices(where))
                low = lambda s: int(ends[s.start] - size[s.start])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in rows], pa.int32()),
                        pa.array([part] * len(rows), pa.int32()),
                        pa.array([number] * len(rows), pa.int64()),
                        pa.array([text[low(s) : int(ends[s.stop - 1])].tobytes() for _, s in rows], pa.binary()),
                        pa.array([size[s].astype(np.uint8).tobytes() for _, s in rows], pa.binary()),
                        pa.array([block.off[stand[s]].astype(np.uint8).tobytes() for _, s in rows], pa.binary()),
                        pa.array([least[s].tobytes() for _, s in rows], pa.binary()),
                        pa.array([stand[s].astype(np.uint32).tobytes() for _, s in rows], pa.binary()),
                    ],
                    ["bucket", "part", "block", "text", "sizes", "offs", "least", "ids"],
                )

    def match(group: pa.Table) -> pa.Table:
        join = lambda c, t: np.frombuffer(b"".join(group.column(c).to_pylist()), t)
        raw, sizes = join("text", np.uint8), join("sizes", np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        at = starts + join("offs", np.uint8)
        keys = hash_ranges(raw, at, at + GRAM)
        mask = earlier_matches(raw, starts, sizes - LENGTH + 1, keys, join("least", np.int64)).astype(np.uint32)
        lengths = [len(x) for x in group.column("sizes").to_pylist()]
        ends = np.cumsum(lengths)
        got, ids = [], []
        for e, n, i in zip(ends, lengths, group.column("ids").to_pylist()):
            m = mask[e - n : e]
            got.append(m[m > 0].tobytes())
            ids.append(np.frombuffer(i, np.uint32)[m > 0].tobytes())
        out = pa.table({"part": group.column("part"), "block": group.column("block"), "bucket": group.column("bucket"), "got": pa.array(got, pa.binary()), "ids": pa.array(ids, pa.binary())})
        release()
        return out.filter(pa.array([len(g) > 0 for g in got]))

    told = small.join(per_part(known), "part", "left")
    sent = told.select("part", "block", "raw", "offsets", "ords", F.col("answers").cast(answer).alias("answers")).mapInArrow(send_contexts, "bucket int, part int, block long, text binary, sizes binary, offs binary, least binary, ids binary")
    matched = sent.groupBy("bucket").applyInArrow(match, back)

    def remove(batches):
        for batch in batches:
            for block, number, rest, answers in _blocks(batch, "block", "rest", "answers"):
                group, stand, least = block.groups()
                mask_of = np.zeros(len(stand), U64)
                place = np.zeros(len(block.first), np.int64)
                place[stand] = np.arange(len(stand))
                for _, got, ids in _answers(answers, number.as_py()):
                    mask_of[place[np.frombuffer(ids, np.uint32)]] = np.frombuffer(got, np.uint32)
                n = len(block.raw)
                edge = np.zeros(n + 1, np.int32)
                if len(group):
                    full = (U64(1) << block.count.astype(U64)) - U64(1)
                    mask = np.where(block.ords[block.owner] > least[group], full, mask_of[group])
                    for j in range(_SPAN):
                        at = block.first[(mask >> U64(j)) & U64(1) == 1] + j
                        if len(at):
                            edge[at] += 1  # the positions of one bit are distinct
                            edge[at + LENGTH] -= 1
                gone = np.cumsum(edge[:n]) > 0
                yield emit(block, gone, pa.ipc.open_stream(rest.as_buffer()).read_all())

    told = blocks.join(per_part(matched), "part", "left")
    return told.select("block", "raw", "offsets", "ords", "rest", F.col("answers").cast(answer).alias("answers")).mapInArrow(remove, schema)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row.

    Null texts count as empty.  A null id comes after all others.  Rows of one id don't
    remove each other's bytes, repeated rows included.  Texts below ``LENGTH`` bytes lose
    nothing.  An empty table gives an empty result; other columns are ignored.
    """

    def emit(block, gone, rest):
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        heads = block.offsets[:-1][np.diff(block.offsets) > 0]
        starts[heads] = gone[heads]
        counts = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(starts)])
        a, b = block.offsets[:-1], block.offsets[1:]
        sha = [hashlib.sha256((block.raw[x:y][~gone[x:y]] if counts[y] > counts[x] else block.raw[x:y]).tobytes()).hexdigest() for x, y in zip(a, b)]
        ids = rest.column(id_col).combine_chunks().cast(pa.int64())
        return pa.RecordBatch.from_arrays([ids if not isinstance(ids, pa.ChunkedArray) else ids.chunk(0), pa.array(b - a), pa.array(counts[b] - counts[a]), pa.array(spans[b] - spans[a]), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    chosen = docs.select(id_col, text_col)
    return _removed(chosen, emit, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, block_bytes)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes removed from the texts; characters cut in two go whole.

    Null texts stay null; texts that are removed whole become empty.  A null id comes after
    all others; rows of one id (repeated rows and ties included) keep what they share; a text
    may have any length; all rows and columns stay, whatever the names.  An empty table gives
    an empty result.
    """
    names, schema = docs.columns, docs.schema

    def emit(block, gone, rest):
        null = rest.column("_weft_null").to_pylist()
        texts = []
        for x, y, none in zip(block.offsets[:-1], block.offsets[1:], null):
            texts.append(None if none else block.raw[x:y][~gone[x:y]].tobytes().decode("utf-8", "ignore"))
        columns = {c: rest.column(c) for c in names if c != text_col} | {text_col: pa.chunked_array([pa.array(texts, pa.string())])}
        return pa.table({c: columns[c] for c in names}).combine_chunks().to_batches(max_chunksize=1 << 30)[0]

    return _removed(docs, emit, schema, id_col, text_col, block_bytes)
