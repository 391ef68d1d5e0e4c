"""Quality scores from random-indexing word vectors and a small network.

Every token has a sparse random index vector.  A word's vector is the sum of the index
vectors of its neighbours over the whole corpus (random indexing: one pass, no labels); each
word has a vector of its own, in a distributed table that grows with the vocabulary.  A
document is the pooled mean of its word vectors.  A two-layer numpy network on the pooled
vectors gives logits whose temperature is calibrated on rows held back from its training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, prepare, trimmed
from .textkernel import CHUNK, U64, buffers, chunks, hash_ranges, reduceat, runs

DIM = 48
#: Random index entries per token, neighbours on each side, and how often a word must occur to have a vector.
ENTRIES, WINDOW, COUNT = 2, 2, 3
#: Bound on the labelled rows of a fit.
SAMPLE = 8000
#: Most frequent words that are broadcast (56 bytes each); what is beyond them is joined.
HEAD = 1 << 19
#: Bits of a word by which texts rule out what the joined table hasn't, at most: 2 ** MARKS marks are broadcast.
MARKS = 27
#: Words that a task gathers before it hands them on, and units up to which a sum travels as a list of them.
HELD, UNITS = 1 << 18, 64
#: Occurrences up to which the sums of a word fit a byte each, and tokens whose neighbours are added up at once.
FEW, BLOCK = 127 // (2 * WINDOW * ENTRIES), 1 << 16

#: Byte classes: white space 0, letters 1 (non-ASCII bytes too), digits 2, other signs 3.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(9, 14), 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[list(range(48, 58))] = 2


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens (runs of one byte class, as written) and, per text, the first token's index."""
    kind = _CLASS[raw]
    parts = [runs(raw, offsets, kind == c)[:2] for c in (1, 2, 3)]
    starts, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return hash_ranges(raw, starts, ends), np.searchsorted(starts, offsets)


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of about ``most`` bytes each; a longer text comes in several, cut at white space."""
    for first, last in chunks(offsets, most):
        at, stop = int(offsets[first]), int(offsets[last])
        if stop - at <= 2 * most:
            yield first, raw[at:stop], offsets[first : last + 1] - at
            continue
        while at < stop:
            end = min(at + most, stop)
            gaps = np.flatnonzero(_CLASS[raw[at:end]] == 0)
            if end < stop and len(gaps):
                end = at + int(gaps[-1]) + 1
            while end < stop and _CLASS[raw[end - 1]] != 0:  # a run beyond the piece stays whole
                block = raw[end : min(end + most, stop)]
                gaps = np.flatnonzero(_CLASS[block] == 0)
                end += int(gaps[0]) + 1 if len(gaps) else len(block)
            yield first, raw[at:end], np.array([0, end - at])
            at = end


def spots(token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The entries of tokens' index vectors: places and signs."""
    for e in range(ENTRIES):
        bits = token >> U64(20 * e + 4)
        yield ((bits & U64(0xFFFF)) % U64(DIM)).astype(np.int64), np.where((bits >> U64(16)) & U64(1), 1.0, -1.0)


def neighbour_sums(token: np.ndarray, bounds: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, sums): for each distinct token the sum of its neighbours' index vectors; of the tokens from ``first`` to ``last``, whose neighbours may lie outside."""
    last = len(token) if last is None else last
    low, high = max(first - WINDOW, 0), min(last + WINDOW, len(token))
    word, at, n = np.unique(token[first:last], return_inverse=True, return_counts=True)
    owner = np.searchsorted(bounds, np.arange(low, high), "right")
    entries = list(spots(token[low:high]))
    places, signs = [], []
    for gap in range(1, WINDOW + 1):
        same = np.flatnonzero(owner[gap:] == owner[:-gap]) + low
        for a, b in ((same, same + gap), (same + gap, same)):
            inside = (a >= first) & (a < last)
            row, near = at[a[inside] - first] * DIM, b[inside] - low
            for spot, sign in entries:
                places.append(row + spot[near])
                signs.append(sign[near])
    sums = np.bincount(np.concatenate(places), np.concatenate(signs), minlength=len(word) * DIM)
    return word, n, np.rint(sums).astype(np.int32).reshape(-1, DIM)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of (words, counts, sums) with equal words added up, in word order."""
    word, n, sums = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(word, kind="stable")
    word = word[order]
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    if not len(first):
        return word, n, sums
    return word[first], np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0)


def narrowed(word: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words, counts, and sums of words of at most FEW occurrences in a byte each, apart from the others."""
    few = n <= FEW
    return word.copy(), n.copy(), sums[few].astype(np.int8), sums[~few]


def widened(word: np.ndarray, n: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``narrowed`` was given."""
    sums, few = np.empty((len(n), DIM), np.int32), n <= FEW
    sums[few], sums[~few] = small, large
    return word, n, sums


class Gathered:
    """Counts and sums of the words that a task meets, in ranges of words that are added up and packed one at a time."""

    def __init__(self, bits: int):
        self.bits, top = bits, min(bits, 4)
        self.edges = np.arange(1, 1 << top, dtype=U64) << U64(64 - top)
        self.ranges: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(1 << top)]
        self.fresh = self.held = 0

    def add(self, word: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        """Take more words, sorted."""
        ends = [0, *np.searchsorted(word, self.edges), len(word)]
        for k, parts in enumerate(self.ranges):
            if ends[k] < ends[k + 1]:
                rows = slice(ends[k], ends[k + 1])
                parts.append(narrowed(word[rows], n[rows], sums[rows]))
        self.fresh += len(word)
        if self.fresh > HELD // 2:
            self.fresh = self.held = 0
            for parts in self.ranges:
                if parts:
                    parts[:] = [narrowed(*merged([widened(*p) for p in parts]))]
                    self.held += len(parts[0][0])

    def handed(self) -> Iterator[pa.RecordBatch]:
        """All words so far, ``packed``; none stay."""
        for parts in self.ranges:
            if parts:
                rows = packed(*merged([widened(*p) for p in parts]), self.bits)
                parts.clear()
                yield rows
        self.fresh = self.held = 0


def gathered(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The words of batches of texts with their counts and sums, ``packed``; HELD of them are added up before they are handed on."""
    kept = Gathered(bits)
    for batch in batches:
        for _, raw, offsets in pieces(*buffers(batch.column(0))):
            token, bounds = tokens(raw, offsets)
            for first in range(0, len(token), BLOCK):
                kept.add(*neighbour_sums(token, bounds, first, min(first + BLOCK, len(token))))
                if kept.held > HELD:
                    yield from kept.handed()
    yield from kept.handed()


def packed(word: np.ndarray, n: np.ndarray, sums: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted words, counts and sums, one row for each range of words that share their first ``bits`` bits.

    A row for each word would cost more than its content.  A small sum is a list of units, a byte each: its place and sign.
    """
    weight = np.abs(sums).sum(1)
    short = weight <= UNITS
    row, place = np.nonzero(sums[short])
    value = sums[short][row, place]
    units = np.repeat((place + 64 * (value < 0)).astype(np.uint8), np.abs(value))
    sizes, dense = np.where(short, weight, 255).astype(np.uint8), sums[~short].astype("<i4")
    part = (word >> U64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(first, len(word))
    unit_ends, dense_ends = (np.concatenate([[0], np.cumsum(c)])[ends] for c in (np.where(short, weight, 0), ~short))
    blobs = []
    for k in range(len(first)):
        rows = slice(ends[k], ends[k + 1])
        parts = word[rows], n[rows].astype("<i8"), sizes[rows], units[unit_ends[k] : unit_ends[k + 1]], dense[dense_ends[k] : dense_ends[k + 1]]
        blobs.append(b"".join([int(ends[k + 1] - ends[k]).to_bytes(8, "little"), *(c.tobytes() for c in parts)]))
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "words"])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and sums of one row."""
    k = int.from_bytes(blob[:8], "little")
    word, n = np.frombuffer(blob, "<u8", k, 8), np.frombuffer(blob, "<i8", k, 8 + 8 * k)
    sizes = np.frombuffer(blob, np.uint8, k, 8 + 16 * k)
    short = sizes != 255
    total = int(sizes[short].sum(dtype=np.int64))
    units = np.frombuffer(blob, np.uint8, total, 8 + 17 * k)
    at = np.repeat(np.flatnonzero(short) * DIM, sizes[short]) + (units & 63)
    sums = np.bincount(at, 1.0 - 2.0 * (units >> 6), minlength=k * DIM).astype(np.int32).reshape(k, DIM)
    sums[~short] = np.frombuffer(blob, "<i4", -1, 8 + 17 * k + total).reshape(-1, DIM)
    return word, n, sums


def shortened(sums: np.ndarray) -> pa.Array:
    """Sums as bytes: those of rare words, none beyond 7, in half a byte each; others as vectors of unit length in a byte each."""
    small = np.abs(sums).max(1, initial=0) <= 7
    half = (sums + 8).astype(np.uint8)
    half = half[:, ::2] << 4 | half[:, 1::2]
    return pa.array([(a if s else b).tobytes() for s, a, b in zip(small.tolist(), half, _unit(sums))], pa.binary())


def _unit(sums: np.ndarray) -> np.ndarray:
    x = sums.astype(np.float64)
    return np.rint(127 * x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.int8)


def lengthened(column: pa.Array) -> np.ndarray:
    """The vectors of unit length, in a byte each, of what ``shortened`` gave."""
    raw, offsets = buffers(column)
    size = np.diff(offsets)
    small = size < DIM
    inside = np.repeat(small, size)
    half = raw[inside].reshape(-1, DIM // 2)
    out = np.empty((len(size), DIM), np.int8)
    out[small] = _unit(np.stack([half >> 4, half & 15], axis=2).reshape(-1, DIM).astype(np.int32) - 8)
    out[~small] = raw[~inside].view(np.int8).reshape(-1, DIM)
    return out


def word_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, v): each word of at least COUNT occurrences with its ``shortened`` vector, stored.

    A task adds up what it meets of each word and hands it on; the parts are added by word.
    """
    spark = docs.sparkSession
    prepare(spark)
    # several ranges of words to a task, so that one at a time is small
    bits = min(30, (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())

    def add(batches):
        last, parts, held = None, [], 0
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if parts and part != last:
                    yield vectors(*merged(parts))
                    parts, held = [], 0
                last = part
                parts.append(unpacked(blob.as_py()))
                held += len(parts[-1][0])
                if held > HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0]) // 2
        if parts:
            yield vectors(*merged(parts))

    def vectors(word, n, sums):
        often = n >= COUNT
        return pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often]), shortened(sums[often])], ["word", "n", "v"])

    parts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(trimmed(lambda batches: gathered(batches, bits)), "part int, words binary")
    return durable(parts.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(add), "word long, n long, v binary"))


def word_vectors(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, v): the table of words with vectors of unit length, in a byte each."""

    def run(batches):
        for batch in batches:
            yield batch.set_column(2, "v", _bytes(lengthened(batch.column(2))))

    return word_table(docs, text_col).mapInArrow(trimmed(run), "word long, n long, v binary")


def marked(words: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A mark for each value that the first bits of about ``n`` words may have, set if the table has such a word, in packed bits; and the count of those bits.

    A table that ``word_table`` stored lies in ranges of words, so that the driver gets each block of marks about once.
    """
    bits = min(MARKS, max(16, (32 * n).bit_length()))
    size = 1 << (bits - 15)  # bytes of a block

    def run(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(U64) >> U64(64 - bits)).astype(np.int64)
            owner = at >> (bits - 12)
            for k in np.unique(owner).tolist():
                own = at[owner == k] & (8 * size - 1)
                np.bitwise_or.at(blocks.setdefault(k, np.zeros(size, np.uint8)), own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), _bytes(blocks.values())], ["k", "marks"])

    marks = np.zeros(1 << (bits - 3), np.uint8)
    for r in words.select("word").mapInArrow(trimmed(run), "k int, marks binary").collect():
        marks[r["k"] * size : (r["k"] + 1) * size] |= np.frombuffer(bytes(r["marks"]), np.uint8)
    return marks, bits


class Head:
    """The most frequent words of a table, at most ``most``, as arrays; ``tail`` is the table of the others, None if there is none, with its marks."""

    def __init__(self, words: DataFrame, most: int = HEAD):
        self.tail = self.marks = self.bits = None
        n = words.count()
        if n > most:
            # frequencies in eighths of an octave: a few hundred numbers tell from where on the words are few enough
            step = F.floor(8 * F.log2(F.col("n").cast("double")))
            found, total = None, 0
            for r in sorted(words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["s"]):
                total += r["c"]
                if total > most:
                    break
                found = r["s"]
            head = F.lit(False) if found is None else step >= found
            words, self.tail = words.where(head), words.where(~head).select("word", "v")
            self.marks, self.bits = marked(self.tail, n)
        rows = words.select("word", "v").toArrow()
        word = rows.column("word").to_numpy().view(U64)
        vectors = np.concatenate([np.zeros((0, DIM), np.int8), *map(lengthened, rows.column("v").chunks)])
        order = np.argsort(word)
        self.word, self.vectors = word[order], vectors[order]

    def __getstate__(self):
        return {"word": self.word, "vectors": self.vectors, "marks": self.marks, "bits": self.bits}

    def pool(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: sums of word vectors and of index vectors, counts of tokens and of those with a vector; and (text, word) of the words not found that the table of the others may have."""
        raw, offsets = buffers(column)
        n = len(offsets) - 1
        sums, plain, count, known = np.zeros((n, DIM)), np.zeros((n, DIM)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        missed = []
        for first, piece, local in pieces(raw, offsets, CHUNK // 2):
            token, bounds = tokens(piece, local)
            rows = slice(first, first + len(local) - 1)
            size = np.diff(bounds)
            owner = np.repeat(np.arange(len(size)), size)
            for spot, sign in spots(token):
                plain[rows] += np.bincount(owner * DIM + spot, sign, minlength=len(size) * DIM).reshape(-1, DIM)
            at = np.minimum(np.searchsorted(self.word, token), max(len(self.word) - 1, 0))
            hit = np.flatnonzero(self.word[at] == token) if len(self.word) else np.zeros(0, np.int64)
            # whole numbers: any order of sums gives the same
            inside = np.searchsorted(hit, bounds)
            sums[rows] += reduceat(np.add, self.vectors[at[hit]].astype(np.int32), inside, 0)
            count[rows] += size
            known[rows] += np.diff(inside)
            lost = np.ones(len(token), bool)
            lost[hit] = False
            if self.marks is not None:
                at = token >> U64(64 - self.bits)
                lost &= (self.marks[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
            missed.append((owner[lost] + first, token[lost]))
        return sums, plain, count, known, missed


def _finished(sums: np.ndarray, plain: np.ndarray, count: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per text: the mean word vector, its length, the mean index vector's length (``plain``), the log of the token count and the share of tokens with a vector."""
    n = np.maximum(count, 1)[:, None]
    mean = sums / n / 127
    rest = [np.linalg.norm(mean, axis=1), plain, np.log1p(count) / 10, known / n[:, 0]]
    return np.concatenate([mean, np.stack(rest, axis=1)], axis=1).astype(np.float32)


def _length(plain: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Lengths of the mean index vectors."""
    return np.linalg.norm(plain / np.maximum(count, 1)[:, None], axis=1)


def _whole(rows: np.ndarray) -> pa.Array:
    """Rows of whole numbers, each in as few bytes as its largest one needs."""
    most = np.abs(rows).max(1, initial=0)
    kinds = np.where(most < 1 << 15, "<i2", np.where(most < 1 << 31, "<i4", "<i8"))
    return pa.array([r.astype(k).tobytes() for r, k in zip(rows, kinds.tolist())], pa.binary())


def _numbers(column: pa.Array) -> np.ndarray:
    """The rows of ``_whole``; null is a row of zeros."""
    out = np.zeros((len(column), DIM), np.int64)
    for row, value in zip(out, column.to_pylist()):
        if value is not None:
            row[:] = np.frombuffer(value, f"<i{len(value) // DIM}")
    return out


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def pooled(docs: DataFrame, head: Head, keep: str, text_col: str = "text") -> DataFrame:
    """The columns of the schema string ``keep`` and ``x``, the pooled features of the whole text (null counts as empty)."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(head)  # HEAD words at most
    names = [c.split()[0] for c in keep.split(", ")]
    chosen = docs.select(*names, F.col(text_col).alias("_weft_text"))

    def run(batches):
        for batch in batches:
            sums, plain, count, known, _ = shipped.value.pool(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _bytes(_finished(sums, _length(plain, count), count, known))], [*names, "x"])

    if head.tail is None:
        return chosen.mapInArrow(trimmed(run), f"{keep}, x binary")

    def open_(batches):
        for batch in batches:
            sums, plain, count, known, missed = shipped.value.pool(batch.column(len(names)))
            owner, word = (np.concatenate(c) for c in zip(*missed)) if missed else (np.zeros(0, np.int64), np.zeros(0, U64))
            order = np.lexsort((word, owner))
            owner, word = owner[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])) if len(word) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(word)))
            lists = pa.ListArray.from_arrays(np.searchsorted(owner[first], np.arange(len(count) + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(times)], ["word", "c"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _whole(sums), pa.array(_length(plain, count)), pa.array(count), pa.array(known), lists], [*names, "s", "plain", "count", "known", "missed"])

    def close(batches):
        # a text's joined words come before the text itself; what a batch leaves open is carried on
        last, held, more = None, np.zeros(DIM, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            get = dict(zip(batch.schema.names, batch.columns))
            row, c = get["_weft_row"].to_numpy(), get["c"].fill_null(0).to_numpy()
            word = get["c"].is_valid().to_numpy(zero_copy_only=False)
            v = np.zeros((len(row), DIM), np.int64)
            v[word] = lengthened(get["v"].filter(pa.array(word))) * c[word, None]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            sums, times = np.add.reduceat(v, first, axis=0), np.add.reduceat(c, first)
            if row[0] == last:
                sums[0] += held
                times[0] += more
            last, held, more = (row[-1], sums[-1], times[-1]) if word[-1] else (None, held, 0)
            texts = np.flatnonzero(~word)
            own, at = batch.take(pa.array(texts)), np.searchsorted(first, texts, "right") - 1
            get = dict(zip(own.schema.names, own.columns))
            x = _finished(sums[at] + _numbers(get["s"]), get["plain"].to_numpy(), get["count"].to_numpy(), times[at] + get["known"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(get[c] for c in names), _bytes(x)], [*names, "x"])

    # the vocabulary is beyond what is broadcast: the rarer words of a document are joined, once per document
    base = durable(chosen.mapInArrow(trimmed(open_), f"{keep}, s binary, plain double, count long, known long, missed array<struct<word: long, c: long>>").withColumn("_weft_row", F.monotonically_increasing_id()))
    pairs = base.select("_weft_row", F.explode("missed").alias("m")).select("_weft_row", F.col("m.c").alias("c"), F.col("m.word").alias("word"))
    if pairs.count() <= HEAD:  # as many as words are broadcast: the rest of the table stays where it is
        pairs = F.broadcast(pairs)
    words = pairs.join(head.tail, "word").select("_weft_row", "c", "v")
    texts = base.withColumns({"c": F.lit(None).cast("long"), "v": F.lit(None).cast("binary")})
    some = F.size("missed") > 0  # texts whose words were all found need not move
    moved = texts.where(some).drop("missed").unionByName(words, allowMissingColumns=True).repartition("_weft_row").sortWithinPartitions("_weft_row", F.col("c").isNull())
    return moved.unionByName(texts.where(~some).drop("missed")).mapInArrow(trimmed(close), f"{keep}, x binary")


class Network:
    """Two layers with a tanh between them, trained by Adam on the log loss, then scaled by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 120, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.weights, self.temperature = None, 1.0
        if len(set(y.tolist())) < 2:
            return
        held = np.arange(len(x)) % 5 == 4
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.center) / self.scale
        a, b = x[~held], y[~held]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for at in range(0, len(a), 128):
                rows = order[at : at + 128]
                h = np.tanh(a[rows] @ w[0] + w[1])
                gap = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - b[rows]) / len(rows)
                back = np.outer(gap, w[2]) * (1 - h * h)
                grads = [a[rows].T @ back + 1e-4 * w[0], back.sum(0), h.T @ gap + 1e-4 * w[2], gap.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        z, truth = self.logits(x[held]), y[held]
        if len(truth):
            loss = lambda s: np.mean(np.logaddexp(0, z / s) - truth * z / s)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = self.logits((x - self.center) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, trained: F.Column, most: int = SAMPLE, head: int = HEAD) -> tuple[Head, Network]:
    """Word vectors over all of ``docs`` and a network on at most ``most`` of the labelled rows that ``trained`` admits, chosen by a hash.

    ``labels`` has doc_id and ``quality``; null labels and ids are left out, repeated ids count
    once with their largest label; each row of ``docs`` under a labelled id is one row of the
    sample, whole texts of any length.  What reaches the driver is the head of the word table
    and the features of the sample.  Empty tables give a model that scores 0.5.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(trained)
    n = marks.count()
    share = int(min(1.0, most / max(n, 1)) * (1 << 30))
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share).select(F.col("doc_id").alias("_id"), "quality")
    # about ``most`` ids, whatever the tables hold; rows that share one are bounded once they are features
    texts = docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    words = Head(word_table(docs), head)
    found = pooled(texts, words, "doc_id long, quality int").withColumn("_draw", F.xxhash64("doc_id", "x")).orderBy("_draw", "doc_id", "x").limit(most)
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), DIM + 4)
    return words, Network(x.astype(float), np.array([r["quality"] for r in rows], float))


def score(docs: DataFrame, model: tuple[Head, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each whole text of any length; null counts as empty.

    Null ids, ties and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    head, network = model

    def run(batches):
        for batch in batches:
            x = np.frombuffer(buffers(batch.column(1))[0].tobytes(), np.float32).reshape(-1, DIM + 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(x.astype(float)), pa.float64())], ["doc_id", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pooled(chosen, head, "doc_id long").mapInArrow(trimmed(run), "doc_id long, score double")
