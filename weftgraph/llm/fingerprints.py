"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its five-word shingles, weighted by their counts.  For each
sample k and term, two gamma-distributed numbers and a uniform one are derived from the
term's hash; the sampled (term, level) pair with the smallest arrival value is the
document's k-th sample.  Two documents agree in a sample with the probability of their
generalised Jaccard similarity, sum of minima over sum of maxima.

The gamma draws come from fixed tables picked by hash bits, so equal terms draw equally
everywhere and no logarithm is needed for terms of weight one.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, prepare, trimmed
from .textkernel import CHUNK, U64, buffers, hash_ranges, mix, shingles, words

SAMPLES = 48
_BITS = 18
_rng = np.random.default_rng(4091)
_R = _rng.gamma(2.0, 1.0, 1 << _BITS)
_LOGC = np.log(_rng.gamma(2.0, 1.0, 1 << _BITS))
_BETA = _rng.random(1 << _BITS)
#: log of the arrival value for weight one: level 0, so log c + r * beta - r
_ONE = (_LOGC + _R * _BETA - _R).astype(np.float32)
_SALT = _rng.integers(1, 1 << 62, 256, dtype=np.uint64) * U64(2) + U64(1)
_SHIFT = U64(64 - _BITS)


def weighted_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text: (terms, counts, bounds of each text); a text without words is one term of its own."""
    import pyarrow.compute as pc

    raw, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    terms, bounds = shingles(*words(raw, offsets))
    bare = np.flatnonzero((np.diff(bounds) == 0) & (np.diff(offsets) > 0))
    if len(bare):
        terms = np.insert(terms, bounds[bare], hash_ranges(raw, offsets[bare], offsets[bare + 1]))
        bounds = bounds + np.searchsorted(bare, np.arange(len(bounds)))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    fresh = np.ones(len(terms), bool)
    fresh[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    counts = np.diff(np.append(at, len(terms)))
    return terms[at], counts, np.searchsorted(owner[at], np.arange(len(bounds)))


def signatures(terms: np.ndarray, counts: np.ndarray, bounds: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) 16-bit codes of the sampled pairs; texts without terms get all zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, samples), np.uint16)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(some):
        return out
    starts = bounds[some]
    many = np.flatnonzero(counts > 1)
    log_w = np.log(counts[many].astype(float))
    sizes = np.diff(np.append(starts, len(terms)))
    for k in range(samples):
        h = (terms ^ _SALT[k]) * _SALT[k + 128]
        h ^= h >> U64(32)
        h *= U64(0x9FB21C651E98DF25)
        spot = (h >> _SHIFT).astype(np.int64)
        value = _ONE[spot]
        level = None
        if len(many):
            s = spot[many]
            r, beta = _R[s], _BETA[s]
            step = np.floor(log_w / r + beta)
            value[many] = _LOGC[s] - r * (step - beta) - r
            level = np.zeros(len(terms), np.int64)
            level[many] = step.astype(np.int64)
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        # equal values fall to the smallest hash: the same rule in every text
        group = np.searchsorted(starts, hit, "right") - 1
        first = np.lexsort((h[hit], group))
        hit, group = hit[first], group[first]
        hit = hit[np.concatenate([[True], group[1:] != group[:-1]])]
        code = terms[hit] + U64(k)
        if level is not None:
            code = code ^ (level[hit].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        out[some, k] = (mix(code) >> U64(48)).astype(np.uint16) | np.uint16(1)
    return out


def sign(texts: list[str]) -> np.ndarray:
    """Signatures of whole texts, a few MB of text at a time."""
    parts, at = [], 0
    while at < len(texts):
        end, room = at, CHUNK
        while end < len(texts) and room > 0:
            room -= len(texts[end])
            end += 1
        parts.append(signatures(*weighted_terms(pa.array(texts[at:end], pa.string()))))
        at = end
    return np.concatenate(parts) if parts else np.zeros((0, SAMPLES), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: the estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def edit(text: str, following: str) -> str:
    """The text whose last half (rounded down) is replaced by as many first code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each whole text of any length.

    Null counts as empty, empty texts share one fingerprint, a text without words is a set of
    one term; null ids, ties and repeated rows stay; other columns are ignored; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = sign([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype(">u2").tobytes().hex() for s in got], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, fingerprint string")


def with_successor(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, task, part, place, tie, extra) such that, sorted by (part, extra, place, tie), each row's successor follows it.

    The ids are cut into ranges; each range also gets the first rows of the next one
    (``extra``).  Only ids are scanned to find the cuts, and the texts move once.  An id that
    holds several ranges' worth of rows (null ids, say) is cut further by the hash of the text.
    ``task`` numbers the ranges so that Spark's hash spreads them evenly.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), place.alias("place"), F.xxhash64(text).alias("tie"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(place.alias("place")).agg(F.percentile_approx("place", [k / n for k in range(1, n)], 10000)).first()[0] if n > 1 else []
    cuts: list[tuple[int, int]] = []
    for value, times in sorted(Counter(found or []).items()):
        cuts.append((value, -(1 << 63)))
        cuts += [(value, -(1 << 63) + (1 << 64) * k // times) for k in range(1, times)]
    values, ties = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))

    def parts_of(place: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(values, place), np.searchsorted(values, place, "right")
        out = high.copy()
        several = high - low > 1
        for k in np.unique(low[several]):  # ids that are cut further
            rows = several & (low == k)
            out[rows] = k + np.searchsorted(ties[k : high[rows][0]], tie[rows], "right")
        return out

    @F.pandas_udf("int")
    def part_of(place, tie):
        import pandas as pd

        return pd.Series(parts_of(place.to_numpy(), tie.to_numpy()).astype("int32"))

    # the first key of each range: as many as ranges
    firsts = {r[0]: (r[1], r[2]) for r in rows.select(part_of("place", "tie").alias("part"), F.struct("place", "tie").alias("key")).groupBy("part").agg(F.min("key").alias("key")).select("part", "key.place", "key.tie").collect()}
    order = sorted(firsts)
    before = {firsts[p]: order[k - 1] for k, p in enumerate(order)}  # the range before, around the end
    # a number for each range such that hashing spreads the ranges evenly over the tasks
    hashed = spark.range(24 * n).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("b")).collect()
    label: dict[int, int] = {}
    for r in hashed:
        label.setdefault(r["b"], r["v"])
    labels = [label.get(p % n, p) for p in range(len(cuts) + 1)]

    @F.pandas_udf("int")
    def into(place, tie):
        import pandas as pd

        return pd.Series([before.get(k, -1) for k in zip(place.tolist(), tie.tolist())], dtype="int32")

    rows = rows.withColumn("part", part_of("place", "tie"))
    copies = F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(into("place", "tie").alias("part"), F.lit(True).alias("extra")))
    spread = rows.withColumn("_to", F.explode(F.filter(copies, lambda c: c["part"] >= 0)))
    task = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("_to.part") + 1)
    return spread.select("doc_id", "text", task.alias("task"), F.col("_to.part").alias("part"), "place", "tie", F.col("_to.extra").alias("extra"))


def edit_study(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit with the next document, and their likeness.

    The next document is the following one in ascending doc_id (equal ids by a hash of the
    text, null ids last); after the last comes the first.  Null texts are empty.  A single document is
    its own successor.  Repeated rows are documents of their own; an empty table gives an
    empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = with_successor(docs, id_col, text_col)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def flush(ids: list, texts: list[str], own: np.ndarray):
        """Rows for all but the last of the texts."""
        edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
        changed = sign(edited)
        hexes = lambda m: [s.astype(">u2").tobytes().hex() for s in m]
        columns = [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(hexes(own[:-1]), pa.string()),
            pa.array(hexes(changed), pa.string()),
            pa.array(likeness(own[:-1], changed), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        held: tuple | None = None  # the last row: its successor is in the next batch
        done: int | None = None  # a range that met its extra row needs no more
        for batch in batches:
            ids, texts, parts, extras = (batch.column(k).to_pylist() for k in range(4))
            k = 0
            while k < len(ids):
                part = parts[k]
                end = bisect.bisect_right(parts, part, k)
                stop = next((j for j in range(k, end) if extras[j]), end - 1)  # the first extra row closes the range
                if done != part:
                    some_ids, some, last_sign = ids[k : stop + 1], texts[k : stop + 1], sign(texts[k : stop + 1])
                    if held is not None and held[0] == part:
                        some_ids, some, last_sign = [held[1], *some_ids], [held[2], *some], np.concatenate([held[3], last_sign])
                    if len(some) > 1:
                        yield flush(some_ids, some, last_sign)
                    held = part, some_ids[-1], some[-1], last_sign[-1:]
                    if extras[stop]:
                        done, held = part, None
                k = end

    return rows.repartition(F.col("task")).sortWithinPartitions("part", "extra", "place", "tie").select("doc_id", "text", "part", "extra").mapInArrow(trimmed(run), schema)
