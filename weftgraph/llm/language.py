"""Language identification by hierarchical discrimination.

A first linear classifier predicts the language family.  Within the family, one linear
support vector machine per pair of languages separates the close ones by vote.  Features
are hashed byte 1- to 4-grams of the lower-cased whole text.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, trimmed
from .textkernel import STEP, buffers

FEATURES = 1 << 13
#: Bound on the labelled texts a model is fitted on.
SAMPLE = 6000
UNKNOWN = "und"

_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
}
FAMILY = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """The family of a code; a code that isn't listed is a family of its own."""
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(column: pa.Array) -> np.ndarray:
    """Unit-length rows of square-rooted n-gram counts; texts of any length are taken a piece of bytes at a time."""
    raw, offsets = buffers(pc.utf8_lower(column.cast(pa.large_string())))
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for at in range(0, len(raw), STEP):
        stop = min(at + STEP, len(raw))
        piece = raw[at : stop + 3]  # grams may end in the next piece
        first, last = np.searchsorted(offsets, [at, stop - 1], "right") - 1
        ends = np.minimum(offsets[first + 1 : last + 2], stop)
        sizes = np.diff(np.concatenate([[at], ends]))
        left = np.repeat(offsets[first + 1 : last + 2], sizes) - np.arange(at, stop)  # bytes to the text's end
        owner = np.repeat(np.arange(last - first + 1), sizes) * FEATURES
        gram = np.zeros(len(piece), np.uint32)
        counts = np.zeros((last - first + 1) * FEATURES, np.float32)
        for size in range(1, 5):
            gram[: len(piece) - size + 1] = (gram[: len(piece) - size + 1] * np.uint32(0x01000193)) ^ piece[size - 1 :]
            ok = np.flatnonzero(left >= size)
            bucket = ((gram[ok] * np.uint32(0x9E3779B1)) >> np.uint32(33 - FEATURES.bit_length())).astype(np.int64)
            counts += np.bincount(owner[ok] + bucket, minlength=len(counts)).astype(np.float32)
        out[first : last + 1] += counts.reshape(-1, FEATURES)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.maximum(norm, 1e-9)
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script; null holds none."""
    ascii_letter = pc.match_substring_regex(column, "[A-Za-z]").fill_null(False).to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(~ascii_letter):
        ascii_letter[k] = any(c.isalpha() for c in (column[int(k)].as_py() or ""))
    return ascii_letter


def fit_svm(x: np.ndarray, sign: np.ndarray, epochs: int = 12, penalty: float = 1e-4, seed: int = 5) -> np.ndarray:
    """Weights (bias last) of a linear SVM by averaged mini-batch subgradient steps on the hinge loss; rows of sign 0 take no part."""
    rng = np.random.default_rng(seed)
    w, total, steps = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    used = np.flatnonzero(sign)
    up = max(np.mean(sign[used] > 0), 1e-9)
    balance = np.where(sign > 0, 0.5 / up, 0.5 / max(1 - up, 1e-9))
    for epoch in range(epochs):
        order = rng.permutation(used)
        for at in range(0, len(used), 64):
            rows = order[at : at + 64]
            part = x[rows].astype(float)
            margin = sign[rows] * (part @ w[:-1] + w[-1])
            pull = np.where(margin < 1, sign[rows] * balance[rows], 0.0)
            rate = 4.0 / (1 + 0.02 * steps)
            w[:-1] *= 1 - rate * penalty
            w[:-1] += rate * (pull @ part) / len(rows)
            w[-1] += rate * pull.mean()
            steps += 1
            if epoch:
                total += w
    return (total / max(1, steps - steps // epochs) if epochs > 1 else w).astype(np.float32)


class Model:
    """families, one-versus-rest weights for them, and pairwise weights within each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs = np.array(langs, object)
        kin = np.array([family_of(v) for v in langs], object)
        self.families = sorted(set(kin))
        self.members = {f: sorted(set(langs[kin == f])) for f in self.families}
        one = len(self.families) == 1
        self.top = np.stack([np.zeros(FEATURES + 1, np.float32) if one else fit_svm(x, np.where(kin == f, 1.0, -1.0)) for f in self.families]) if self.families else None
        self.pairs = {}
        for f, members in self.members.items():
            for a, b in combinations(members, 2):
                self.pairs[f, a, b] = fit_svm(x, np.where(langs == a, 1.0, np.where(langs == b, -1.0, 0.0)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, margin): the score is the family's share of confidence times the pairwise mean, the margin its machine's side: negative if every family turns the text away."""
        n = len(x)
        if not self.families:
            return np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, -1.0)
        squash = lambda z: 1 / (1 + np.exp(-np.clip(2 * z, -30, 30)))
        margins = x @ self.top[:, :-1].T + self.top[:, -1]
        top = squash(margins)
        best, share = top.argmax(1), top.max(1) / top.sum(1)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for k, f in enumerate(self.families):
            rows, members = np.flatnonzero(best == k), self.members[f]
            if not len(rows):
                continue
            votes, trust = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (of, a, b), w in self.pairs.items():
                if of == f:
                    p = squash(x[rows] @ w[:-1] + w[-1])
                    i, j = members.index(a), members.index(b)
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    trust[:, i] += p
                    trust[:, j] += 1 - p
            rounds = max(1, len(members) - 1)
            win = (votes + trust / (rounds + 1)).argmax(1)
            lang[rows] = np.array(members, object)[win]
            sure = trust[np.arange(len(rows)), win] / rounds if len(members) > 1 else 1.0
            score[rows] = np.clip(share[rows] * sure, 0, 1)
        return lang, score, margins.max(1)


def sample_languages(docs: DataFrame, keep: F.Column, most: int, seed: int = 11) -> DataFrame:
    """At most ``most`` of the rows that pass ``keep`` (one a language at least), the same in a rerun.

    Languages of few rows give all of them and the others the same number each, so that no
    language is missing.  Only a count per language reaches the driver.
    """
    rows = docs.where(keep).withColumn("_draw", F.xxhash64("doc_id", "text", F.lit(seed)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, level = most, 0
    for k, n in enumerate(sorted(counts.values())):
        level = max(1, left // (len(counts) - k))
        left -= min(n, level)
    # twice the rows that are wanted, and some more, come to the ranking
    shares = [(lang, int(min(1.0, (2 * level + 64) / n) * (1 << 30))) for lang, n in counts.items()]
    drawn = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, _share long")), "lang").where(F.pmod("_draw", F.lit(1 << 30)) < F.col("_share"))
    order = Window.partitionBy("lang").orderBy("_draw", "doc_id", "text")
    return drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= level).drop("_draw", "_share", "_rank")


def fit(docs: DataFrame, trained: F.Column, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of at most ``most`` rows, drawn per language, of the rows that ``trained`` admits.

    Texts without words and null languages are left out; texts of any length train whole.
    Their features are formed where the texts are: what reaches the driver is at most
    ``most`` rows of 16 KB, compressed.  An empty table gives a model without a language.
    """
    prepare(docs.sparkSession)
    keep = trained & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\S")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [zlib.compress(r.tobytes(), 1) for r in features(part.column(1)).astype(np.float16)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(x, pa.binary())], ["doc_id", "lang", "x"])

    rows = docs.where(keep).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    drawn = sample_languages(rows, F.lit(True), most).select("doc_id", "text", "lang").mapInArrow(trimmed(run), "doc_id long, lang string, x binary").collect()
    drawn.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"])))
    x = np.zeros((len(drawn), FEATURES), np.float16)  # widened batch by batch
    langs = [r["lang"] for r in drawn]
    for k in range(len(drawn)):
        x[k] = np.frombuffer(zlib.decompress(bytes(drawn[k]["x"])), np.float16)
        drawn[k] = None
    return Model(x, langs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each whole text; ``und`` with score 0 for null texts and texts without a letter.

    Null ids, ties and repeated rows stay; texts of any length are read whole; other columns
    are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of weights

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            lang, score = [], []
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256)
                names, values, _ = shipped.value.predict(features(part.fill_null("")))
                none = ~has_letter(part)
                names[none], values[none] = UNKNOWN, 0.0
                lang += list(names)
                score += list(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")


def known_languages(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language the model tells; a null ``lang_col`` becomes the prediction.

    A row goes if its text is null or has no letter, or if the model turns it away: every
    family's machine puts it on the other side of its margin.  All columns stay, whatever their
    names; null ids, ties and repeated rows stay; an empty table, or a model without a
    language, gives an empty result.
    """
    prepare(docs.sparkSession)
    if not model.families:
        return docs.where(F.lit(False))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        text, lang = names.index(text_col), names.index(lang_col)
        for batch in batches:
            keep, found = np.zeros(batch.num_rows, bool), []
            for k in range(0, batch.num_rows, 256):
                part = batch.column(text).slice(k, 256)
                told, _, margin = shipped.value.predict(features(part.fill_null("")))
                keep[k : k + 256] = (margin >= 0) & has_letter(part)
                found += list(told)
            columns = list(batch.columns)
            columns[lang] = pc.coalesce(columns[lang], pa.array(found, columns[lang].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
