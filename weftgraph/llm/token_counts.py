"""Token counts: batch encoding in an Arrow function that returns lengths only.

Texts are cut at boundaries that the pre-tokenizer always keeps (before white space
that follows other text), so a text of any length becomes short pieces.  Each distinct
piece is encoded once, in batches balanced by bytes, and a text's count is the sum over
its pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, trimmed

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A cut before white space after other text, and inside white space where byte-level pre-tokenizers cut it.
PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Entries that a worker's memory of pieces may hold before it starts anew, and the longest piece that it keeps: both bound its bytes.
MEMORY, KEPT = 1_000_000, 48
#: Bytes of a batch given to the library.
BATCH_BYTES = 1 << 18


def balanced(pieces: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about ``most`` bytes each, longest pieces first so that lengths in a batch are alike."""
    batch, room = [], most
    for piece in sorted(pieces, key=len, reverse=True):
        batch.append(piece)
        room -= 4 * len(piece) + 16
        if room <= 0:
            yield batch
            batch, room = [], most
    if batch:
        yield batch


class Counter:
    """Counts the tokens of whole texts as the library does, special strings inside texts included."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lengths: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # this kind's units may cross white space, so each whole text is one piece
            self.cut = lambda text: [text] if text else []
            self.encode = lambda batch: map(len, model.encode(batch, num_threads=1))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            specials = [t.content for t in model.get_added_tokens_decoder().values()]
            byte_level = "ByteLevel" in str(model.pre_tokenizer) and model.normalizer is None
            if byte_level and all(not re.search(f"[{_WS}]", s) for s in specials):
                self.cut = PIECE.findall
            else:
                self.cut = lambda text: [text] if text else []
            self.encode = lambda batch: map(len, model.encode_batch_fast(batch, add_special_tokens=False))

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.lengths) > MEMORY:
            self.lengths.clear()
        cut = [self.cut(text) for text in texts]
        new = set(chain.from_iterable(cut)).difference(self.lengths)
        long = {}
        for batch in balanced(list(new)):
            self.lengths.update(zip(batch, self.encode(batch)))
            if len(batch[0]) > KEPT:  # longest first
                long.update((piece, self.lengths.pop(piece)) for piece in batch if len(piece) > KEPT)
        get = self.lengths.__getitem__
        if not long:
            return [sum(map(get, pieces)) for pieces in cut]
        return [sum(long[p] if len(p) > KEPT else get(p) for p in pieces) for pieces in cut]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker and file, kept between batches and tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row.

    Null and empty texts count 0 bytes and 0 tokens; null ids and repeated rows are kept
    as they are, an empty table gives an empty result, other columns are ignored.  A text of
    any length is counted whole; only a run without any white space is one piece.
    """
    prepare(docs.sparkSession)

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, at, room = [], 0, 1 << 22
            for k, text in enumerate(texts):  # sub-batches of a few MB of text
                room -= len(text)
                if room < 0 or k == len(texts) - 1:
                    n += count(texts[at : k + 1])
                    at, room = k + 1, 1 << 22
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return chosen.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long")
