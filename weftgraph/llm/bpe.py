"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch are put in a trie of their bytes.  The BPE encoding of a
prefix is the encoding of a shorter prefix plus one last token, so each trie node needs
only that token: it is the token ending at the node that is compatible with the last
token of the prefix before it.  A depth-first walk fills the nodes, and words that share
a prefix share its work.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, trimmed
from .token_counts import PIECE

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for pieces of ASCII alone, where the standard engine's classes agree.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Entries beyond which a worker's memory of pieces keeps only those met again, and the longest piece that it keeps: both bound its bytes.
MEMORY, KEPT = 1 << 16, 48
#: Pairs of tokens whose fit is remembered; characters whose distinct words make one trie; ids handed on, and spread out, at once.
PAIRS, GROUP, ROWS, SPREAD = 1 << 17, 1 << 21, 1 << 18, 1 << 16


def pretokens(piece: str) -> list[str]:
    """The words that the pre-tokenizer cuts a piece into; letters alone, after a space or not, are one."""
    if (piece[1:] if piece[0] == " " else piece).isalpha():
        return [piece]
    return (ASCII_PATTERN if piece.isascii() else PATTERN).findall(piece)


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            names[chr(256 + extra)] = b
            extra += 1
    return names


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def _table(entries: list[bytes], form: str = "B") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries' numbers in one run, with their places and sizes."""
    flat = np.frombuffer(b"".join(entries), form)
    sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // flat.itemsize
    return flat, np.cumsum(sizes) - sizes, sizes


def spread(ids: np.ndarray, bounds: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The entries that a table has for a run of ids, one after another, and ``bounds`` of the run as places among them."""
    flat, starts, sizes = table
    blocks, sums, total = [flat[:0]], [np.zeros(1, np.int64)], 0
    for at in range(0, len(ids), SPREAD):
        part = ids[at : at + SPREAD]
        size = sizes[part]
        ends = np.cumsum(size)
        blocks.append(flat[np.repeat(starts[part] - (ends - size), size) + np.arange(ends[-1])])
        sums.append(ends + total)
        total += int(ends[-1])
    return np.concatenate(blocks), np.concatenate(sums)[bounds]


def _strings(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Byte runs as strings; what isn't UTF-8 is replaced."""
    data = raw.tobytes()
    inner = bounds[bounds < len(raw)]
    try:
        data.decode()
        whole = not len(inner) or not ((raw[inner] & 0xC0) == 0x80).any()  # no text begins inside a character
    except UnicodeDecodeError:
        whole = False
    if whole and len(raw) < 1 << 31:
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])], pa.string())


class TrieBPE:
    """Encodes and decodes with a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ids = vocab
        self.bytes = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.sizes = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)]
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, result
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = rank, both
            self.parts.setdefault(both, (left, right))
        self.rank = {i: self.merge[p][0] for i, p in self.parts.items()}
        self.reachable = {t: i for t, i in vocab.items() if len(t) == 1 or i in self.parts}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        # the token of every suffix of a token, -1 where the suffix isn't one
        self.suffixes = {t[k:]: self.reachable.get(t[k:], -1) for t in vocab for k in range(len(t))}
        # keys of two numbers are packed into one: shorter to hash and to hold than a pair
        self.longer = {self.reachable[t[:-1]] << 8 | t[-1]: i for t, i in self.reachable.items() if t[:-1] in self.reachable}
        self.joined: dict[int, bool] = {}
        self.form = "H" if len(self.sizes) <= 1 << 16 else "I"
        self.words: dict[str, bytes] = {}  # ids as packed numbers: a tuple of them takes several times the memory
        self.spelled = _table([self.bytes.get(i, b"") for i in range(len(self.sizes))])
        self.listed = _table([b",%d" % i if i in self.bytes else b"" for i in range(len(self.sizes))])

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is just these two tokens: undo the later merge, step by step."""
        key = left << 32 | right
        if (known := self.joined.get(key)) is not None:
            return known
        if len(self.joined) >= PAIRS:
            self.joined.clear()
        limit, none, ok = 1 << 60, 1 << 60, True
        rank, parts, merge = self.rank, self.parts, self.merge
        while True:
            hit = merge.get((left, right))
            if hit is not None and hit[0] < limit:
                ok = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                limit = a
                left = parts[left][1]
                if left == right and limit == none:
                    break
            else:
                limit = b + 1
                right = parts[right][0]
        self.joined[key] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed encodings of distinct words: sorting them lays the trie out depth first, a stack holds the path."""
        out: dict[str, bytes] = {}
        path = b""
        last: list[int] = []  # last token of each prefix on the path
        suffix_token, joined, longer = self.suffixes.get, self.joined.get, self.longer.get
        compatible = self.compatible
        size, single, form = self.sizes, self.single, self.form
        for text in sorted(words):  # code points are in the order of their bytes
            word = text.encode()
            common = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                common += 1
            del last[common:]
            token = last[-1] if common else 0
            for at in range(common, len(word)):
                if not at:
                    last.append(token := single[word[0]])
                    continue
                # most often the last token grows by a byte or a new one begins; otherwise suffixes are tried from the shortest
                if (found := longer(token << 8 | word[at])) is not None:
                    start = at + 1 - size[found]
                    if start == 0 or (fits if (fits := joined((left := last[start - 1]) << 32 | found)) is not None else compatible(left, found)):
                        last.append(token := found)
                        continue
                found = single[word[at]]
                if fits if (fits := joined(token << 32 | found)) is not None else compatible(token, found):
                    last.append(token := found)
                    continue
                start, end = at - 1, at + 1
                while (found := suffix_token(word[start:end])) is not None:
                    if found >= 0 and (start == 0 or (fits if (fits := joined((left := last[start - 1]) << 32 | found)) is not None else compatible(left, found))):
                        break
                    start -= 1
                last.append(token := found)
            path = word
            tokens, at = [], len(word)
            while at:
                token = last[at - 1]
                tokens.append(token)
                at -= size[token]
            tokens.reverse()
            out[text] = array(form, tokens).tobytes()
        return out

    def learn(self, pieces: list[str], before: dict[str, bytes]) -> None:
        """Encode pieces that weren't met before."""
        cut = list(map(pretokens, pieces))
        words = self.words
        known, new = {}, []
        for word in set(chain.from_iterable(cut)):
            if (got := words.get(word) or before.get(word)) is None:
                new.append(word)
            else:
                known[word] = got
        known |= self.encode_words(new)
        get = known.__getitem__
        words.update((piece, get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))) for piece, ws in zip(pieces, cut))

    def plain(self, text: str) -> list[str]:
        return PIECE.findall(text)

    def pack(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one run, and where each text's begin and end."""
        numbers = _Numbers()  # of pieces, and of special tokens by their ids
        number = numbers.__getitem__
        rows, ends = array("I"), [0]
        for text in texts:
            at = 0
            for m in self.split_special.finditer(text) if self.split_special else ():
                rows.extend(map(number, self.plain(text[at : m.start()])))
                rows.append(number(self.special[m.group()]))
                at = m.end()
            rows.extend(map(number, self.plain(text[at:] if at else text)))
            ends.append(len(rows))
        before, new = self.words, []
        if len(before) > MEMORY:  # what is met again stays, the rest goes
            self.words = {}
        words = self.words
        for piece in numbers:
            if piece not in words and isinstance(piece, str):
                if (got := before.get(piece)) is None:
                    new.append(piece)
                else:
                    words[piece] = got
        self.learn(new, before)
        entries = [words[p] if isinstance(p, str) else array(self.form, [p]).tobytes() for p in numbers]
        for piece in numbers:
            if isinstance(piece, str) and len(piece) > KEPT:
                del words[piece]
        return spread(np.frombuffer(rows, np.uint32), np.array(ends), _table(entries, self.form))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        coded, bounds = self.pack(texts)
        return [coded[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, TrieBPE] = {}


def coder(path: str) -> TrieBPE:
    if path not in _CODERS:
        _CODERS[path] = TrieBPE(path)
    return _CODERS[path]


def forget() -> None:
    """Drop all coders (a function of the module: nested ones get a copy of its variables)."""
    _CODERS.clear()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Encode each whole text, then decode the ids.

    Returns doc_id, n_tokens and, as chosen, ``ids`` and ``decoded`` or their SHA-256
    digests.  Null and empty texts have no ids; null ids and repeated rows stay; texts of any
    length are encoded whole; an empty table gives an empty result; all other columns (lang,
    source and any extra ones, whatever their names) are left out.
    """
    prepare(docs.sparkSession)
    fields = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64())]
    if ids:
        fields += [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())]
    if digests:
        fields += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]

    def sha(part) -> str:
        return hashlib.sha256(part).hexdigest()

    def run(batches):
        bpe = coder(path)
        held, texts, room = [], [], GROUP
        for batch in batches:
            held.append(batch.column(0))
            for text in batch.column(1):
                texts.append(text.as_py() or "")
                room -= len(texts[-1])
            if room <= 0:
                yield from coded(bpe, pa.concat_arrays(held), texts)
                held, texts, room = [], [], GROUP
        if texts:
            yield from coded(bpe, pa.concat_arrays(held), texts)
        # tasks go to the idle workers in turn: each of them would keep a vocabulary and its words
        del bpe
        forget()

    def coded(bpe, keys, texts):
        found, ends = bpe.pack(texts)
        texts.clear()
        at = 0
        while at < len(keys):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + ROWS, "right")) - 1)
            part, bounds = found[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            raw, places = spread(part, bounds, bpe.spelled)
            decoded = _strings(raw, places)
            columns = [keys.slice(at, to - at), pa.array(np.diff(bounds))]
            if ids:
                columns += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(part.astype(np.int32))), decoded]
            if digests:
                listed, marks = spread(part, bounds, bpe.listed)
                view = memoryview(listed)
                columns.append(pa.array([sha(view[a + 1 : b]) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist())], pa.string()))
                columns.append(pa.array([sha(t.as_buffer()) for t in decoded], pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(f[2]) for c, f in zip(columns, fields)], [f[0] for f in fields])
            at = to

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(trimmed(run), ", ".join(f"{n} {t}" for n, t, _ in fields))
