"""The codecs of neighbour lists value by value, to test the vectorised ones against."""

import numpy as np

KINDS = ("byte", "run", "nibble")


def _signed(x: int) -> bytes:
    """Sign in 0x40 of the first byte, six bits of magnitude, then groups of seven; 0x80 goes on."""
    size, sign = abs(x), 0x40 if x < 0 else 0
    out = [sign | (size & 0x3F)]
    size >>= 6
    while size:
        out[-1] |= 0x80
        out.append(size & 0x7F)
        size >>= 7
    return bytes(out)


def _read_signed(data: bytes, at: int) -> tuple[int, int]:
    b = data[at]
    value, shift, negative = b & 0x3F, 6, b & 0x40
    while b & 0x80:
        at += 1
        b = data[at]
        value |= (b & 0x7F) << shift
        shift += 7
    return (-value if negative else value), at + 1


def _varint(x: int) -> bytes:
    out = []
    while True:
        b = x & 0x7F
        x >>= 7
        out.append(b | (0x80 if x else 0))
        if not x:
            return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            return value, at


def encode(owner: int, members: list[int], kind: str = "byte", weights: list[int] | None = None) -> bytes:
    """The code of one list; weights follow their members in the signed form (byte and nibble)."""
    if kind not in KINDS:
        raise ValueError(f"unknown codec {kind!r}")
    if not members:
        return b""
    gaps = np.diff(members).tolist()
    if kind == "byte":
        out = _signed(members[0] - owner) + (_signed(weights[0]) if weights else b"")
        for k, gap in enumerate(gaps):
            out += _varint(gap) + (_signed(weights[k + 1]) if weights else b"")
        return out
    if kind == "run":
        out, at = _signed(members[0] - owner), 0
        width = lambda g: max(1, (g.bit_length() + 7) // 8)
        while at < len(gaps):
            w, end = width(gaps[at]), at + 1
            while end < len(gaps) and end - at < 64 and width(gaps[end]) == w:
                end += 1
            out += bytes([(w - 1) | ((end - at - 1) << 2)]) + b"".join(g.to_bytes(w, "little") for g in gaps[at:end])
            at = end
        return out + (b"".join(map(_signed, weights)) if weights else b"")
    nibbles: list[int] = []

    def put(x: int) -> None:
        while True:
            low = x & 7
            x >>= 3
            nibbles.append(low | (8 if x else 0))
            if not x:
                return

    def put_signed(x: int) -> None:
        put((abs(x) << 1) | (x >= 0))

    put_signed(members[0] - owner)
    if weights:
        put_signed(weights[0])
    for k, gap in enumerate(gaps):
        put(gap)
        if weights:
            put_signed(weights[k + 1])
    if len(nibbles) % 2:
        nibbles.append(0)
    return bytes((a << 4) | b for a, b in zip(nibbles[::2], nibbles[1::2]))


def decode(owner: int, data: bytes, degree: int, kind: str = "byte", weighted: bool = False) -> tuple[list[int], list[int]]:
    """(members, weights) of one list of known degree."""
    if kind not in KINDS:
        raise ValueError(f"unknown codec {kind!r}")
    members, weights = [], []
    if not degree:
        return members, weights
    if kind == "nibble":
        flat = [n for b in data for n in (b >> 4, b & 15)]
        at = 0

        def take() -> int:
            nonlocal at
            value = shift = 0
            while True:
                n = flat[at]
                at += 1
                value |= (n & 7) << shift
                shift += 3
                if not n & 8:
                    return value

        def take_signed() -> int:
            x = take()
            return x >> 1 if x & 1 else -(x >> 1)

        members.append(owner + take_signed())
        if weighted:
            weights.append(take_signed())
        while len(members) < degree:
            members.append(members[-1] + take())
            if weighted:
                weights.append(take_signed())
        return members, weights
    first, at = _read_signed(data, 0)
    members.append(owner + first)
    if kind == "byte":
        if weighted:
            w, at = _read_signed(data, at)
            weights.append(w)
        while len(members) < degree:
            gap, at = _read_varint(data, at)
            members.append(members[-1] + gap)
            if weighted:
                w, at = _read_signed(data, at)
                weights.append(w)
        return members, weights
    while len(members) < degree:
        width, run = (data[at] & 3) + 1, (data[at] >> 2) + 1
        at += 1
        for _ in range(run):
            members.append(members[-1] + int.from_bytes(data[at : at + width], "little"))
            at += width
    if weighted:
        for _ in range(degree):
            w, at = _read_signed(data, at)
            weights.append(w)
    return members, weights
