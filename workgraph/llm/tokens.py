"""Words of texts inside Python tasks: whole texts, read piece by piece so that memory stays bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20

#: ASCII letters and digits and every byte of a non-ASCII character belong to words; A-Z become lower case, the rest blank.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A-Z become lower case, everything else stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_pieces(text: str | None, table: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text after a byte table, in lists of about ``size`` bytes; ``bytes.split`` cuts at ASCII white space."""
    if not text:
        return
    data = text.encode("utf-8", "surrogatepass").translate(table)
    if len(data) <= size:
        yield data.split()
        return
    at, spaces = 0, b" \t\n\x0b\x0c\r"
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in spaces:
            end += 1
        yield data[at:end].split()
        at = end


#: Odd multipliers of the window hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    x = x ^ (x >> np.uint64(29))
    return x * BASE


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit value for every run of ``width`` ids; equal runs have equal values."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    spread = mixed(ids.astype(np.uint64) + np.uint64(1))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= BASE
        out += spread[k:k + n]
    return mixed(out)


#: White space as one blank, A-Z in lower case, everything else stays: words between white space.
SPACED = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x100000001B3)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE)
        one = np.ones(1, np.uint64)
        back = np.uint64(pow(int(_STEP), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate((one, np.full(size - 1, x, np.uint64)))) for x in (_STEP, back)]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str | None, table: bytes = SPACED) -> np.ndarray:
    """A 64-bit hash per word of the whole text, in order; long texts are read piece by piece."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(table)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            stop = data.find(b" ", end)
            end = len(data) if stop < 0 else stop
        codes = np.frombuffer(data, np.uint8, end - at, at)
        forward, back = _powers(len(codes) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * forward[:len(codes)])))
        edge = np.diff(np.concatenate((np.zeros(1, np.int8), (codes != 32).view(np.int8), np.zeros(1, np.int8))))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out.append(mixed((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)
