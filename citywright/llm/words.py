"""Words and word shingles of whole Arrow string columns, as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. White space is ASCII, so words can be cut
on UTF-8 bytes. Everything works on a run of documents at once; a null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer single text is handled alone and whole.
RUN_BYTES = 1 << 20
SHINGLE_WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


@dataclass
class Run:
    """Words of some successive documents: byte spans, 64-bit hashes, and how many words each document has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def firsts(self) -> np.ndarray:
        """Index of each document's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * RUN_BYTES)
        for name, base in (("_POWERS", _BASE), ("_INVERSES", _BASE_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _POWERS, _INVERSES


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls become empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def cut(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Run:
    """Words of the documents that ``offsets`` cuts out of ``data`` (already lower-cased or not, as wanted)."""
    n, docs = len(data), len(offsets) - 1
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Run(data, none, none, np.zeros(docs, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    space = _SPACE[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    edges = np.searchsorted(starts, offsets)
    run = Run(data, starts, ends, np.diff(edges))
    if hashed:
        powers, inverses = _tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        run.hashes = mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return run


def runs(column: pa.Array, lower: bool = True, hashed: bool = True, size: int = RUN_BYTES) -> Iterator[tuple[int, int, Run]]:
    """(first row, last row + 1, words) for successive rows whose texts take about ``size`` bytes together."""
    offsets, data = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        part = data[offsets[at] : offsets[to]]
        yield at, to, cut(_LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at], hashed)
        at = to


def shingles(run: Run, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each position, and how many positions each document has.

    A document of fewer words than ``width`` has one shingle, the whole sequence; one without words has none.
    """
    w, counts, firsts = run.hashes, run.counts, run.firsts[:-1]
    have = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    place = _PLACE if width == len(_PLACE) else mix64(np.arange(1, width + 1, dtype=np.uint64))
    n = int(have.sum())
    if n == 0:
        return np.zeros(0, dtype=np.uint64), have
    slots = np.cumsum(have) - have
    at = np.arange(n) - np.repeat(slots, have) + np.repeat(firsts, have)
    long = np.repeat(counts >= width, have)
    out = np.zeros(n, dtype=np.uint64)
    full = at[long]
    total = np.zeros(len(full), dtype=np.uint64)
    for k in range(width):
        total += w[full + k] * place[k]
    out[long] = total
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        words = w[firsts[d] : firsts[d] + counts[d]]
        out[slots[d]] = (words * place[: len(words)]).sum(dtype=np.uint64) + np.uint64(counts[d])
    return mix64(out), have


def shingle_sets(run: Run) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, sorted."""
    hashes, have = shingles(run)
    edges = np.concatenate(([0], np.cumsum(have)))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s = np.sort(hashes[a:b])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if b > a else s)
    return out
