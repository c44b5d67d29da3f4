"""Benchmark passages in documents: SimHash of item-sized windows, multi-index blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SHINGLE_WORDS, mix64, runs, shingles

SIMILARITY = 0.75
#: Fingerprint bits, bits of an index block, and the radius. At similarity 0.75 the expected distance is 22 with
#: a deviation of 4.3; unrelated windows are 64 apart with a deviation of 5.7. Wide blocks prune: of unrelated pairs, 1 in 200
#: has a block of 64 bits with 20 wrong ones at most, whereas 9 in 10 have one of 8 bits with 2.
BITS, BLOCK_BITS, RADIUS = 128, 64, 41
#: Items in one pass over the documents, and the bytes of their texts; more items take more passes.
ITEMS_A_PASS, BYTES_A_PASS = 5_000, 16 << 20

_BLOCKS = BITS // BLOCK_BITS
#: Of ``_BLOCKS`` blocks, a fingerprint within ``RADIUS`` has at most this many wrong bits in one of them.
SLACK = RADIUS // _BLOCKS
#: Window and item pairs whose blocks are compared at a time.
_PAIRS = 1 << 20


def votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle hash and fingerprint bit."""
    halves = np.stack([mix64(hashes + np.uint64(k)) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8).reshape(len(hashes), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Blocks of ``BLOCK_BITS`` bits of the fingerprints with these vote sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


@dataclass
class Index:
    """Items of one length: their shingle counts and the blocks of their fingerprints, one array for each block."""

    words: int
    width: int
    ids: list
    bags: list[dict[int, int]]
    blocks: np.ndarray

    @classmethod
    def of(cls, words: int, ids: list, hashes: list[np.ndarray]) -> Index:
        blocks = np.ascontiguousarray(fingerprints(np.stack([votes(h).sum(axis=0) for h in hashes])).T)
        bags = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for h in hashes]
        return cls(words, min(words, SHINGLE_WORDS), ids, bags, blocks)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints within the radius: those near in some block, compared whole."""
        found = []
        step = max(1, _PAIRS // len(self.ids))
        for a in range(0, len(prints), step):
            part = prints[a : a + step]
            hit = np.zeros((len(part), len(self.ids)), dtype=bool)
            for b in range(_BLOCKS):
                hit |= np.bitwise_count(part[:, b, None] ^ self.blocks[b]) <= SLACK
            w, i = np.nonzero(hit)
            far = np.bitwise_count(part[w] ^ self.blocks[:, i].T).sum(axis=1, dtype=np.int64)
            ok = far <= RADIUS
            found.append((w[ok] + a, i[ok], far[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def similarity(window: dict[int, int], item: dict[int, int]) -> float:
    """Sum of the lesser weights over the sum of the greater ones; a shingle weighs as often as it occurs."""
    both = sum(min(n, item[s]) for s, n in window.items() if s in item)
    return both / (sum(window.values()) + sum(item.values()) - both)


class Matcher:
    """Finds the items of one pass in runs of documents."""

    def __init__(self, items: list[tuple[object, str]]):
        by_words: dict[int, list[tuple[object, np.ndarray]]] = {}
        for item, text in items:
            run = next(runs(pa.array([text], pa.string())))[2]
            n = int(run.counts[0])
            if n:
                by_words.setdefault(n, []).append((item, shingles(run, min(n, SHINGLE_WORDS))[0]))
        self.indexes = [Index.of(n, [i for i, _ in own], [h for _, h in own]) for n, own in sorted(by_words.items())]
        self.widths = sorted({x.width for x in self.indexes})
        self.known = {w: np.unique(np.concatenate([h for n, own in by_words.items() if min(n, SHINGLE_WORDS) == w for _, h in own])) for w in self.widths}
        self.quick = {}
        for w, hashes in self.known.items():
            table = np.zeros(1 << 20, dtype=bool)
            table[hashes & np.uint64((1 << 20) - 1)] = True
            self.quick[w] = table

    def _hits(self, width: int, hashes: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        maybe = np.flatnonzero(self.quick[width][hashes & np.uint64((1 << 20) - 1)])
        known = self.known[width]
        found = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        return maybe[known[found] == hashes[maybe]]

    def find(self, run) -> Iterator[tuple[int, object, float, int, int, int]]:
        """(document, item, similarity, first word, words, distance) of each document's best window for each item."""
        for width in self.widths:
            hashes, have = shingles(run, width)
            edges = np.concatenate(([0], np.cumsum(have)))
            hits = self._hits(width, hashes)
            owners = np.searchsorted(edges, hits, side="right") - 1
            for d in np.unique(owners):
                own = hashes[edges[d] : edges[d + 1]]
                at = hits[owners == d] - edges[d]
                best: dict[object, tuple] = {}
                for index in self.indexes:
                    if index.width == width:
                        self._windows(index, own, at, best)
                for item, (sim, start, n, far) in best.items():
                    yield int(d), item, sim, start, n + width - 1, far

    @staticmethod
    def _windows(index: Index, own: np.ndarray, at: np.ndarray, best: dict) -> None:
        # a window without any shingle of an item has similarity 0: only windows around hits get a fingerprint
        size = min(index.words - index.width + 1, len(own))
        last = len(own) - size
        wanted = np.zeros(last + 2, dtype=np.int64)
        np.add.at(wanted, np.clip(at - size + 1, 0, last + 1), 1)
        np.add.at(wanted, np.minimum(at + 1, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 2 * size) + 1):
            for a in range(0, len(part), 4096):
                s = part[a : a + 4096]
                if not len(s):
                    continue
                sums = np.zeros((int(s[-1] - s[0]) + size + 1, BITS), dtype=np.int32)
                np.cumsum(votes(own[s[0] : s[-1] + size]), axis=0, out=sums[1:])
                prints = fingerprints(sums[s - s[0] + size] - sums[s - s[0]])
                for w, i, far in zip(*index.candidates(prints), strict=True):
                    start = int(s[w])
                    bag = dict(zip(*(x.tolist() for x in np.unique(own[start : start + size], return_counts=True)), strict=True))
                    sim = similarity(bag, index.bags[i])
                    if sim >= SIMILARITY and (index.ids[i] not in best or sim > best[index.ids[i]][0]):
                        best[index.ids[i]] = (sim, start, size, int(far))


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """The items in broadcast lists of bounded size, so that what tasks are sent, or the driver holds, does not grow with the benchmark.

    A list that is broadcast lies in files, not in the driver's memory.
    """
    spread = benchmark.sparkSession.sparkContext.broadcast
    part, size = [], 0
    items = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    for row in items.toLocalIterator():
        if part and (len(part) >= ITEMS_A_PASS or size + len(row[1]) > BYTES_A_PASS):
            yield spread(part)
            part, size = [], 0
        part.append((row[0], row[1]))
        size += len(row[1])
    if part:
        yield spread(part)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, distance): each document's best window for each leaked item.

    Windows are as many words long as the item, or the whole of a shorter document, and slide by one word. Their SimHash,
    over 5-word shingles weighted by how often they occur, is looked up in blocks: within ``RADIUS`` bits,
    some block has few enough wrong bits, so none is missed. Candidates stay if the weighted Jaccard similarity on the
    shingles themselves is 0.75 or more. Words are lower-cased (A-Z). An item of fewer than five words is one shingle of its own length.

    Null, empty and wordless texts and items match nothing; items that are equal are each reported. Repeated rows get rows each.
    Documents are read once for each pass of ``ITEMS_A_PASS`` items and never shuffled.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()
    arrow = benchmark.select(F.col(f"`{item_id}`")).limit(0).toArrow().schema.field(0).type
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {kind}, similarity double, start_word long, n_words long, distance long"
    out = None
    for items in _passes(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            for batch in batches:
                for a, b, words in runs(batch.column(1)):
                    rows = list(matcher.find(words))
                    if rows:
                        d, item, sim, start, n, far = zip(*rows, strict=True)
                        ids = batch.column(0).slice(a, b - a).take(pa.array(d))
                        columns = [ids, pa.array(item, arrow), pa.array(sim), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(far, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "similarity", "start_word", "n_words", "distance"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text ``find_leaks`` finds no item; columns unchanged, nothing shuffled."""
    place = docs.columns.index(text_col)
    for items in _passes(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            for batch in batches:
                for a, b, words in runs(batch.column(place)):
                    clean = np.ones(b - a, dtype=bool)
                    clean[[found[0] for found in matcher.find(words)]] = False
                    yield batch.slice(a, b - a).filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
