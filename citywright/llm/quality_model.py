"""Quality classifier: histogram gradient-boosted trees over statistics of documents, flattened into arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Run, mix64, runs

#: The trees are fitted on this many labelled documents of each class at most, the first by a hash of their id.
ROWS_A_CLASS = 5000
#: Boosting rounds, splits on the way to a leaf, bins of a statistic, step, ridge on leaves, least Hessian of a child.
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 150, 4, 64, 0.1, 1.0, 1.0
THRESHOLD = 0.3

#: Classes of bytes: each byte belongs to one.
_BYTES = ["upper", "lower", "digit", "space", "newline", "full_stop", "shout", "comma", "symbol", "quote", "bracket", "other", "lead", "follow", "control"]
_CLASS = np.full(256, _BYTES.index("other"), dtype=np.int64)
for _name, _chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": [32, 9], "newline": [10, 13], "full_stop": b".", "shout": b"!?", "comma": b",;:", "symbol": b"#*$%&|<>~^=+@\\/_", "quote": b"\"'`", "bracket": b"()[]{}", "lead": range(0xC0, 256), "follow": range(0x80, 0xC0), "control": [*range(9), 11, 12, *range(14, 32), 127]}.items():
    _CLASS[list(_chars)] = _BYTES.index(_name)

STATISTICS = [
    "log_words",
    "log_bytes",
    *[f"{name}_share" for name in _BYTES],
    "byte_entropy",
    "word_bytes",
    "word_bytes_spread",
    "longest_word",
    "short_words",
    "long_words",
    "same_as_before",
    "distinct_words",
    "top_word",
    "distinct_pairs",
    "top_pair",
    "stopped_words",
    "marked_words",
    "capital_words",
    "shouted_words",
    "lines",
    "words_a_line",
    "ended_lines",
    "repeated_lines",
]


def _distinct(keys: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, count of the most frequent one) of each document."""
    if not len(keys):
        return np.zeros(docs), np.zeros(docs)
    _, first, counts = np.unique(mix64(keys ^ mix64(owner.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    whose, top = owner[first], np.zeros(docs)
    np.maximum.at(top, whose, counts)
    return np.bincount(whose, minlength=docs).astype(float), top


def statistics(run: Run, sizes: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each document of the run, from its whole text; ``sizes`` are bytes a document. Shares of nothing are 0."""
    docs, n = len(run.counts), run.counts.astype(float)
    word_doc, byte_doc = np.repeat(np.arange(docs), run.counts), np.repeat(np.arange(docs), sizes)

    def summed(flags: np.ndarray) -> np.ndarray:
        return np.bincount(word_doc, flags, docs)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(docs), where=whole > 0)

    by_byte = np.bincount(byte_doc * 256 + run.data, minlength=docs * 256).reshape(docs, 256).astype(float)
    rates = by_byte / np.maximum(sizes, 1)[:, None]
    entropy = -np.sum(rates * np.log2(np.where(rates > 0, rates, 1)), axis=1)
    kinds = by_byte @ np.eye(len(_BYTES))[_CLASS]
    length = (run.ends - run.starts).astype(float)
    mean = share(summed(length), n)
    longest = np.zeros(docs)
    np.maximum.at(longest, word_doc, length)
    h = run.hashes if len(run.starts) else np.zeros(0, np.uint64)
    inner = np.ones(len(h), dtype=bool)
    inner[run.firsts[:-1][run.counts > 0]] = False
    pairs = h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    inside = inner[1:]
    repeated = np.zeros(len(h), dtype=bool)
    repeated[1:] = inside & (h[1:] == h[:-1])
    first, last = (run.data[x] if len(h) else np.zeros(0, np.uint8) for x in (run.starts, run.ends - 1))
    capital = _CLASS[first] == _BYTES.index("upper")
    # capitals among a word's letters, from running counts of its bytes
    running = [np.concatenate(([0], np.cumsum(_CLASS[run.data] == _BYTES.index(k)))) for k in ("upper", "lower")]
    upper, lower = (r[run.ends] - r[run.starts] for r in running)
    marks = np.isin(last, np.frombuffer(b"#*$%&|<>~^=+@\\/_!?", dtype=np.uint8))
    # lines with words: a word begins one if a newline stands between it and the word before
    newlines = np.concatenate(([0], np.cumsum(run.data == 10)))
    begins = ~inner
    if len(h):
        begins[1:] |= newlines[run.starts[1:]] > newlines[run.ends[:-1]]
    line = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    line_doc = word_doc[starts]
    lines = np.bincount(line_doc, minlength=docs).astype(float)
    place = (np.arange(len(h)) - (starts[line] if len(h) else 0)).astype(np.uint64)
    line_hash = np.add.reduceat(mix64(h + mix64(place + np.uint64(1))), starts) if len(h) else h
    stops = np.append(starts[1:], len(h)) - 1
    ended = np.isin(last[stops], np.frombuffer(b".!?:;\"')", dtype=np.uint8)) if len(h) else np.zeros(0, bool)
    distinct, top = _distinct(h, word_doc, docs)
    distinct_pairs, top_pair = _distinct(pairs[inside], word_doc[1:][inside], docs)
    distinct_lines, _ = _distinct(line_hash, line_doc, docs)
    n_pairs = np.maximum(n - 1, 0)
    columns = [
        np.log1p(n),
        np.log1p(sizes),
        *[share(kinds[:, k], sizes.astype(float)) for k in range(len(_BYTES))],
        entropy,
        mean,
        np.sqrt(np.maximum(share(summed(length**2), n) - mean**2, 0)),
        np.log1p(longest),
        share(summed(length <= 2), n),
        share(summed(length >= 14), n),
        share(summed(repeated), n_pairs),
        share(distinct, n),
        share(top, n),
        share(distinct_pairs, n_pairs),
        share(top_pair, n_pairs),
        share(summed(last == ord(".")), n),
        share(summed(marks), n),
        share(summed(capital), n),
        share(summed((upper >= 2) & (lower == 0)), n),
        np.log1p(lines),
        share(n, lines),
        share(np.bincount(line_doc, ended, docs), lines),
        share(lines - distinct_lines, lines),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """All trees in flat arrays: the children of node k are 2k + 1 and 2k + 2, and leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) for each row of statistics: all rows go down all trees together, a level at a time."""
        trees, inner = self.feature.shape
        which, rows = np.arange(trees), np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[which, node]] > self.threshold[which, node])
        total = self.base + self.value[which, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray) -> list[np.ndarray]:
    """Upper ends of each statistic's bins: midway between values at equal steps of rank."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def best_splits(bins: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, statistic, last bin that goes left) of each node's best split, from histograms of gradients and Hessians."""
    n, width = bins.shape
    at = ((node[:, None] * width + np.arange(width)) * BINS + bins).ravel()
    g, h = (np.cumsum(np.bincount(at, np.repeat(w, width), nodes * width * BINS).reshape(nodes, width, BINS), axis=2) for w in (gradient, hessian))
    all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
    gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(h < LEAST) | (all_h - h < LEAST)] = -np.inf
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(nodes), best], best // BINS, best % BINS


def train(x: np.ndarray, labels: np.ndarray, rate: float) -> Trees:
    """Boost trees on the logistic loss; ``rate`` is the share of label 1 among all labelled rows, which rows are weighted to."""
    inner = 2**DEPTH - 1
    base = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    if len(set(labels.tolist())) < 2:
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), base)
    y = labels.astype(float)
    weight = np.where(y == 1, rate / (y == 1).sum(), (1 - rate) / (y == 0).sum()) * len(y)
    edges = _edges(x)
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    limits = np.full((x.shape[1], BINS), np.inf)
    for k, e in enumerate(edges):
        limits[k, : len(e)] = e
    total = np.full(len(y), base)
    trees = [np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))]
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            gain, statistic, last = best_splits(bins, node, nodes, gradient, hessian)
            split = gain > 1e-9
            # a node without a split sends all rows to the left
            trees[0][t, first : first + nodes] = np.where(split, statistic, 0)
            trees[1][t, first : first + nodes] = np.where(split, limits[statistic, last], np.inf)
            right = split[node] & (bins[np.arange(len(y)), statistic[node]] > last[node])
            node = 2 * node + right
        g, h = (np.bincount(node, w, inner + 1) for w in (gradient, hessian))
        trees[2][t] = -RATE * g / (h + RIDGE)
        total += trees[2][t][node]
    return Trees(*trees, base)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, values): the ``STATISTICS`` of each row's whole text, without a shuffle; null texts count as empty, and empty ones have zeros."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values in _of_batch(batch):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "values"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, values array<double>")


def _of_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row + 1, statistics) of runs of the batch's texts."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    for a, b, words in runs(batch.column(1), lower=False):
        yield a, b, statistics(words, lengths[a:b])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_a_class: int = ROWS_A_CLASS) -> Trees:
    """Trees fitted on at most ``rows_a_class`` labelled documents of each class; the base rate counts all labels.

    Rows with a null label or id are left out, and so are ids with no document. Of an id's labels the greatest counts, of its texts one.
    Without labels every score is 0.5, and with one class the base rate.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    first, second = (known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows_a_class) for y in (0, 1))
    # the sample is bounded by its parameter, so it is broadcast and the documents stay where they are
    pairs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(first.unionByName(second)), "id")
    one = pairs.groupBy("id", "y").agg(F.min_by("text", F.md5("text")).alias("text"))
    rows = document_statistics(one.select(F.struct("id", "y").alias("doc"), "text"), "doc").select("doc_id.id", "doc_id.y", "values").collect()
    rows.sort(key=lambda r: r["id"])
    return train(np.array([r["values"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows], dtype=np.int64), rate)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: P(label 1) of its whole text, without a shuffle.

    Null and empty texts have the score of zero statistics. Repeated rows get equal scores; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values in _of_batch(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.scores(values))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
