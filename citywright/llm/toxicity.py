"""Toxicity: subword-bag embeddings, averaged into a linear softmax; both are trained together in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Run, cut, mix64, runs, text_buffers

#: The classifier is fitted on this many labelled documents of each class at most, the first by a hash of their id.
ROWS_A_CLASS = 1000
#: Of each class, the sample's texts take so many bytes at most; documents that would go beyond are not drawn.
BYTES_A_CLASS = 32 << 20
#: Lengths of the character n-grams of ``<word>``, hash buckets, vector size.
GRAMS, BUCKETS, DIM = (3, 4, 5), 1 << 17, 8
#: Words averaged together, and the step between such windows; a document scores as its most toxic window.
WINDOW, STEP = 16, 8
#: Plain momentum: a rare n-gram moves as far as the few documents that hold it push, and noise stays small.
EPOCHS, MOMENTUM, EMBED_RATE, SOFT_RATE, SEED = 60, 0.9, 200.0, 1.0, 7
THRESHOLD = 0.3


def _distinct(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, number of the distinct word at each place)."""
    _, first, number = np.unique(run.hashes, return_index=True, return_inverse=True)
    return first, number


def characters(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each character of the run's texts, first character of each word, its end); a character's bytes are one number."""
    data, n = run.data, len(run.data)
    lead = (data & 0xC0) != 0x80
    lead[run.starts] = True
    at = np.flatnonzero(lead)
    codes, open_ = data[at].astype(np.uint64), np.ones(len(at), dtype=bool)
    for k in range(1, 4):
        following = np.minimum(at + k, n - 1)
        open_ &= (at + k < n) & ~lead[following]
        codes = np.where(open_, (codes << np.uint64(8)) | data[following], codes)
    number = np.cumsum(lead)
    return codes, number[run.starts] - 1, number[run.ends - 1]


def gram_buckets(run: Run, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the character n-grams of these words, where each word's begin). Every word has its whole self as one too."""
    codes, begins, stops = characters(run)
    starts, ends = begins[words], stops[words]
    sizes = ends - starts + 2
    edges = np.concatenate(([0], np.cumsum(sizes)))
    n = int(edges[-1])
    at = np.arange(n) - np.repeat(edges[:-1], sizes)
    inner = (at > 0) & (at < np.repeat(sizes, sizes) - 1)
    chars = np.where(at == 0, np.uint8(ord("<")), np.uint8(ord(">"))).astype(np.uint64)
    chars[inner] = codes[(np.repeat(starts, sizes) + at - 1)[inner]]
    left = np.repeat(edges[1:], sizes) - np.arange(n)
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [mix64(run.hashes[words])], [np.arange(len(words))]
    code = np.zeros(n, dtype=np.uint64)
    for size in range(1, max(GRAMS) + 1):
        room = n - size + 1
        if room <= 0:
            break
        code = code[:room] * np.uint64(1_000_003) + chars[size - 1 :][:room] + np.uint64(1)
        if size in GRAMS:
            whole = left[:room] >= size
            found.append(mix64(code[whole] + np.uint64(size << 56)))
            owners.append(owner[:room][whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(found)[order] & np.uint64(BUCKETS - 1)).astype(np.int32)
    return buckets, np.searchsorted(owner[order], np.arange(len(words)))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, document) of all windows; they cover every word, and a wordless document has none."""
    many = np.where(counts == 0, 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)))
    owner = np.repeat(np.arange(len(counts)), many)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    base = np.repeat(np.cumsum(counts) - counts, many)
    return base + turn * STEP, base + np.minimum(turn * STEP + WINDOW, counts[owner]), owner


@dataclass
class Model:
    """What scoring needs: the log odds that each bucket adds to an average, and the fit of scores to frequencies."""

    odds: np.ndarray
    slope: float
    offset: float
    base_rate: float

    def scores(self, run: Run) -> np.ndarray:
        """P(toxic) for each document of the run."""
        out = np.full(len(run.counts), self.base_rate)
        # a model of one class knows no more than the base rate
        if len(run.hashes) and self.slope:
            first, number = _distinct(run)
            buckets, starts = gram_buckets(run, first)
            word = np.add.reduceat(self.odds[buckets], starts) / np.diff(np.append(starts, len(buckets)))
            best, owners = _best(word[number], run.counts)[1:]
            out[owners] = _sigmoid(self.slope * best + self.offset)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _best(word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the window with the greatest mean, that mean, document) for each document with words."""
    a, b, owner = windows(counts)
    sums = np.concatenate(([0.0], np.cumsum(word, dtype=np.float64)))
    mean = (sums[b] - sums[a]) / (b - a)
    docs, first = np.unique(owner, return_index=True)
    top = np.maximum.reduceat(mean, first)
    at = np.flatnonzero(mean == np.repeat(top, np.diff(np.append(first, len(mean)))))
    pick = at[np.searchsorted(at, first)]
    return pick, mean[pick], docs


def train(texts: list[str], labels: np.ndarray, rate: float) -> Model:
    """Fit embeddings and softmax together by gradient descent; each epoch learns from every document's most toxic window.

    ``rate`` is the frequency of label 1 among all labelled training rows, which the sample's balance hides.
    """
    labels = np.asarray(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(rate))
    offsets, data = text_buffers(pa.array(texts, pa.large_string()))
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    run = cut(lower, offsets)
    first, number = _distinct(run)
    buckets, starts = gram_buckets(run, first)
    sizes = np.diff(np.append(starts, len(buckets)))
    rng = np.random.default_rng(SEED)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    speeds = [np.zeros_like(p) for p in (embed, soft, bias)]
    a, b, _ = windows(run.counts)
    for _ in range(EPOCHS):
        word = np.add.reduceat(embed[buckets], starts, axis=0) / sizes[:, None].astype(np.float32)
        pick, _, docs = _best((word @ (soft[:, 1] - soft[:, 0]))[number], run.counts)
        y = labels[docs]
        span = b[pick] - a[pick]
        edges = np.cumsum(span) - span
        token = number[np.arange(int(span.sum())) - np.repeat(edges, span) + np.repeat(a[pick], span)]
        mean = np.add.reduceat(word[token], edges, axis=0) / span[:, None]
        logits = mean @ soft + bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        slope = (prob * weight[:, None]).astype(np.float32)
        back = (slope @ soft.T) / span[:, None]
        by_word = np.stack([np.bincount(token, np.repeat(back[:, k], span), len(first)) for k in range(DIM)], axis=1) / sizes[:, None]
        active = np.flatnonzero(by_word.any(axis=1))
        many = sizes[active]
        gram = buckets[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[active], many)]
        into = np.stack([np.bincount(gram, np.repeat(by_word[active, k], many), BUCKETS) for k in range(DIM)], axis=1).astype(np.float32)
        for p, g, speed, rate_ in zip((embed, soft, bias), (into, mean.T @ slope, slope.sum(axis=0)), speeds, (EMBED_RATE, SOFT_RATE, SOFT_RATE), strict=True):
            speed *= MOMENTUM
            speed += g
            p -= rate_ * speed
    odds = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    word = np.add.reduceat(odds[buckets], starts) / sizes
    _, x, docs = _best(word[number], run.counts)
    return Model(odds, *_fitted(x, labels[docs], rate), float(rate))


def _fitted(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope and offset of the log odds over ``x``, each class weighted as in all labelled rows; a small ridge holds the slope finite."""
    w = np.where(y == 1, rate / max(1, (y == 1).sum()), (1 - rate) / max(1, (y == 0).sum())) * len(y)
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ beta)
        hess = z.T @ (z * (w * p * (1 - p) + 1e-9)[:, None]) + np.diag([0.05, 1e-6])
        step = np.linalg.solve(hess, z.T @ (w * (y - p)) - np.array([0.05, 1e-6]) * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_a_class: int = ROWS_A_CLASS, bytes_a_class: int = BYTES_A_CLASS) -> Model:
    """Train on at most ``rows_a_class`` labelled documents of each class, of ``bytes_a_class`` in all; the base rate counts them all.

    Rows with a null label or id are left out, and so are ids with no document. Of rows that repeat an id, one text is learned from.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    drawn = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows_a_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    # the sample is bounded by its parameter, so it is broadcast and the documents stay where they are
    pairs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(drawn), "id")
    one = pairs.groupBy("id", "y").agg(F.min_by("text", F.md5("text")).alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    bounded = one.withColumn("bytes", so_far).where(F.col("bytes") <= bytes_a_class)
    rows = sorted(bounded.select("id", "y", "text").collect(), key=lambda r: r["id"])
    return train([r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.int64), rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``: P(toxic) of its whole text, without a shuffle.

    Null, empty and wordless texts get the base rate. Repeated rows get equal scores; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in runs(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.scores(words))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
