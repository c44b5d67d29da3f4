"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .words import Run, runs

#: Words that tasks are sent with their counts; rarer ones are looked up by a join.
SHARED_WORDS = 1_000_000
#: Of those, words have weights of their own from a count of sqrt(N) / FLOOR on, N being the tokens of the corpus, and so many
#: at least; they are split into sqrt(V) classes, or so many at least, by the square root of frequency. Bands hold the others by
#: rank, each with fixed frequencies inside. The last band is for all rarer words.
FLOOR, OWN_WORDS, OWN_CLASSES, BANDS = 10, 1000, 24, 6
#: Inputs: a start mark, the bands, and the own words behind them.
START, FIRST_BAND, FIRST_OWN = 0, 1, 1 + BANDS
HIDDEN, STEPS = 16, 32
#: Weights are averaged in slices of so many, since a vector grows with the vocabulary. Targets are scored so many at a time, and
#: their classes in fewer, which a processor's cache holds.
SLICE, TARGETS, CLASS_TARGETS = 1 << 18, 1 << 13, 1 << 11
#: Training: rounds, into which all training documents are dealt by a hash of the id; pieces of documents side by side, from
#: few to many as a task has more of them, and their tokens; Adam's rate, and how many tasks' weights are averaged at a time.
ROUNDS, ABREAST, MOST_ABREAST, PIECE, RATE, LOT, SEED = 2, 64, 512, 512, 0.02, 32, 11

END = np.uint64(1)
#: Distinct words that a task gathers before it hands their counts on.
GATHERED = 1_000_000
#: Tokens that a task scores, or trains on, side by side. Words are found in smaller runs, which need more memory for each.
TOKENS = 2_000_000


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, where = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(where, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "c"])

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for a, b, run in runs(batch.column(0)):
            words, counts = np.unique(run.hashes, return_counts=True)
            parts += [(words, counts), (np.array([END]), np.array([b - a]))]
            size += len(words) + 1
            if size > GATHERED:
                parts = [_merge(parts)]
                size = len(parts[0][0])
                if size > GATHERED // 2:
                    yield out(*parts[0])
                    parts, size = [], 0
    if parts:
        yield out(*_merge(parts))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) for every distinct word of one text column, by the word's 64-bit hash; each text adds one END.

    Tasks add up their own words first, so what is shuffled is a row for each task and distinct word.
    """
    return texts.mapInArrow(_counted, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` words reach, without sorting them.

    Words are counted in bins of a 64th of an octave, so that some thousand rows at most decide on the least bin.
    """
    bin_ = F.floor(F.log2(F.col("c").cast("double")) * 64)
    sizes = sorted(((r["b"], r["n"]) for r in counts.groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = math.inf, 0
    for b, n in sizes:
        if held + n > most:
            break
        least, held = b, held + n
    return counts.where(bin_ >= least) if sizes and least < math.inf else counts.where(F.lit(False))


@dataclass
class Vocabulary:
    """The shared words by hash: counts, input number, class, and place or log frequency in the class."""

    total: int
    kinds: int
    words: np.ndarray
    counts: np.ndarray
    token: np.ndarray
    group: np.ndarray
    inner: np.ndarray
    #: First own word of each own class, and the end of the last.
    edges: np.ndarray
    #: Log frequency of each class and, for own words, within their class.
    group_bias: np.ndarray
    word_bias: np.ndarray
    rare_mass: float
    #: Words with weights of their own, and their classes.
    own: int
    classes: int

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, total: int, kinds: int) -> Vocabulary:
        """``words`` by falling count, of ``kinds`` distinct ones with ``total`` occurrences."""
        smooth = total + 0.5 * (kinds + 1)
        prob = (counts + 0.5) / smooth
        own = max(min(OWN_WORDS, len(words)), int((counts >= math.sqrt(total) / FLOOR).sum()))
        classes = max(OWN_CLASSES, math.isqrt(own))
        share = np.cumsum(np.sqrt(prob[:own])) if own else np.zeros(0)
        group = np.zeros(len(words), dtype=np.int32)
        if own:
            group[:own] = np.minimum((share - np.sqrt(prob[:own]) / 2) / share[-1] * classes, classes - 1).astype(np.int32)
        edges = np.searchsorted(group[:own], np.arange(classes + 1))
        # bands double in width from rank to rank; the last is kept for rare words
        rank = np.arange(own, len(words))
        group[own:] = classes + np.minimum(np.log2(np.maximum(rank / max(own, 1), 1)).astype(np.int32) // 2, BANDS - 2)
        rare = max(0.5, 0.5 + (total - int(counts.sum())) + 0.5 * (kinds - len(words))) / smooth
        mass = np.bincount(group, prob, classes + BANDS)
        mass[-1] = rare
        inner = np.log(prob / mass[group])
        inner[:own] = np.arange(own)
        token = np.where(np.arange(len(words)) < own, FIRST_OWN + np.arange(len(words)), FIRST_BAND + group - classes).astype(np.int32)
        order = np.argsort(words, kind="stable")
        bias = np.log(np.maximum(mass, 1e-12))
        word_bias = np.zeros(own)
        word_bias[:own] = np.log(prob[:own] / mass[group[:own]])
        return cls(total, kinds, words[order], counts[order], token[order], group[order], inner[order].astype(np.float32), edges, bias, word_bias, rare, own, classes)

    def find(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words`` or -1 for each word of the run, the same for END alone)."""
        kinds, number = np.unique(np.append(run.hashes, END), return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, kinds), max(len(self.words) - 1, 0))
        at = np.where(self.words[at] == kinds, at, -1) if len(self.words) else np.full(len(kinds), -1)
        return at[number[:-1]], at[number[-1:]]


@dataclass
class Batch:
    """Tokens of some documents, END included: inputs, classes, places in the class, and where documents begin."""

    token: np.ndarray
    group: np.ndarray
    inner: np.ndarray
    firsts: np.ndarray


def batch_of(vocabulary: Vocabulary, run: Run, at: np.ndarray, end: int) -> Batch:
    firsts = np.cumsum(np.concatenate(([0], run.counts + 1)))
    place = np.empty(int(firsts[-1]), dtype=np.int64)
    ends = firsts[1:] - 1
    inside = np.ones(len(place), dtype=bool)
    inside[ends] = False
    place[inside], place[ends] = at, end
    token, group = FIRST_BAND + BANDS - 1, vocabulary.classes + BANDS - 1
    if not len(vocabulary.words):
        n = len(place)
        return Batch(np.full(n, token, np.int32), np.full(n, group, np.int32), np.zeros(n), firsts)
    rare = place < 0
    pick = lambda values, other: np.where(rare, other, values[place])
    return Batch(pick(vocabulary.token, token), pick(vocabulary.group, group), pick(vocabulary.inner, 0.0), firsts)


def joined(parts: list[Batch]) -> Batch:
    """The documents of all parts in one batch."""
    shift = np.cumsum([0, *(p.firsts[-1] for p in parts)])
    firsts = np.concatenate([[0], *(p.firsts[1:] + n for p, n in zip(parts, shift, strict=False))])
    return Batch(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("token", "group", "inner")), firsts)


def _softmax(logits: np.ndarray, targets: np.ndarray, rows: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each row's target, one over the sums by row); ``logits`` become exponentials. ``small`` ones cannot overflow and keep their scale."""
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    part = logits[rows, targets].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones((logits.shape[1], 1), dtype=np.float32)
    part -= np.log(total[:, 0])
    return part, 1 / total


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether logits stay small for all states, which are within -1..1."""
    return not len(bias) or float(np.abs(weights).sum(axis=0).max() + np.abs(bias).max()) <= 60


class Network:
    """The recurrent model. Parameters are views of one flat vector."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        own, self.classes = vocabulary.own, vocabulary.classes
        groups = self.classes + BANDS
        shapes = {"x": (FIRST_OWN + own, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, groups), "cb": (groups,), "w": (HIDDEN, own), "wb": (own,)}
        sizes = {k: math.prod(s) for k, s in shapes.items()}
        fresh = flat is None
        self.flat = np.zeros(sum(sizes.values()), dtype=np.float32) if fresh else flat.astype(np.float32)
        at = 0
        self.p: dict[str, np.ndarray] = {}
        for k, s in shapes.items():
            self.p[k] = self.flat[at : at + sizes[k]].reshape(s)
            at += sizes[k]
        self.shapes, self.sizes = shapes, sizes
        self.edges = vocabulary.edges
        if fresh:
            rng = np.random.default_rng(SEED)
            self.p["x"][:] = rng.normal(0, 0.3, shapes["x"])
            self.p["u"][:] = rng.normal(0, 0.3 / math.sqrt(HIDDEN), shapes["u"])
            # the untrained network gives the frequencies of the whole corpus
            self.p["cb"][:] = vocabulary.group_bias
            self.p["wb"][:] = vocabulary.word_bias

    @np.errstate(over="ignore")
    def states(self, tokens: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (steps, documents, HIDDEN) after each of the input tokens (steps, documents), from state ``h``."""
        x, u, n = self.p["x"], self.p["u"], HIDDEN
        inputs = x[tokens]
        out = np.empty((len(tokens), len(h), n), dtype=np.float32)
        kept = []
        for t in range(len(tokens)):
            a, g = inputs[t], h @ u
            gates = a[:, : 2 * n] + g[:, : 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
            after = out[t]
            np.subtract(h, new, out=after)
            after *= z
            after += new
            if keep:
                kept.append((h, z, r, new, g[:, 2 * n :]))
            h = after
        return out, kept

    def log_probs(self, h: np.ndarray, group: np.ndarray, inner: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target from its state; with ``grads``, adds the loss's gradients and returns those of ``h``."""
        c, cb, w, wb = (self.p[k] for k in ("c", "cb", "w", "wb"))
        at = np.arange(len(h))
        ones = np.ones(len(h), dtype=np.float32)
        small = _bounded(c, cb) and _bounded(w, wb)
        # by class, so that what a class needs lies together
        order = np.argsort(group.astype(np.int16), kind="stable")
        h, group, inner = h[order], group[order], inner[order]
        logs, back = np.empty(len(h)), None if grads is None else np.empty_like(h)
        for a in range(0, len(h), CLASS_TARGETS):
            b = min(a + CLASS_TARGETS, len(h))
            line, target = at[: b - a], group[a:b]
            logits = h[a:b] @ c
            logits += cb
            logs[a:b], over = _softmax(logits, target, line, small)
            if grads is not None:
                logits *= over
                logits[line, target] -= 1
                np.matmul(logits, c.T, out=back[a:b])
                grads["c"] += h[a:b].T @ logits
                grads["cb"] += ones[: b - a] @ logits
        bounds = np.searchsorted(group, np.arange(self.classes + 1)).tolist()
        last = bounds[-1]
        logs[last:] += inner[last:]
        places = inner[:last].astype(np.int64) - self.edges[group[:last]]
        edges = self.edges.tolist()
        for k in range(self.classes):
            a, b, lo, hi = bounds[k], bounds[k + 1], edges[k], edges[k + 1]
            if a == b or hi - lo < 2:
                continue
            own, weights = h[a:b], w[:, lo:hi]
            logits = own @ weights
            logits += wb[lo:hi]
            place, line = places[a:b], at[: b - a]
            part, over = _softmax(logits, place, line, small)
            logs[a:b] += part
            if grads is not None:
                logits *= over
                logits[line, place] -= 1
                back[a:b] += logits @ weights.T
                grads["w"][:, lo:hi] += own.T @ logits
                grads["wb"][lo:hi] += ones[: b - a] @ logits
        out = np.empty_like(logs)
        out[order] = logs
        if back is not None:
            unsorted = np.empty_like(back)
            unsorted[order] = back
            back = unsorted
        return out, back

    def through_time(self, tokens: np.ndarray, kept: list, back: np.ndarray, grads: dict) -> np.ndarray:
        """Backpropagation through one window; ``back`` holds the gradients of its states. Returns the inputs that occur."""
        u, n = self.p["u"], HIDDEN
        inputs = np.empty((*tokens.shape, 3 * n), dtype=np.float32)
        dh = np.zeros_like(back[0])
        for t in range(len(tokens) - 1, -1, -1):
            h, z, r, new, g = kept[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - new * new)
            da = inputs[t]
            da[:, :n] = dh * (h - new) * z * (1 - z)
            da[:, n : 2 * n] = dn * g * r * (1 - r)
            da[:, 2 * n :] = dn
            dg = da.copy()
            dg[:, 2 * n :] *= r
            grads["u"] += h.T @ dg
            dh = dh * z + dg @ u.T
        flat, order = inputs.reshape(-1, 3 * n), np.argsort(tokens.ravel(), kind="stable")
        kinds, first = np.unique(tokens.ravel()[order], return_index=True)
        grads["x"][kinds] += np.add.reduceat(flat[order], first, axis=0)
        return kinds


def _windows(batch: Batch, docs: np.ndarray, begins: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents still open, inputs, places of the targets, which of them exist), window by window.

    ``docs`` by falling length. All are (steps, documents); the input of a document's first token is a start mark.
    Where ``begins`` is false, a piece goes on from the token before it.
    """
    sizes = batch.firsts[docs + 1] - batch.firsts[docs]
    for lo in range(0, int(sizes[0]) if len(sizes) else 0, STEPS):
        open_ = int(np.searchsorted(-sizes, -lo, side="left"))
        steps = min(STEPS, int(sizes[0]) - lo)
        place = batch.firsts[docs[:open_]][None, :] + lo + np.arange(steps)[:, None]
        there = (lo + np.arange(steps))[:, None] < sizes[:open_][None, :]
        place = np.where(there, place, 0)
        tokens = batch.token[np.maximum(place - 1, 0)]
        if lo == 0:
            tokens[0] = START if begins is None else np.where(begins[docs[:open_]], START, tokens[0])
        yield open_, tokens, place, there


def score_batch(net: Network, batch: Batch) -> np.ndarray:
    """Natural log-likelihood of each document; states go on from window to window, over the whole text."""
    sizes = np.diff(batch.firsts)
    docs = np.argsort(-sizes, kind="stable")
    total = np.zeros(len(sizes))
    h = np.zeros((len(docs), HIDDEN), dtype=np.float32)
    for open_, tokens, place, there in _windows(batch, docs):
        states, _ = net.states(tokens, h[:open_])
        h = states[-1]
        at = place[there]
        states = states[there]
        logs = np.concatenate([net.log_probs(states[a : a + TARGETS], batch.group[at[a : a + TARGETS]], batch.inner[at[a : a + TARGETS]])[0] for a in range(0, len(at), TARGETS)])
        owner = np.broadcast_to(docs[:open_], there.shape)[there]
        total += np.bincount(owner, logs, len(total))
    return total


class Trainer:
    """Truncated backpropagation with Adam, a step for each window; states go on between windows, gradients do not."""

    def __init__(self, net: Network):
        self.net, self.tokens, self.step = net, 0, 0
        self.m, self.v, self.flat = np.zeros_like(net.flat), np.zeros_like(net.flat), np.zeros_like(net.flat)
        self.grads, at = {}, 0
        for k, s in net.shapes.items():
            self.grads[k] = self.flat[at : at + net.sizes[k]].reshape(s)
            at += net.sizes[k]

    def learn(self, batch: Batch) -> None:
        # no token is left out, but a long document's pieces go side by side, each from a state of its own
        lengths = np.diff(batch.firsts)
        pieces = -(-lengths // PIECE)
        number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = number == 0
        firsts = np.append(np.repeat(batch.firsts[:-1], pieces) + number * PIECE, batch.firsts[-1])
        batch = Batch(batch.token, batch.group, batch.inner, firsts)
        sizes = np.diff(firsts)
        order = np.argsort(-sizes, kind="stable")
        # pieces of like length go side by side, and such groups in a seeded order
        abreast = min(max(ABREAST, len(sizes) // 16), MOST_ABREAST)
        for a in np.random.default_rng(SEED).permutation(np.arange(0, len(sizes), abreast)):
            docs = order[a : a + abreast]
            h = np.zeros((len(docs), HIDDEN), dtype=np.float32)
            for open_, tokens, place, there in _windows(batch, docs, begins):
                net, grads = self.net, self.grads
                states, kept = net.states(tokens, h[:open_], keep=True)
                h = states[-1].copy()
                where = place[there]
                _, back = net.log_probs(states[there], batch.group[where], batch.inner[where], grads)
                full = np.zeros_like(states)
                full[there] = back
                self._update(net.through_time(tokens, kept, full, grads), len(where))

    def _update(self, kinds: np.ndarray, tokens: int) -> None:
        """A step along the summed gradients, which are zero again afterwards. Inputs that did not occur stay as they are."""
        net, rest = self.net, self.net.sizes["x"]
        shape = net.shapes["x"]
        rows, others = self.grads["x"][kinds] / tokens, self.flat[rest:] / tokens
        self.grads["x"][kinds] = 0
        self.flat[rest:] = 0
        norm = float(np.sqrt((rows * rows).sum() + (others * others).sum()))
        if norm > 1:
            rows /= norm
            others /= norm
        self.step += 1
        self.tokens += tokens
        # windows with few tokens are noisy and get a smaller step
        rate = RATE * min(1.0, math.sqrt(tokens / (ABREAST * STEPS)))

        def step(grad: np.ndarray, m: np.ndarray, v: np.ndarray) -> np.ndarray:
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            return rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)

        m, v = self.m[:rest].reshape(shape), self.v[:rest].reshape(shape)
        some_m, some_v = m[kinds], v[kinds]
        net.p["x"][kinds] -= step(rows, some_m, some_v)
        m[kinds], v[kinds] = some_m, some_v
        net.flat[rest:] -= step(others, self.m[rest:], self.v[rest:])


def _averaged(parts: pd.DataFrame) -> pd.DataFrame:
    tokens = parts["tokens"].to_numpy(dtype=np.float64)
    mean = sum(np.frombuffer(p, dtype=np.float32).astype(np.float64) * n for p, n in zip(parts["weights"], tokens, strict=True)) / max(tokens.sum(), 1)
    return pd.DataFrame({"slice": parts["slice"].iloc[:1], "lot": parts["lot"].iloc[:1], "weights": [mean.astype(np.float32).tobytes()], "tokens": [int(tokens.sum())]})


def averaged(parts: DataFrame, members: int) -> DataFrame:
    """One row for each slice of ``parts`` (slice, lot, weights, tokens): the mean by tokens over lots 0 to ``members`` - 1.

    As many levels as it takes, each of which averages ``LOT`` rows of a slice at most in one task, however many tasks there were.
    """
    while True:
        lots = max(1, -(-members // LOT))
        parts = parts.withColumn("lot", F.pmod("lot", F.lit(lots))).groupBy("slice", "lot").applyInPandas(_averaged, parts.schema)
        if lots == 1:
            return parts
        members = lots


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights learned from all rows of (doc_id, text): in each round, tasks train from the same weights on their own documents.

    The tasks' weights are averaged by tokens, slice by slice, in as many levels as there are tasks for (``averaged``), so that a task gets a few
    dozen slices at a time and the driver one vector. Each round takes another one of ``rounds`` shares of the documents by a hash of the id,
    so every document is learned from once, those without an id too.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    flat = Network(vocabulary).flat
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            vocabulary = shared.value
            trainer = Trainer(Network(vocabulary, start.value))
            parts: list[Batch] = []
            for batch in batches:
                for _, _, words in runs(batch.column(0)):
                    at, end = vocabulary.find(words)
                    parts.append(batch_of(vocabulary, words, at, int(end[0])))
                    if sum(len(p.token) for p in parts) >= TOKENS:
                        trainer.learn(joined(parts))
                        parts = []
            if parts:
                trainer.learn(joined(parts))
            if trainer.tokens:
                flat, lot = trainer.net.flat, TaskContext.get().partitionId()
                for k, a in enumerate(range(0, len(flat), SLICE)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([lot]), pa.array([flat[a : a + SLICE].tobytes()], pa.binary()), pa.array([trainer.tokens])], names=["slice", "lot", "weights", "tokens"])

        schema = "slice long, lot long, weights binary, tokens long"
        mine = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).select("text")
        slices = sorted(averaged(mine.mapInArrow(run, schema), mine.rdd.getNumPartitions()).collect(), key=lambda r: r["slice"])
        if slices:
            flat = np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in slices])
    return flat


def score_texts(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``, over its whole text.

    Tokens are the words, A-Z lower-cased, and one end. Counts are exact over all rows for which ``held_out`` (a
    condition on id and text columns) is false: base_score is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))), n_known the tokens with c > 0.
    score is the recurrent model's log10 probability: a class, then a word in it. Words outside the shared vocabulary are in the
    last class, with their smoothed frequency in it, so the model's probabilities add up to 1 with one unseen word.

    Null, empty and wordless texts are one end token. Without training rows all counts are 0 and V is 0. Repeated rows get
    a row each, and repeated training rows count as often as they occur. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)).alias("held_out"))
    learned = source.where(~F.col("held_out")).select("doc_id", "text")
    counts = stored(count_words(learned.select("text")), "word-counts")
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(row["n"] or 0), int(row["v"])
    top = most_frequent(counts, SHARED_WORDS).toArrow()
    words, often = top["word"].to_numpy(), top["c"].to_numpy()
    order = np.lexsort((words, -often))
    vocabulary = Vocabulary.of(words[order].view(np.uint64), often[order], total, kinds)
    weights = train(learned, vocabulary, rounds)
    shared = spark.sparkContext.broadcast((vocabulary, weights))
    smooth = math.log10(total + 0.5 * (kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        net = Network(vocabulary, weights)
        names = ["row", "doc_id", "n_tokens", "n_known", "base", "logs", "words", "times"]
        values = np.append(np.log10(vocabulary.counts + 0.5) - smooth, 0.0)
        rows: list[pa.RecordBatch] = []
        parts: list[Batch] = []

        def scored() -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            logs = score_batch(net, joined(parts)) / math.log(10)
            rows.clear()
            parts.clear()
            return table.append_column("logs", pa.array(logs)).select(names).to_batches()[0]

        for batch in batches:
            for a, b, words in runs(batch.column(2)):
                at, end = vocabulary.find(words)
                parts.append(batch_of(vocabulary, words, at, int(end[0])))
                owner = np.repeat(np.arange(b - a), words.counts)
                rare = at < 0
                base = np.bincount(owner, values[at], b - a).astype(np.float64)
                base += values[end[0]] if end[0] >= 0 else -math.log10(2) - smooth
                known = np.bincount(owner[~rare], minlength=b - a) + int(end[0] >= 0)
                # rare words of each document with how often it has them
                pairs = np.stack([owner[rare].astype(np.int64), words.hashes[rare].view(np.int64)], axis=1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                new = np.ones(len(pairs), dtype=bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                times = np.diff(np.append(np.flatnonzero(new), len(pairs)))
                edges = np.searchsorted(pairs[new, 0], np.arange(b - a + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)) for x in (pairs[new, 1], times.astype(np.int64))]
                rows.append(pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array((words.counts + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), *lists], names=[n for n in names if n != "logs"]))
                if sum(len(p.token) for p in parts) >= TOKENS:
                    yield scored()
        if rows:
            yield scored()

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = stored(numbered.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, logs double, words array<long>, times array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times")).alias("n_rare"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.5) - smooth)).alias("rare_base"),
    )
    whole = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "logs").join(found, "row", "left").na.fill(0, ["more_known", "n_rare", "rare_base"])
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"),
        (F.col("logs") + F.col("rare_base") - F.col("n_rare") * math.log10(vocabulary.rare_mass)).alias("score"),
    )
