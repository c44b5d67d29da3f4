"""Boosted trees: statistics against plain counting, splits against all thresholds, flat arrays against recursion, held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from citywright.llm import quality_model
from citywright.llm.queries import op13_quality_classifier
from citywright.llm.quality_model import BINS, LEAST, RIDGE, STATISTICS, Trees, best_splits, document_statistics, train

WORDS = ["".join(random.Random(k).choices("etaoinshrdlu", k=2 + k % 7)) for k in range(300)]


def prose(rng, n):
    return "\n".join(" ".join(rng.choices(WORDS, k=12)).capitalize() + "." for _ in range(n))


def plain(text):
    """The statistics that plain counting gives most easily."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [tuple(w) for line in t.split("\n") if (w := re.findall(r"[^\x20\x09-\x0D]+", line))]
    raw = t.encode()
    sizes = [len(w.encode()) for w in words]
    mean = sum(sizes) / len(sizes) if sizes else 0.0

    def share(a, b):
        return a / b if b else 0.0

    return {
        "log_words": math.log1p(len(words)),
        "log_bytes": math.log1p(len(raw)),
        "upper_share": share(sum(65 <= b <= 90 for b in raw), len(raw)),
        "lead_share": share(sum(b >= 0xC0 for b in raw), len(raw)),
        "byte_entropy": -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values()) if raw else 0.0,
        "word_bytes": mean,
        "word_bytes_spread": math.sqrt(max(0.0, sum((s - mean) ** 2 for s in sizes) / len(sizes))) if sizes else 0.0,
        "longest_word": math.log1p(max(sizes, default=0)),
        "same_as_before": share(sum(a == b for a, b in pairs), len(pairs)),
        "distinct_words": share(len(set(words)), len(words)),
        "top_word": share(max(Counter(words).values(), default=0), len(words)),
        "distinct_pairs": share(len(set(pairs)), len(pairs)),
        "top_pair": share(max(Counter(pairs).values(), default=0), len(pairs)),
        "stopped_words": share(sum(w.endswith(".") for w in words), len(words)),
        "shouted_words": share(sum(len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w) for w in words), len(words)),
        "lines": math.log1p(len(lines)),
        "words_a_line": share(len(words), len(lines)),
        "ended_lines": share(sum(line[-1][-1] in ".!?:;\"')" for line in lines), len(lines)),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
    }


def test_statistics_equal_plain_counting(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 9)) for _ in range(20)]
    texts += [None, "", " \n\t ", "one", "AB!! CD!! cd!!\nAB!! CD!! cd!!\n\nx", "élan É naïve\r\nélan É naïve", "same same same same", "a\x0bb", prose(rng, 4000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS values", "2 AS score")
    got = document_statistics(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        values = dict(zip(STATISTICS, r["values"], strict=True))
        for name, want in plain(texts[r.doc_id]).items():
            assert abs(values[name] - want) < 1e-6 * max(1, abs(want)), (r.doc_id, name)
    assert all(v == 0 for r in got if texts[r.doc_id] in (None, "") for v in r["values"])


def test_best_split_equals_a_search_over_all_thresholds():
    rng = np.random.default_rng(3)
    for _ in range(20):
        bins, node = rng.integers(0, 6, (60, 4)), rng.integers(0, 3, 60)
        g, h = rng.normal(size=60), rng.random(60)
        gain, statistic, last = best_splits(bins, node, 3, g, h)
        for k in range(3):
            at = node == k
            best = -math.inf
            for f in range(4):
                for b in range(BINS):
                    left = at & (bins[:, f] <= b)
                    right = at & ~left
                    if h[left].sum() >= LEAST and h[right].sum() >= LEAST:
                        best = max(best, sum(g[s].sum() ** 2 / (h[s].sum() + RIDGE) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + RIDGE))
            assert gain[k] == best or abs(gain[k] - best) < 1e-9
            assert gain[k] == -math.inf or 0 <= statistic[k] < 4 and 0 <= last[k] < BINS


def test_flat_trees_equal_recursion():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    trees = train(x, (x[:, 0] * x[:, 1] > 0).astype(np.int64), 0.5)

    def down(t, node, row):
        inner = trees.feature.shape[1]
        if node >= inner:
            return trees.value[t, node - inner]
        return down(t, 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1), row)

    for row, got in zip(x[:50], trees.scores(x[:50]), strict=True):
        total = trees.base + sum(down(t, 0, row) for t in range(len(trees.value)))
        assert abs(got - 1 / (1 + math.exp(-total))) < 1e-12
    # a product of two signs needs both: no single split gives it
    fresh = rng.normal(size=(2000, 5))
    assert np.mean((trees.scores(fresh) >= 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)) > 0.9


def test_rows_are_weighted_to_the_base_rate():
    x = np.zeros((100, 2))
    for rate in (0.1, 0.9):
        assert np.allclose(train(x, np.arange(100) % 2, rate).scores(x), rate, atol=1e-3)


def test_held_out_rows_odd_tables_and_one_class(spark, tmp_path):
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(500):
        text, bad = prose(rng, rng.randrange(2, 9)), k % 3 == 0
        if bad:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + rng.choice(["###", "%%%"]) for w in t.split()), lambda t: " ".join(w for w in t.split()[:9] for _ in range(8))])(text)
        docs.append((k, text))
        labels.append((k, int(not bad)))
    extra = [(1000, None), (1001, ""), (1002, " \n "), (0, docs[0][1]), (None, "no id"), (1003, prose(rng, 3000))]
    spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS y", "3 AS values").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (5000, 1), (None, 0), (1000, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = op13_quality_classifier(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([(a >= 0.3) == y for a, y in held]) > 0.95
    assert len({r.score for r in rows if r.doc_id in (1000, 1001)}) == 1 and len({r.score for r in rows if r.doc_id == 0}) == 1
    frame = spark.createDataFrame(docs[:50], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.score(frame, quality_model.fit(frame, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id long, quality int")
    assert {r.score > 0.99 for r in quality_model.score(frame, quality_model.fit(frame, ones)).collect()} == {True}
    assert quality_model.score(frame.limit(0), Trees(np.zeros((1, 15), np.int64), np.full((1, 15), np.inf), np.zeros((1, 16)), 0.0)).isEmpty()


def test_statistics_of_runs_do_not_depend_on_their_neighbours():
    rng = random.Random(6)
    texts = [prose(rng, 3), "", "x", prose(rng, 5), None]
    whole = next(quality_model._of_batch(pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["a", "b"])))[2]
    for k, t in enumerate(texts):
        alone = next(quality_model._of_batch(pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t], pa.string())], names=["a", "b"])))[2][0]
        assert np.array_equal(whole[k], alone)
