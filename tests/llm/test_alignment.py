"""Token alignment against whole-text encoding and plain merging of byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citywright.llm import alignment
from citywright.llm.alignment import BYTE_LEVEL, PIECES, align, link_figures, split_at_shared_cuts
from citywright.llm.queries import op11_token_alignment

ODD = ["", None, " ", "  two  spaces ", "\ttab\nline\r\n\r\nend", "a b c  d　e f", "under▁mark", "naïve café élan é é", "<|endoftext|> </s> <s> <0x41>", "語 日本語 テキスト", "🙂🙃 x", "can't I've 12 345 x2", "\x00 nul \x7f del", "ﬁ ① ½", "é ́x", "a" * 700, "é " * 400, " line  sep ​ zero", "᠎ mong  ogham x"]


def plain(text, a, b):
    """(A ids, B ids, groups, links) by whole-text encoding and a merge of ends."""
    want = b" " + text.encode() if text else b""
    if not want:
        return [], [], [], []
    letters = alignment._byte_letters()
    enc = a.encode(" " + text, add_special_tokens=False)
    ids_a, ids_b = enc.ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else a.id_to_token(i).encode() for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], [], []
    spans = []
    for parts in (bytes_a, bytes_b):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        spans.append(out)
    common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for high in common:
        groups.append(tuple([i for i, (s, e) in zip(ids, span, strict=True) if low <= s and e <= high] for ids, span in ((ids_a, spans[0]), (ids_b, spans[1]))))
        low = high
    links = [(x, y) for x, (s, e) in zip(ids_a, spans[0], strict=True) for y, (u, v) in zip(ids_b, spans[1], strict=True) if s < v and u < e] if len(ids_a) < 3000 else None
    return ids_a, ids_b, groups, links


def texts(n=40, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoinshrdluéñü", k=rng.randrange(1, 9))) for _ in range(120)]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 60))).replace("a ", rng.choice(["a ", "a  ", "a\n", "a, "])) for _ in range(n)]


def expected(rows):
    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    found = [(i, *plain(t, a, b)) for i, t in rows]
    counts = Counter(link for *_, links in found for link in links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, ids_a, ids_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if ids_a else ""
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return Counter(out)


def test_equals_whole_text_encoding_and_plain_merge(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts() + ODD)] + [(0, texts()[0]), (0, texts()[0]), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_a", "2 AS pair", "3 AS groups").write.parquet(str(tmp_path / "documents.parquet"))
    want = expected(rows)
    assert Counter(map(tuple, op11_token_alignment(spark, str(tmp_path)).collect())) == want
    # a pair table too large for tasks is joined instead
    digest = "CASE WHEN n_a > 0 THEN sha2(groups, 256) ELSE '' END AS groups_sha256"
    joined = link_figures(align(spark.read.parquet(str(tmp_path / "documents.parquet"))), most_pairs=0)
    got = joined.selectExpr("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest).collect()
    assert Counter(map(tuple, got)) == want


def test_odd_texts_have_tokens_where_their_bytes_are_kept(spark):
    rows = align(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()
    zero = {ODD[r.doc_id] for r in rows if r.n_a == 0}
    assert zero == {"", None, "under▁mark"}
    for r in rows:
        assert r.n_links == r.n_a + r.n_b - r.n_groups and sum(r.pair_links) == r.n_links
        assert r.groups.count("|") == r.n_groups


def test_empty_table_long_text_and_forgotten_chunks(spark, monkeypatch):
    assert link_figures(align(spark.createDataFrame([], "doc_id long, text string"))).isEmpty()
    monkeypatch.setattr(alignment, "MOST_CHUNKS", 10)
    long = " ".join(f"word{k % 977} naïve" for k in range(120_000))
    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = alignment.Encoded(alignment.Tokenizers(BYTE_LEVEL, PIECES))
    labels = np.array([f"{k}{m}" for k in range(60_000) for m in ",|;"], dtype=object)
    for text in (long, "one two", long[:500], "two one"):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        figures, groups, *_ = alignment._aligned(np.array([0, len(raw)]), raw, encoded, labels)
        assert figures["n_a"][0] == len(a.encode(" " + text).ids) and figures["n_b"][0] == len(b.encode(text))
        if len(text) < 1000:
            assert groups[0] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(text, a, b)[2])
    with pytest.raises(FileNotFoundError):
        align(spark.createDataFrame([], "doc_id long, text string"), pieces="/nowhere.model")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), min_size=1, max_size=4))
def test_leaves_are_the_intervals_between_neighbouring_shared_ends(docs):
    size = 61
    ends = [[d * size + e for d, pair in enumerate(docs) for e in sorted({*pair[k], size})] for k in (0, 1)]
    cuts = [np.cumsum([0] + [len({*pair[k], size}) for pair in docs]) for k in (0, 1)]
    a, b = split_at_shared_cuts(*map(np.array, ends), *cuts)
    common = sorted(set(ends[0]) & set(ends[1]))
    assert a.tolist() == [0] + [ends[0].index(e) + 1 for e in common[:-1]]
    assert b.tolist() == [0] + [ends[1].index(e) + 1 for e in common[:-1]]


def test_long_stretches_without_a_shared_end_are_one_leaf():
    n = 100_000
    a, b = np.append(np.arange(1, n) * 2, 2 * n), np.append(np.arange(1, n) * 2 - 1, 2 * n)
    assert [x.tolist() for x in split_at_shared_cuts(a, b, np.array([0, n]), np.array([0, n]))] == [[0], [0]]
    a[n // 3] = b[n // 3] = 2 * (n // 3) + 1
    assert split_at_shared_cuts(a, b, np.array([0, n]), np.array([0, n]))[0].tolist() == [0, n // 3 + 1]
