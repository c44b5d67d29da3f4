"""Cross-tokenizer alignment: the smallest groups of tokens of two tokenizers that cover the same bytes, and how often ids are linked."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored
from .words import RUN_BYTES, text_buffers

#: Where the public vocabularies lie; every executor reads them, and they are never copied into the repository.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A task forgets the encoded chunks beyond this many. Results do not depend on it.
MOST_CHUNKS = 400_000
#: A table of so many distinct id pairs at most (16 bytes each) goes to all tasks; a larger one is joined with a shuffle.
MOST_PAIRS = 6_000_000

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 characters stand for their byte, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of every id, and whether texts may be encoded in chunks cut before single spaces."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        # a token of B has spaces at its front only, and A cuts words as byte-level tokenizers do: nothing spans a space before a word
        spec = json.loads(self.a.to_str())
        cutter = spec.get("pre_tokenizer") or {}
        self.chunked = (
            not any("▁" in p.lstrip("▁") for p in names)
            and spec.get("normalizer") is None
            and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space", False)
        )

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each chunk, all of which begin with a space; B adds its own, so it gets the rest."""
        return [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)], self.b.encode([c[1:] for c in chunks], num_threads=1)


def spaced(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts with a space put in front of each that is not empty."""
    full = offsets[1:] > offsets[:-1]
    return offsets + np.concatenate(([0], np.cumsum(full))), np.insert(data, offsets[:-1][full], 0x20)


def chunk_starts(offsets: np.ndarray, data: np.ndarray, chunked: bool) -> np.ndarray:
    """Where chunks begin: at texts, and at single spaces between two characters that are no white space in any alphabet."""
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    if not chunked or len(data) < 3:
        return starts
    # bytes that can belong to white space: controls, C2 80..A0, and the blocks of general punctuation and CJK symbols
    solid = (data > 0x20) & (data != 0x7F)
    follows = np.zeros(len(data), dtype=bool)
    follows[1:] = (data[:-1] == 0xC2) & (data[1:] <= 0xA0)
    second = np.zeros(len(data), dtype=bool)
    second[:-1] = ((data[:-1] == 0xE2) & ((data[1:] == 0x80) | (data[1:] == 0x81))) | ((data[:-1] == 0xE3) & (data[1:] == 0x80)) | ((data[:-1] == 0xE1) & ((data[1:] == 0x9A) | (data[1:] == 0xA0)))
    white = second | follows
    white[1:] |= second[:-1]
    white[2:] |= second[:-2]
    white[:-1] |= follows[1:]
    solid &= ~white
    begins = np.zeros(len(data), dtype=bool)
    begins[1:-1] = (data[1:-1] == 0x20) & solid[:-2] & solid[2:]
    begins[starts] = True
    return np.flatnonzero(begins)


class Encoded:
    """Ids of every chunk that a task has met, each encoded once, in two flat tables."""

    def __init__(self, tokenizers: Tokenizers):
        self.of = tokenizers
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.edges = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.exact = np.zeros(0, dtype=bool)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The row of each distinct chunk; chunks met for the first time are encoded."""
        if len(self.row) > MOST_CHUNKS:
            self._reset()
        new = [c for c in chunks if c not in self.row]
        if new:
            for c in new:
                self.row[c] = len(self.row)
            raw = [c.encode() for c in new]
            exact = np.ones(len(new), dtype=bool)
            for k, (ids, table, size) in enumerate(zip(self.of.encode(new), (self.of.a_bytes, self.of.b_bytes), (self.of.a_size, self.of.b_size), strict=True)):
                edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(edges[-1]))
                reach = np.concatenate(([0], np.cumsum(size[flat])))[edges]
                # all chunks at once, and one by one only if some differ
                same = np.array_equal(np.diff(reach), np.fromiter(map(len, raw), np.int64, len(raw))) and b"".join([table[i] for i in flat.tolist()]) == b"".join(raw)
                if not same:
                    exact &= np.fromiter((b"".join([table[i] for i in one]) == r for one, r in zip(ids, raw, strict=True)), bool, len(new))
                self.ids[k] = np.concatenate((self.ids[k], flat))
                self.edges[k] = np.concatenate((self.edges[k], self.edges[k][-1] + edges[1:]))
            self.exact = np.concatenate((self.exact, exact))
        return np.fromiter((self.row[c] for c in chunks), np.int64, len(chunks))

    def tokens(self, side: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these chunks one after the other, number of tokens of each chunk)."""
        first = self.edges[side][rows]
        sizes = self.edges[side][rows + 1] - first
        return self.ids[side][_ranges(first, sizes)], sizes


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... sizes[0] of them, then first[1], ..."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def split_at_shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first A token, first B token) of every leaf group, in order, by divide and conquer.

    ``a_ends`` and ``b_ends`` are where tokens end, rising; ``a_cuts`` and ``b_cuts`` (one more than there are texts) are the numbers of tokens
    before each text. Every text is an interval at first. In an interval, A's ends are tried from the middle outwards, each looked up in B
    by bisection, in steps that double; the nearest one that B shares cuts the interval into two halves, which are treated alike.
    An interval without such an end is a leaf. All intervals of one depth are treated together.
    """
    lo, hi, b_lo, b_hi = a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:]
    leaves_a, leaves_b = [], []
    while len(lo):
        middle, cut = (lo + hi - 1) // 2, np.full(len(lo), -1)
        trying = np.flatnonzero((hi - lo > 1) & (b_hi - b_lo > 1))
        b_cut = np.searchsorted(b_ends, a_ends[middle])
        hit = b_ends[b_cut[trying]] == a_ends[middle[trying]]
        cut[trying[hit]] = middle[trying[hit]]
        trying, near, width = trying[~hit], 1, 2
        while len(trying):
            left = np.maximum(lo[trying], middle[trying] - near - width + 1)
            right = np.minimum(hi[trying] - 2, middle[trying] + near + width - 1)
            n_left = np.maximum(middle[trying] - near - left + 1, 0)
            n_right = np.maximum(right - (middle[trying] + near) + 1, 0)
            many = n_left + n_right
            at = np.empty(int(many.sum()), dtype=np.int64)
            begin = np.cumsum(many) - many
            at[_ranges(begin, n_left)] = _ranges(left, n_left)
            at[_ranges(begin + n_left, n_right)] = _ranges(middle[trying] + near, n_right)
            found = np.searchsorted(b_ends, a_ends[at])
            shared = b_ends[found] == a_ends[at]
            owner = np.repeat(np.arange(len(trying)), many)[shared]
            at, found = at[shared], found[shared]
            # of an interval's shared ends the one nearest to the middle, the left one of two
            order = np.lexsort((at, np.abs(at - middle[trying][owner]), owner))
            owner, first = np.unique(owner[order], return_index=True)
            cut[trying[owner]], b_cut[trying[owner]] = at[order][first], found[order][first]
            near, width = near + width, width * 2
            open_ = cut[trying] < 0
            open_ &= (middle[trying] - near >= lo[trying]) | (middle[trying] + near <= hi[trying] - 2)
            trying = trying[open_]
        leaf = cut < 0
        leaves_a.append(lo[leaf])
        leaves_b.append(b_lo[leaf])
        go = ~leaf
        # both halves side by side, so that intervals stay in order
        lo, hi = np.stack((lo[go], cut[go] + 1), axis=1).ravel(), np.stack((cut[go] + 1, hi[go]), axis=1).ravel()
        b_lo, b_hi = np.stack((b_lo[go], b_cut[go] + 1), axis=1).ravel(), np.stack((b_cut[go] + 1, b_hi[go]), axis=1).ravel()
    a = np.concatenate(leaves_a) if leaves_a else np.zeros(0, np.int64)
    b = np.concatenate(leaves_b) if leaves_b else np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _group_texts(a_ids: np.ndarray, b_ids: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, edges: np.ndarray, labels: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text; ``edges`` are the numbers of tokens of both kinds before each text."""
    n, m = len(a_ids), len(b_ids)
    a_stop, b_stop = np.append(a_first[1:], n), np.append(b_first[1:], m)
    codes = np.empty(n + m, dtype=np.int64)
    # A's separators are "," and "|", B's are "," and ";"
    a_code, b_code = a_ids.astype(np.int64) * 3, b_ids.astype(np.int64) * 3
    a_code[a_stop - 1] += 1
    b_code[b_stop - 1] += 2
    codes[np.arange(n) + np.repeat(b_first, a_stop - a_first)] = a_code
    codes[np.arange(m) + np.repeat(a_stop, b_stop - b_first)] = b_code
    parts = labels[codes].tolist()
    return ["".join(parts[a:b])[:-1] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all pairs whose byte ranges overlap, in order."""
    first = np.searchsorted(b_ends, np.concatenate(([0], a_ends[:-1])), side="right")
    last = np.searchsorted(b_ends, a_ends)
    return np.repeat(np.arange(len(a_ends)), last - first + 1), _ranges(first, last - first + 1)


def _aligned(offsets: np.ndarray, data: np.ndarray, encoded: Encoded, labels: np.ndarray) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(figures by name, groups' texts, first link pair of each text, distinct id pairs of each text, links of each pair)."""
    of, docs = encoded.of, len(offsets) - 1
    offsets, data = spaced(offsets, data)
    starts = chunk_starts(offsets, data, of.chunked)
    edges = np.append(starts, len(data)).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    rows = encoded.rows(texts.dictionary.to_pylist())[texts.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    bad = np.zeros(docs, dtype=bool)
    for d in np.unique(doc[~encoded.exact[rows]]) if len(rows) else ():
        # chunks that differ from their text could still add up to the whole text
        whole, own = data[offsets[d] : offsets[d + 1]].tobytes(), rows[slice(*np.searchsorted(doc, [d, d + 1]))]
        bad[d] = any(b"".join([table[i] for i in encoded.tokens(k, own)[0]]) != whole for k, table in enumerate((of.a_bytes, of.b_bytes)))
    rows, doc = rows[~bad[doc]], doc[~bad[doc]]
    (a_ids, a_many), (b_ids, b_many) = encoded.tokens(0, rows), encoded.tokens(1, rows)
    n_a, n_b = (np.bincount(doc, many, docs).astype(np.int64) for many in (a_many, b_many))
    a_cuts, b_cuts = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
    a_ends, b_ends = np.cumsum(of.a_size[a_ids]), np.cumsum(of.b_size[b_ids])
    full = n_a > 0
    cuts = [np.append(c[:-1][full], c[-1]) for c in (a_cuts, b_cuts)]
    a_first, b_first = split_at_shared_cuts(a_ends, b_ends, *cuts)
    groups = _group_texts(a_ids, b_ids, a_first, b_first, a_cuts + b_cuts, labels)
    n_groups = np.diff(np.searchsorted(a_first, a_cuts))
    a_at, b_at = _links(a_ends, b_ends)
    owner = np.searchsorted(a_cuts, a_at, side="right") - 1
    # text, A's id and B's id in one number: no run has enough texts for that to overflow
    each, links = np.unique((owner * len(of.a_bytes) + a_ids[a_at]) * len(of.b_bytes) + b_ids[b_at], return_counts=True)
    each, pair_b = np.divmod(each, len(of.b_bytes))
    owner_of, pair_a = np.divmod(each, len(of.a_bytes))
    figures = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(owner, minlength=docs)}
    return figures, groups, np.searchsorted(owner_of, np.arange(docs + 1)), (pair_a << 32) | pair_b, links


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, pair_links) for each row of ``docs``, without a shuffle.

    A is a byte-level tokenizer (a file of the ``tokenizers`` library) that encodes a space and the text, B a sentencepiece model that adds the
    space itself; special tokens in a text are plain text. ``groups`` reads ``a1,a2|b1;a3|b2,b3``: the smallest groups of ids between byte
    offsets at which tokens of both end. ``pairs`` (A's id * 2^32 + B's id) are the text's distinct id pairs whose tokens overlap, ``pair_links`` how many
    times each. Null and empty texts have no tokens, nor have those whose tokens' bytes, joined, are not the space and the text.
    Repeated rows get a row each, other columns are ignored, and an empty table gives an empty one. Texts are worked on whole.

    Both tokenizers cut a text before a single space between two characters that are not white space, so each distinct chunk between
    such spaces is encoded once a task; other vocabularies get whole texts.
    """
    for path in (byte_level, pieces):
        if not os.path.isfile(path):
            raise FileNotFoundError(f"no tokenizer file at {path}")
    names = ["doc_id", *COUNTS, "groups", "pairs", "pair_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = Encoded(Tokenizers(byte_level, pieces))
        largest = max(len(encoded.of.a_bytes), len(encoded.of.b_bytes))
        labels = np.array([f"{k}{mark}" for k in range(largest) for mark in ",|;"], dtype=object)
        for batch in batches:
            offsets, data = text_buffers(batch.column(1))
            at, n = 0, batch.num_rows
            while at < n:
                to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1))
                figures, groups, first, pairs, links = _aligned(offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]], encoded, labels)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (pairs, links)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(figures[c].astype(np.int64)) for c in COUNTS], pa.array(groups, pa.string()), *lists], names=names)
                at = to

    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups string, pairs array<long>, pair_links array<long>"
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, columns)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): the links of each id pair over all texts, and whether no other A id has more with its B id (ties included)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.pair_links").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("links"))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    # one row for each id of B: its vocabulary bounds what is broadcast
    tops = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("links").alias("top")))
    return counts.withColumn("b", b).join(tops, "b").select("pair", "links", (F.col("links") == F.col("top")).alias("best"))


def link_figures(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``aligned`` without its pairs, with n_best (links whose pair is its B id's most frequent, ties included) and count_sum (over links).

    The texts are stored once, so nothing is encoded twice. Up to ``most_pairs`` distinct pairs go to all tasks as a sorted table; more are joined by pair.
    """
    spark = aligned.sparkSession
    aligned = stored(aligned, "alignments")
    counts = stored(pair_counts(aligned), "pair-counts")
    kept = [c for c in aligned.columns if c not in ("pairs", "pair_links")]
    if counts.count() > most_pairs:
        rows = stored(aligned.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.pair_links").alias("n"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
        return rows.join(sums, "row", "left").select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])
    table = counts.toArrow()
    pair, links, best = (table.column(c).to_numpy() for c in ("pair", "links", "best"))
    order = np.argsort(pair)
    # a pair's links and whether it is best in one number
    shared = spark.sparkContext.broadcast((pair[order], (links[order] << 1) | best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in batches:
            lists, many = batch.column("pairs"), batch.column("pair_links")
            edges = lists.offsets.to_numpy().astype(np.int64)
            n = many.values.to_numpy()[edges[0] : edges[-1]]
            found = values[np.searchsorted(keys, lists.values.to_numpy()[edges[0] : edges[-1]])] if len(n) else np.zeros(0, np.int64)
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (n * (found & 1), n * (found >> 1))]
            spans = edges - edges[0]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(s[spans[1:]] - s[spans[:-1]]) for s in sums]], names=[*kept, "n_best", "count_sum"])

    schema = T.StructType([*[aligned.schema[c] for c in kept], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return aligned.mapInArrow(run, schema)
