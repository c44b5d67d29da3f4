"""Token counts of a unigram tokenizer, by dynamic programming over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import runs

#: Where the public vocabularies lie; read by the driver only and never copied into the repository.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A task's trie starts anew beyond this many nodes. Counts do not depend on it.
MOST_NODES = 500_000
BEGIN = "▁"


def unigram_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by rank, the n-th piece having a weight of 1 / (n + 1): Zipf's law, normalised."""
    total = math.log(sum(1 / (n + 1) for n in range(len(pieces))))
    return {p: -math.log(n + 1) - total for n, p in enumerate(pieces)}


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a sentencepiece model, most frequent first (no control, byte or unknown pieces)."""
    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"no sentencepiece model at {path}; pass the path of one as vocabulary")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]


class Trie:
    """Distinct pre-tokens with the best segmentation of every prefix, each computed once.

    A node stands for a prefix. It holds the greatest log probability of a segmentation of it, and that one's number
    of tokens (the fewest where scores tie). A character that no piece covers is one token for each UTF-8 byte.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self._reset()

    def _reset(self) -> None:
        # one flat table for all nodes: node and character in one number
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def tokens(self, word: str) -> int:
        """Tokens of one pre-token; the nodes that earlier ones made are used again."""
        if len(self.best) > MOST_NODES:
            self._reset()
        word = BEGIN + word
        node, path, child, best, count, scores = 0, [0], self.child, self.best, self.count, self.scores
        for end, char in enumerate(word, 1):
            edge = node * 0x110000 + ord(char)
            after = child.get(edge)
            if after is None:
                after = len(best)
                size = len(char.encode("utf-8", "surrogatepass"))
                top, few = best[path[end - 1]] + size * self.byte, count[path[end - 1]] + size
                for start in range(max(0, end - self.longest), end):
                    score = scores.get(word[start:end])
                    if score is not None:
                        p = path[start]
                        total, n = best[p] + score, count[p] + 1
                        if total > top or (total == top and n < few):
                            top, few = total, n
                child[edge] = after
                best.append(top)
                count.append(few)
            node = after
            path.append(node)
        return count[node]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs``, over its whole text and without a shuffle.

    Pre-tokens are the words between ASCII white space, each with a word-begin mark in front; each is segmented by the unigram model
    of ``unigram_scores``. A task segments every distinct pre-token of a run of documents once, through a trie that lives as
    long as the task, and adds up the stored counts. Null, empty and wordless texts have 0 tokens. Repeated rows get a row each; other columns are ignored.
    """
    scores = docs.sparkSession.sparkContext.broadcast(unigram_scores(read_pieces(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores.value)
        known: dict[int, int] = {}
        for batch in batches:
            for a, b, words in runs(batch.column(1), lower=False):
                total = np.zeros(b - a, dtype=np.int64)
                if len(words.hashes):
                    kinds, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
                    raw = words.data.tobytes()
                    if len(known) > MOST_NODES:
                        known.clear()
                    size = np.empty(len(kinds), dtype=np.int64)
                    for k, h in enumerate(kinds.tolist()):
                        n = known.get(h)
                        if n is None:
                            at = first[k]
                            n = known[h] = trie.tokens(raw[words.starts[at] : words.ends[at]].decode("utf-8", "replace"))
                        size[k] = n
                    full = np.flatnonzero(words.counts)
                    total[full] = np.add.reduceat(size[number], words.firsts[:-1][full])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
