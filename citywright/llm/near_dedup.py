"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hot_keys import join_split
from .scratch import stored
from .words import mix64, runs, shingle_sets

#: Production parameters. A pair at exactly 0.75 shares none of 40 bands of 5 with probability 2e-5.
BANDS, ROWS = 40, 5
PERCENT = 75
#: Rounds in which each bucket is compared with one of its members, before the rest is searched by rare shingles.
PIVOT_ROUNDS = 2

_FIRST = np.array([0x7FEB352D, 0x846CA68B], dtype=np.uint32)
_SECOND = np.array([0x9E3779B1, 0x85EBCA6B], dtype=np.uint32)


def _permute_once(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 2**32 shingle positions, which breaks up any order in them."""
    x = x ^ (x >> np.uint32(16))
    x *= _FIRST[0]
    x ^= x >> np.uint32(15)
    x *= _FIRST[1]
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least ``p(s(i) - k mod 2**32)`` over a set's positions i.

    ``s`` and ``p`` are two fixed permutations; only the circular shift k differs between coordinates.
    Empty sets are not allowed here.
    """
    x = _permute_once(np.concatenate(sets).astype(np.uint32))
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    y, t = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        np.subtract(x, np.uint32(k), out=y)
        np.right_shift(y, np.uint32(16), out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, _SECOND[0], out=y)
        np.right_shift(y, np.uint32(13), out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, _SECOND[1], out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of the key."""
    salt = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    mixed = mix64((sig.astype(np.uint64) + np.uint64(1)) * salt)
    return mix64(mixed.reshape(len(sig), bands, rows).sum(axis=2, dtype=np.uint64)).view(np.int64)


def _features(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in runs(batch.column(1)):
                sets = shingle_sets(words)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys = np.zeros((0, bands), dtype=np.int64)
                if full:
                    keys = band_keys(signatures([sets[k] for k in full], bands * rows), bands, rows)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ends = np.cumsum(np.where(sizes > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "keys"],
                )

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, np.ndarray] | None = None
        for batch in batches:
            u, v, left, right = (batch.column(k) for k in range(4))
            keep = []
            for first, _, words in runs(right):
                for k, b in enumerate(shingle_sets(words), first):
                    text = left[k].as_py()
                    if known is None or known[0] != text:
                        known = (text, shingle_sets(next(runs(pa.array([text])))[2])[0])
                    a = known[1]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (u, v), those whose full shingle sets are similar enough."""
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("right"))
    # a pivot stands in many pairs, on either side; what is dealt out by u then is known before the texts are
    hubs = pairs.groupBy("u").agg(F.count("*").alias("n"))
    both = join_split(join_split(pairs, right, "v"), left, "u", hubs).select("u", "v", "left", "right")
    return both.mapInArrow(_verified(percent), "u long, v long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in runs(batch.column(2)):
            sets = shingle_sets(words)
            ends = np.cumsum([0, *map(len, sets)])
            hashes = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes))], names=["node", "component", "shingles"])


def _by_rare_shingles(nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) of ``nodes`` in different components that can be similar enough, by prefix and position.

    Each set is put in order of how rare its shingles are among ``nodes``. Two sets that share enough share one among
    their first size - least overlap + 1 shingles, and what stands behind it in both leaves room for the overlap. So
    texts that have only a common passage meet at none of their rare shingles, and sets that differ by
    too much of their own wording meet nobody. None that is similar enough is lost.

    A shared shingle that stands late in both orders, behind (1 - t) / (1 + t) of each set for a threshold t, leaves too little room for
    the overlap whatever the sizes are. So late ones are joined with early ones only: pages of one template, whose common shingles
    all stand behind each page's own, are not compared with each other.
    """
    held = texts.join(nodes, "node").select("node", "component", "text")
    sets = stored(held.mapInArrow(_sets, "node long, component long, shingles array<long>").select("*", F.size("shingles").alias("n"), F.xxhash64("shingles").alias("version")), "sets")
    spread = sets.select("node", "component", "version", "n", F.explode("shingles").alias("s"))
    often = stored(spread.groupBy("s").agg(F.count("*").alias("often")), "often")
    own = join_split(spread, often.where("often > 1"), "s", often.select("s", F.col("often").alias("n")), "left").groupBy("node", "component", "version", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "s"))).alias("order"))
    first = F.slice("order", 1, F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + 1)
    prefix = own.select("node", "component", "n", F.posexplode(first).alias("at", "x")).where("x.often > 1").select("node", "component", "n", "at", F.col("x.s").alias("s"))
    prefix = stored(prefix.withColumn("early", (100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")), "prefixes")
    other = prefix.where("early").select("s", F.col("node").alias("v"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("at").alias("to"))
    least = percent * (F.col("n") + F.col("m"))
    room = 1 + F.least(F.col("n") - 1 - F.col("at"), F.col("m") - 1 - F.col("to"))
    # two early ones meet from both sides, of which one is enough
    once = (F.col("node") < F.col("v")) | (~F.col("early") & (F.col("node") != F.col("v")))
    fits = once & (F.col("component") != F.col("c")) & ((100 + percent) * room >= least)
    met = prefix.alias("p").join(other, (F.col("p.s") == other["s"]) & fits)
    return met.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    A document's set is its distinct 5-word shingles. Two documents are linked if 100 * intersection >=
    ``percent`` * union, counted on the full sets; component_id is the smallest doc_id that links reach.
    Candidates are documents that share one of the bands of their signatures.

    Exact copies of a set are one class and are never compared. In a bucket, one member (the pivot) is compared
    with all the others, so a bucket of n gives n - 1 pairs. Where that leaves a bucket in several
    components, other pivots follow; in the buckets still split then, documents of different components are paired
    by their rarest shingles. So no group's pairs are all made, and no link between unequal texts is dropped.

    Null and empty texts, and those of white space only, have size 0 and are linked with nothing. A row with
    a null doc_id keeps a null component_id and is kept. Rows that repeat a doc_id are versions of one document:
    each gets the component of its own text. Other columns of ``docs`` are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = stored(source.mapInArrow(_features(bands, rows), "doc_id long, n_shingles long, digest binary, keys array<long>"), "minhash")
    sized = made.where("n_shingles > 0 and doc_id is not null")
    classes = stored(sized.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n")), "classes")
    # a node that repeated rows give several versions has sets of several sizes, from n0 to n
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"), F.min("n").alias("n0"))
    chosen = sized.select("digest", F.col("doc_id").alias("node"), "keys").join(classes.select("digest", "node"), ["digest", "node"], "left_semi").join(sizes, "node")
    spread = stored(chosen.select("node", "n", "n0", "keys"), "chosen").select("node", "n", "n0", F.explode("keys").alias("key"))
    pivots = spread.groupBy("key").agg(F.min(F.struct("node", "n", "n0")).alias("pivot"), F.max("node").alias("last"), F.count("*").alias("held"))
    pivots = stored(pivots.where("pivot.node < last").select("key", "pivot", "held"), "pivots")
    members = stored(join_split(spread, pivots.select("key", "pivot"), "key", pivots.select("key", F.col("held").alias("n"))), "buckets")

    wanted = members.select("node").distinct()
    texts = stored(source.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi"), "texts")
    near_in_size = (100 * F.col("n") >= percent * F.col("pivot.n0")) & (100 * F.col("pivot.n") >= percent * F.col("n0"))

    pairs = members.where((F.col("node") != F.col("pivot.node")) & near_in_size).select(F.col("pivot.node").alias("u"), F.col("node").alias("v"))
    pairs = stored(pairs.distinct(), "pairs")
    found = stored(_links(pairs, texts, percent), "links")
    tried = [pairs]
    for turn in range(1, PIVOT_ROUNDS + 1):
        labels = components(found)
        labelled = members.select("key", "node", "n", "n0").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # another pivot in each bucket, so that a document meets as many different ones as it has buckets
        by = F.xxhash64("key", "node", F.lit(turn))
        split = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by(F.struct("node", "n", "n0", "component"), by).alias("pivot"), F.count("*").alias("held"))
        split = stored(split.where("lo < hi").select("key", "pivot", "held"), "split-buckets")
        open_ = stored(join_split(labelled, split.select("key", "pivot"), "key", split.select("key", F.col("held").alias("n"))), "open-buckets")
        if open_.isEmpty():
            break
        members = open_
        if turn < PIVOT_ROUNDS:
            apart = (F.col("component") != F.col("pivot.component")) & near_in_size
            pairs = open_.where(apart).select(F.least("node", F.col("pivot.node")).alias("u"), F.greatest("node", F.col("pivot.node")).alias("v"))
        else:
            pairs = _by_rare_shingles(open_.select("node", "component").distinct(), texts, percent)
        pairs = pairs.distinct()
        for old in tried:
            pairs = pairs.join(old, ["u", "v"], "left_anti")
        pairs = stored(pairs, "pairs")
        tried.append(pairs)
        found = stored(found.unionByName(_links(pairs, texts, percent)), "links")
    else:
        labels = components(found)

    of_class = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    grouped = made.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return grouped.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group left, its columns unchanged.

    Rows that repeat a kept doc_id are one document and one of them stays. Rows without a doc_id stay.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    one = docs.join(kept.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType)), id_col, "left_semi").select(*docs.columns)
    return one.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
