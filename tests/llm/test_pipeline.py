"""The pipeline against a brute-force version of its stages, and the queries' registration."""

import re
from collections import Counter

import pytest

from .test_documents import best_leak, frame, prose, shingle_set, words_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(12)
    text = lambda n: "\n".join(prose(15, rng).capitalize() + "." for _ in range(n))
    item = prose(30, rng)
    rows = [(k, text(rng.randrange(4, 9)), rng.choice(["a", "b", None])) for k in range(40)]
    rows += [(100 + k, rows[k][1], "b") for k in range(8)]
    rows += [(200, rows[20][1].replace(".", " ", 1), "a"), (201, "short", "a"), (202, None, "b"), (203, "| a | b |" * 40, "a"), (204, text(4) + "\n" + item + ".", "b"), (205, text(5) + "\ntoken = abcdef123456 here.", "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = (before, docs.collect())
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda part: sorted(r.doc_id for r in part)
    assert not {201, 202, 203} & set(ids(seen["quality"][1])) and {204, 205, *range(40)} <= set(ids(seen["quality"][1]))
    before, after = seen["near_dedup"]
    keep = []
    for r in sorted(before, key=lambda r: r.doc_id):
        s = shingle_set(r.text)
        if not any(100 * len(s & o) >= 75 * len(s | o) for o in keep):
            keep.append(s)
    assert len(after) == len(keep) and not {100, 101, 200} & set(ids(after))
    before, after = seen["decontamination"]
    assert ids(after) == sorted(r.doc_id for r in before if best_leak(r.text, item) < 0.75) and 204 not in ids(after)
    before, after = seen["secrets"]
    assert ids(before) == ids(after)
    changed = {r.doc_id: r for r in after}
    assert "[SECRET]" in changed[205].text and not re.search("abcdef123456", changed[205].text) and changed[205].n_chars == len(changed[205].text)
    assert all(changed[r.doc_id].text == r.text for r in before if r.doc_id != 205)
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and all(r.copies in (1, 2) for r in after)
    taken = sum(r.copies * len(words_of(r.text)) for r in after)
    # sentences have 15 words, so a source's nearest sum can be 7.5 off
    assert abs(taken - 1.5 * sum(len(words_of(r.text)) for r in before)) <= 3 * 7.5
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in whole) == Counter((r.doc_id, r.text, r.copies) for r in after)


def test_empty_tables_null_ids_and_more_columns(spark, tmp_path):
    import random

    rng = random.Random(3)
    text = lambda: "\n".join(prose(15, rng).capitalize() + "." for _ in range(5))
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
    rows = [(k, text(), "a") for k in range(6)] + [(None, text(), None), (None, text(), "b"), (7, None, "a")]
    more = ["row", "blob", "spans", "_t", "key", "component", "keys", "size", "mark", "copies"]
    docs = frame(spark, rows).selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(more)])
    docs.write.parquet(str(tmp_path / "more" / "documents.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "more" / "benchmark.parquet"))
    kept = corpus_pipeline.run(spark, str(tmp_path / "more"))
    assert sorted(kept.columns) == sorted(docs.columns)
    got = kept.collect()
    assert {r.text for r in got} <= {t for _, t, _ in rows} and None in {r.doc_id for r in got} and 7 not in {r.doc_id for r in got}
    assert all(tuple(r[n] for n in more[:-1]) == tuple(range(9)) and r.copies in (1, 2) for r in got)


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
