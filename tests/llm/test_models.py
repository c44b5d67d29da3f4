"""Toxicity, language model and page extraction: held-out accuracy, exact base figures, and small pages."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from citywright.llm import html_content, lm_scoring, toxicity
from citywright.llm.html_content import extract_text, main_text
from citywright.llm.queries import op4_toxicity, op6_lm_scoring
from citywright.llm.words import runs

VOCABULARY = ["".join(random.Random(k).choices("etaoinshrdlu", k=2 + k % 7)) for k in range(300)]
BAD = ["blorkface", "snargle", "vexwit"]


def documents(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        w = rng.choices(VOCABULARY, k=rng.randrange(10, 120))
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                word = rng.choice(BAD)
                w.insert(rng.randrange(len(w)), word if rng.random() < 0.7 else word[:-1] + rng.choice("xyz"))
        docs.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark, tmp_path):
    docs, labels = documents()
    extra = [(1000, None), (1001, ""), (1002, " \n "), (0, docs[0][1]), (1003, "vexwiy " + "the " * 30_000)]
    spark.createDataFrame(docs + extra, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (5000, 1), (1000, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = op4_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = dict(labels)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(pairs) > 0.95
    empty = {r.score for r in rows if r.doc_id in (1000, 1001, 1002)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert len({r.score for r in rows if r.doc_id == 0}) == 1


def test_toxicity_of_empty_tables_and_clashing_names(spark):
    docs, labels = documents(80)
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labelled)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).isEmpty()
    assert toxicity.fit(spark.createDataFrame([], "doc_id long, text string"), labelled).slope == 0
    clashing = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS y", "3 AS bytes", "4 AS toxic", "5 AS score")
    again = toxicity.fit(clashing.unionByName(clashing), labelled)
    # repeated rows are learned from once
    assert np.array_equal(again.odds, model.odds)
    assert {r.doc_id: r.score for r in toxicity.score(clashing, again).collect()} == {r.doc_id: r.score for r in toxicity.score(clashing, model).collect()}
    few = toxicity.fit(clashing, labelled, bytes_a_class=2000)
    assert few.slope and not np.array_equal(few.odds, model.odds)


def test_toxicity_takes_characters():
    run = next(runs(pa.array(["né né", "aé語🙂", ""]), size=1 << 20))[2]
    codes, begins, stops = toxicity.characters(run)
    assert (stops - begins).tolist() == [2, 2, 4] and len(set(codes.tolist())) == 6
    # one other letter changes as many n-grams whether it takes a byte or more
    bucket = lambda t: set(toxicity.gram_buckets(r := next(runs(pa.array([t])))[2], np.arange(len(r.hashes)))[0].tolist())
    assert len(bucket("snargle") & bucket("snérgle")) == len(bucket("snargle") & bucket("snorgle"))


def test_toxicity_scores_equal_a_plain_pass(spark):
    docs, labels = documents(120)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.doc_id: round(r.score, 6) for r in toxicity.score(frame, model).collect()}.keys() == dict(docs).keys()
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i, text in docs:
        words = text.split()
        odds = []
        for word in words:
            run = next(runs(pa.array([word])))[2]
            odds.append(float(model.odds[toxicity.gram_buckets(run, np.array([0]))[0]].mean()))
        spans = [(a, min(a + toxicity.WINDOW, len(words))) for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)]
        best = max(np.mean(odds[a:b]) for a, b in spans)
        assert math.isclose(got[i], 1 / (1 + math.exp(-(model.slope * best + model.offset))), rel_tol=1e-4, abs_tol=1e-6)


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    only = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(docs, only).first().score > 0.99


def test_windows_cover_every_word():
    counts = np.array([0, 1, 16, 17, 100, 0])
    a, b, owner = toxicity.windows(counts)
    first = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        seen = {p for x, y, o in zip(a, b, owner, strict=True) if o == k for p in range(x, y)}
        assert seen == set(range(first[k], first[k] + n))


def words_of(text):
    return [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").split(" ") if w]


def test_lm_base_figures_and_gain(spark, tmp_path):
    rng = random.Random(5)
    one, two = VOCABULARY[:100], VOCABULARY[100:200]
    texts = [(k, " ".join(rng.choices(one if k % 2 else two, k=rng.randrange(20, 80)))) for k in range(600)]
    texts += [(900, None), (901, ""), (902, "Neverseen wörd"), (1, texts[1][1])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    train = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*words_of(t), None])
    total, kinds = sum(train.values()), len(train)
    rows = op6_lm_scoring(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        tokens = [*words_of(dict(texts)[r.doc_id]), None]
        base = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in train for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model(shared=30):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(VOCABULARY[:60], k=rng.randrange(1, 90))) for _ in range(40)]
    run = next(runs(pa.array(texts), size=1 << 22))[2]
    kinds, counts = np.unique(np.append(run.hashes, np.repeat(lm_scoring.END, 40)), return_counts=True)
    order = np.lexsort((kinds, -counts))[:shared]
    vocabulary = lm_scoring.Vocabulary.of(kinds[order], counts[order], int(counts.sum()), len(kinds))
    at, end = vocabulary.find(run)
    return vocabulary, lm_scoring.batch_of(vocabulary, run, at, int(end[0])), run


def test_probabilities_add_up():
    vocabulary, batch, _ = small_model()
    net = lm_scoring.Network(vocabulary)
    lm_scoring.Trainer(net).learn(batch)
    h = np.random.default_rng(0).normal(size=(1, lm_scoring.HIDDEN)).astype(np.float32)
    logs = [net.log_probs(h, vocabulary.group[k : k + 1], vocabulary.inner[k : k + 1])[0][0] for k in range(len(vocabulary.words))]
    rare = net.log_probs(h, np.array([lm_scoring.OWN_CLASSES + lm_scoring.BANDS - 1]), np.zeros(1))[0][0]
    groups = {*vocabulary.group.tolist(), lm_scoring.OWN_CLASSES + lm_scoring.BANDS - 1}
    logits = (h @ net.p["c"] + net.p["cb"])[0].astype(np.float64)
    used = np.exp(logits - logits.max())
    used /= used.sum()
    assert math.isclose(sum(map(math.exp, [*logs, rare])), sum(used[g] for g in groups), rel_tol=1e-4)


def test_batching_does_not_change_scores():
    vocabulary, batch, run = small_model()
    net = lm_scoring.Network(vocabulary)
    lm_scoring.Trainer(net).learn(batch)
    whole = lm_scoring.score_batch(net, batch)
    for d in range(0, 40, 7):
        a, b = batch.firsts[d], batch.firsts[d + 1]
        alone = lm_scoring.Batch(batch.token[a:b], batch.group[a:b], batch.inner[a:b], np.array([0, b - a]))
        assert math.isclose(lm_scoring.score_batch(net, alone)[0], whole[d], rel_tol=1e-4)
    assert len(lm_scoring.joined([batch, batch]).firsts) == 81


def test_scores_equal_a_plain_forward_pass():
    vocabulary, batch, _ = small_model()
    net = lm_scoring.Network(vocabulary)
    lm_scoring.Trainer(net).learn(batch)
    x, u, c, cb, w, wb = (net.p[k].astype(np.float64) for k in ("x", "u", "c", "cb", "w", "wb"))
    n, whole = lm_scoring.HIDDEN, lm_scoring.score_batch(net, batch)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    log_softmax = lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    for d in range(len(batch.firsts) - 1):
        h, before, total = np.zeros(n), lm_scoring.START, 0.0
        for t in range(batch.firsts[d], batch.firsts[d + 1]):
            a, g = x[before], h @ u
            z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n : 2 * n] + g[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :])
            k = batch.group[t]
            total += log_softmax(h @ c + cb)[k]
            if k < vocabulary.classes:
                lo, hi = vocabulary.edges[k], vocabulary.edges[k + 1]
                total += log_softmax(h @ w[:, lo:hi] + wb[lo:hi])[int(batch.inner[t]) - lo] if hi - lo > 1 else 0.0
            else:
                total += batch.inner[t]
            before = batch.token[t]
        assert math.isclose(total, whole[d], rel_tol=1e-3), d


def test_lm_on_empty_long_and_held_out_tables(spark):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string"
    assert lm_scoring.score_texts(spark.createDataFrame([], schema)).isEmpty()
    docs = spark.createDataFrame([(1, "a b " * 60_000), (2, "a"), (None, None), (2, "a")], schema).selectExpr("*", "1 AS row", "2 AS word", "3 AS held_out", "4 AS c", "5 AS logs")
    rows = {r.doc_id: r for r in lm_scoring.score_texts(docs).collect()}
    assert rows[1].n_tokens == 120_001 and rows[1].train_tokens == 120_006 and rows[None].n_tokens == 1
    # a text of two words in turn is soon known by heart
    assert all(math.isfinite(r.score) for r in rows.values()) and rows[1].score > rows[1].base_score
    none = {r.doc_id: r for r in lm_scoring.score_texts(docs, F.lit(True)).collect()}
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none.values())
    assert math.isclose(none[2].base_score, 2 * math.log10(0.5 / 0.5)) and math.isfinite(none[2].score)


def test_every_training_document_is_learned_from(spark):
    vocabulary, _, _ = small_model()
    fresh = lm_scoring.Network(vocabulary).flat
    for doc_id in (None, 0, 1, 2):
        one = spark.createDataFrame([(doc_id, " ".join(VOCABULARY[:40]))], "doc_id long, text string")
        assert not np.array_equal(lm_scoring.train(one, vocabulary), fresh), doc_id


def test_learned_words_grow_with_the_corpus():
    own = []
    for n in (500, 2_000, 20_000):
        counts = np.repeat([400, 1], [n, n])
        vocabulary = lm_scoring.Vocabulary.of(np.arange(2 * n, dtype=np.uint64), counts, int(counts.sum()), 2 * n)
        own.append(int((vocabulary.group < vocabulary.classes).sum()))
        assert vocabulary.classes ** 2 >= own[-1] - 2 * vocabulary.classes
        net = lm_scoring.Network(vocabulary)
        at = np.arange(len(vocabulary.words))
        logs = net.log_probs(np.zeros((len(at), lm_scoring.HIDDEN), dtype=np.float32), vocabulary.group[at], vocabulary.inner[at])[0]
        assert math.isclose(math.exp(logs[0]), (vocabulary.counts[0] + 0.5) / (vocabulary.total + 0.5 * (2 * n + 1)), rel_tol=1e-3)
    assert own == [1_000, 2_000, 20_000]


def test_weights_are_averaged_in_lots_of_bounded_size(spark, monkeypatch):
    """Ten thousand tasks' weights: the mean is exact, and no task gets more than a lot at a time."""
    n, lot = 10_000, lm_scoring.LOT
    plain = lm_scoring._averaged

    def watched(parts):
        if len(parts) > lot:
            raise AssertionError(len(parts))
        return plain(parts)

    monkeypatch.setattr(lm_scoring, "_averaged", watched)
    rows = spark.range(n).selectExpr("id % 2 AS slice", "id DIV 2 AS lot", "id AS tokens")

    def filled(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                weights = np.full(4, batch.column("tokens")[k].as_py() % 7, dtype=np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("slice").slice(k, 1), batch.column("lot").slice(k, 1), pa.array([weights.tobytes()]), batch.column("tokens").slice(k, 1)], names=["slice", "lot", "weights", "tokens"])

    parts = rows.mapInArrow(filled, "slice long, lot long, weights binary, tokens long")
    got = {r.slice: (np.frombuffer(r.weights, dtype=np.float32), r.tokens) for r in lm_scoring.averaged(parts, n // 2).collect()}
    for s in (0, 1):
        ids = np.arange(s, n, 2)
        assert np.allclose(got[s][0], (ids % 7 * ids).sum() / ids.sum(), rtol=1e-5) and got[s][1] == ids.sum()


def test_gradients_equal_differences():
    vocabulary, batch, _ = small_model()
    net = lm_scoring.Network(vocabulary)
    docs = np.argsort(-np.diff(batch.firsts), kind="stable")[:5]
    open_, tokens, place, there = next(lm_scoring._windows(batch, docs))
    h = np.zeros((open_, lm_scoring.HIDDEN), dtype=np.float32)

    def loss():
        states, _ = net.states(tokens, h)
        return -net.log_probs(states[there], batch.group[place[there]], batch.inner[place[there]])[0].sum()

    grads = {k: np.zeros(s, dtype=np.float32) for k, s in net.shapes.items()}
    states, kept = net.states(tokens, h, keep=True)
    _, back = net.log_probs(states[there], batch.group[place[there]], batch.inner[place[there]], grads)
    full = np.zeros_like(states)
    full[there] = back
    net.through_time(tokens, kept, full, grads)
    for name, at in (("u", (3, 7)), ("u", (0, 40)), ("c", (2, 5)), ("cb", (1,)), ("x", (int(tokens[1, 0]), 20)), ("w", (4, 9)), ("wb", (9,))):
        value = net.p[name][at]
        net.p[name][at] = value + 1e-2
        up = loss()
        net.p[name][at] = value - 1e-2
        down = loss()
        net.p[name][at] = value
        assert math.isclose((up - down) / 2e-2, float(grads[name][at]), rel_tol=0.05, abs_tol=0.02), name


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p>One <b>two</b><br>three<p>Four&nbsp;five <script>var x = "</p>";</script></p><div class="comments"><p>Reader says</p></div><form><input>F</form></article><footer>&copy; foot</footer></body></html>"""


def test_one_page():
    assert main_text(PAGE, []) == "Head & tail\nOne two three\nFour five"
    assert main_text("", []) == "" and main_text("plain <b>text", []) == "plain text"
    assert main_text("<p>a < b</p><!-- no <p>x</p> --><p>" + "w " * 50_000, []) == "a < b\n" + ("w " * 50_000).strip()


def test_attributes_are_whole_names():
    for attribute in ('style="overflow:hidden"', 'aria-hidden="false"', "data-hidden", 'data-role="menu"', 'title="role=menu hidden"', 'class="content with-sidebar"', 'class="no-sidebar"', 'class="entry-header"'):
        assert main_text(f"<div {attribute}><p>Article</p></div>", []) == "Article", attribute
    for attribute in ("hidden", 'HIDDEN=""', 'aria-hidden="true"', "role=menu", 'class="left sidebar"', "id='comments'", 'class="cookie-banner"'):
        assert main_text(f"<div {attribute}><p>Other</p></div><p>Article</p>", []) == "Article", attribute


def test_wrapper_drops_what_is_constant(spark):
    body = lambda k: f"<html><body><div class='top'>Same on all pages</div><div class='text'><p>Story {k} begins.</p><p>It ends {k * 7}.</p></div><div>Contact us today</div></body></html>"
    rows = [(k, f"http://site.example/{k}", body(k)) for k in range(15)] + [(50, "https://other.example/x", body(50)), (51, None, None), (52, "not a url", ""), (0, "http://site.example/0", body(0))]
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    story = lambda k: f"Story {k} begins.\nIt ends {k * 7}."
    want = Counter({(k, f"http://site.example/{k}", story(k), len(story(k))): 1 + (k == 0) for k in range(15)})
    alone = "Same on all pages\n" + story(50) + "\nContact us today"
    want.update({(50, "https://other.example/x", alone, len(alone)): 1, (51, None, "", 0): 1, (52, "not a url", "", 0): 1})
    assert got == want
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_constant_siblings_and_ids_of_each_page(spark):
    extra = lambda k: "".join(f"<p>More {k} {j}.</p>" for j in range(k % 3))
    body = lambda k: f"<div id='post-{k}' class='c{k}'><div><p>Constant notice</p></div><div><p>Read this first</p><p>Story {k}.</p>{extra(k)}<p>Call us now</p></div></div>"
    rows = [(k, f"http://one.example/{k}", body(k)) for k in range(12)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join([f"Story {k}.", *(f"More {k} {j}." for j in range(k % 3))]) for k in range(12)}


PAGES = "page_id long, url string, html string"


def texts_of(spark, rows):
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}


def largest(a, b, x, y):
    """Size of the largest alignment of two trees, over all choices of children."""
    if a.tag[x] != b.tag[y]:
        return 0

    def rows(mine, yours):
        if not mine or not yours:
            return 0
        return max(rows(mine[1:], yours), rows(mine, yours[1:]), largest(a, b, mine[0], yours[0]) + rows(mine[1:], yours[1:]))

    return 1 + rows(a.kids[x], b.kids[y])


def test_alignment_is_the_largest():
    rng = random.Random(7)

    def tree():
        n = rng.randrange(2, 9)
        parent = [-1] + [rng.randrange(k) for k in range(1, n)]
        # page order: children of later elements come later
        order = sorted(range(1, n), key=lambda k: (parent[k], k))
        del order
        return html_content.Tree(parent, ["root"] + rng.choices("abc", k=n - 1), [""] * n, [rng.randrange(3) for _ in range(n)])

    for _ in range(400):
        a, b = tree(), tree()
        found = html_content.align(a, b)
        pairs = [(x, y) for y, x in enumerate(found) if x >= 0]
        assert len(pairs) == largest(a, b, 0, 0) and len({x for x, _ in pairs}) == len(pairs)
        for x, y in pairs:
            assert a.tag[x] == b.tag[y] and (y == 0 or found[b.parent[y]] == a.parent[x])
        # siblings keep their order, and ties go to equal texts
        assert all((x < u) == (y < v) for x, y in pairs for u, v in pairs if y and v and b.parent[y] == b.parent[v] and (x, y) != (u, v))
    parse = lambda h: html_content.parse(h)[0]
    one, two = parse("<p>a</p><p>b</p>"), parse("<p>b</p>")
    assert html_content.align(one, two) == [0, 2]


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 5000 + "Down here" + "</div>" * 5000
    rows = [(k, "http://deep.example/", deep.replace("here", f"here {k}")) for k in range(3)] + [(9, "http://broken.example/", "</div><p>One<div></p>two</span><ul><li>three<li>four</table>&amp;&#x41;<")]
    assert texts_of(spark, rows) == {0: "Down here 0", 1: "Down here 1", 2: "Down here 2", 9: "One\ntwo\nthree\nfour&A<"}


def test_forms_around_articles():
    assert main_text("<form id=f><nav>Menu</nav><article><p>Real text.</p></article></form>", []) == "Real text."
    assert main_text("<form><div><p>Most of the page is in here.</p></div></form><p>Short</p>", []) == "Most of the page is in here.\nShort"
    assert main_text("<p>Some article text.</p><form>Your name</form>", []) == "Some article text."
    assert main_text("<article><div class='tags'>Kept</div><div class='social'>Kept too</div></article>", []) == "Kept\nKept too"


def test_two_pages_are_enough(spark):
    page = lambda k: f"<body><div><div>Shop {k}</div></div><section><h2>Title {k}</h2><p>{'Long story. ' * (5 + k)}</p></section><div>Call {k}</div></body>"
    story = lambda k: f"Title {k}\n" + ("Long story. " * (5 + k)).strip()
    assert texts_of(spark, [(k, "http://two.example/", page(k)) for k in range(2)]) == {k: story(k) for k in range(2)}
    # equal pages show nothing of what varies
    assert texts_of(spark, [(k, "http://one.example/", page(1)) for k in range(2)]) == {k: f"Shop 1\n{story(1)}\nCall 1" for k in range(2)}


def test_layouts_have_references_of_their_own(spark):
    one = lambda k: f"<body><div>Top {k % 2}</div><div class='a'><p>Story {k} {'x ' * 40}</p></div></body>"
    two = lambda k: f"<body><table><tr><td>Side {k % 2}<td><p>Tale {k} {'y ' * 40}</p><p>More {k}</table></body>"
    rows = [(k, "http://both.example/", (one if k % 2 else two)(k)) for k in range(20)] + [(99, "http://both.example/", ""), (98, "http://both.example/", "<div></div>")]
    got = texts_of(spark, [(i, u, h) for i, u, h in rows])
    assert got[99] == got[98] == ""
    for k in range(20):
        assert got[k] == (f"Story {k} {'x ' * 40}".strip() if k % 2 else f"Tale {k} {'y ' * 40}".strip() + f"\nMore {k}")


def test_wrapper_decides_without_names(spark):
    """Menus, adverts and footers of the test pages fall away by alignment alone; with names, the text is the article's."""
    import json
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = pages.select("page_id", "url", "html").withColumn("host", html_content.host_of(pages.url))
    made = {r.host: [html_content.Template(html_content.Tree(*t["tree"]), t["nodes"]) for t in json.loads(r.wrapper)] for r in html_content.induce_wrappers(source).collect()}
    rows = source.collect()
    size = Counter(r.host for r in rows)
    apart = [r for r in rows if size[r.host] > 1]
    alone = sum(main_text(r.html, made[r.host], marks=False) == main_text("<article>" + re.search("<article>(.*)</article>", r.html, re.S)[1] + "</article>", []) for r in apart)
    assert len(apart) > 200 and alone / len(apart) >= 0.9
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert all(got[r.page_id] == main_text("<article>" + re.search("<article>(.*)</article>", r.html, re.S)[1] + "</article>", []) for r in rows)


def test_pages_with_clashing_names(spark):
    rows = [(k, f"http://h.example/{k}", f"<p>Text {k}</p>") for k in range(4)]
    docs = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS text", "4 AS mark", "5 AS layout")
    assert {r.page_id: r.text for r in extract_text(docs).collect()} == {k: f"Text {k}" for k in range(4)}
