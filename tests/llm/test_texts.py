import time
from dataclasses import replace

import numpy as np
import pytest

from textpairs.llm import decontaminate, html_extract, masked_lm
from textpairs.llm.dom import Forest, parse
from textpairs.llm.queries import op2_masked_lm, op6_decontaminate, op9_html


# ------------------------------------------------------------------ decontamination

def test_op6_finds_every_verbatim_item(spark, docs, small_dir):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text").collect()]
    flat = {i: " ".join(t.lower().split()) for i, t in bench}
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in flat.items() if t in " ".join(r.text.lower().split())}
    got = {(r.doc_id, r.item_id) for r in op6_decontaminate(spark, small_dir).collect()}
    assert want and got == want


ITEM = "Anna buys 12 apples at the market and gives 3 of them to Ben, how many apples does Anna keep for the 5 km walk home"
SWAPPED = "Carla buys 40 apples at the market and gives 9 of them to Dan, how many apples does Carla keep for the 7 km walk home"
INCONSISTENT = "Carla buys 40 apples at the market and gives 9 of them to Dan, how many apples does Emil keep for the 7 km walk home"


def test_templates_catch_other_parameters(spark, odd, none):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "12 13 14 15 16")], "item_id long, text string")
    texts = ["before it " + ITEM + " and after", "so " + SWAPPED + " there", "a text of its own about apples at the market", None, "they were too short for it"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "before it " + ITEM + " and after", "x"), (None, ITEM, "y")],
                                 "doc_id long, text string, item string")
    got = {(r.id, r.item) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1), (1, 1), (4, 4), (None, 1)}
    clean = decontaminate.remove_contaminated(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3] and clean.columns == docs.columns
    assert decontaminate.remove_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.contaminated(none.select("doc_id", "text"), bench).count() == 0


def test_other_letter_case_is_found(spark, small_dir):
    """Every item of the table, all small, all capitals and in title case, inside another text."""
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet").select("item_id", "text")
    items = bench.collect()
    docs, want = [], set()
    for k, change in enumerate((str.lower, str.upper, str.title)):
        for r in items:
            docs.append((1000 * k + r.item_id, "Before it " + change(r.text) + " and after it."))
            want.add((1000 * k + r.item_id, r.item_id))
    got = {(r.id, r.item) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert want <= got


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, SWAPPED), (2, INCONSISTENT)], "doc_id long, text string")
    runs = {r.id: r.run_words for r in decontaminate.contaminated(docs, bench, min_words=5, min_share=0.2).collect()}
    assert runs[1] == len(ITEM.split()) > runs[2]


def test_windows_of_few_literal_words(spark):
    dense = "Anna Maria Kowalski paid 12 euros, Ben Luc Moreau paid 15 euros and Eva Ruiz paid 9 euros."
    middle = "the old man said that Anna Maria Kowalski Ben Luc Moreau Eva Ruiz would come home soon"
    names = "Anna Maria Kowalski Ben Luc Moreau Eva Ruiz Carla Emil Dan Tom Ina Olga Pia"
    bench = spark.createDataFrame([(1, dense), (2, middle), (3, names), (4, "12 13 14 15 16"), (5, "Paris")], "item_id long, text string")
    other = dense.replace("Anna", "Carla").replace("Moreau", "Dupont").replace("12", "40")
    mixed = dense.replace("Ben Luc", "Zed Zed")  # one name for two
    swapped = middle.replace("Anna Maria Kowalski", "Tom Jan Novak")
    many = " ".join(f"Name{k}" for k in range(40)) + " 12 13 14 15 16 Paris"
    texts = [dense, other, mixed, middle, swapped, names, many, "we read " + dense + " twice", "so " + names + " came", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.id, r.item): r.run_words for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 1): 18, (1, 1): 18, (3, 2): 17, (4, 2): 17, (5, 3): 15, (7, 1): 18, (8, 3): 15}


def test_consistent_run_by_hand():
    assert decontaminate.consistent_run([(0, ["a"], ["x"]), (1, ["a"], ["x"]), (3, [], [])], 4) == 5
    assert decontaminate.consistent_run([(0, ["a"], ["x"]), (1, ["a"], ["y"])], 4) == 4
    assert decontaminate.consistent_run([(0, ["a", "b"], ["x", "x"])], 4) == 0


# ------------------------------------------------------------------ extraction

def brute_marginals(tree, model):
    """Enumerate all labelings of a small forest."""
    n = len(tree.parent)
    unary = np.bincount(tree.node, weights=model.unary[tree.feature], minlength=n)
    weight = np.zeros(n)
    total = 0.0
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        energy = sum(unary[i] * y[i] for i in range(n)) + sum(model.pair[tree.kind[i], y[tree.parent[i]], y[i]] for i in range(n) if tree.parent[i] >= 0)
        total += np.exp(energy)
        weight += np.exp(energy) * np.array(y)
    return weight / total, np.log(total)


def test_sum_product_is_exact():
    forest = Forest()
    parse(forest, 0, "<div class=nav>a<p>b, c.</div><article><h1>t</h1><p>long text here.</p></article>")
    parse(forest, 1, "x<ul><li>y</ul>")
    tree = html_extract.arrays(forest)
    rng = np.random.default_rng(4)
    model = html_extract.TreeModel(rng.standard_normal(len(html_extract.FEATURES)), rng.standard_normal((2, 2, 2)))
    got, _, log_total = html_extract.marginals(tree, model)
    want, log_want = brute_marginals(tree, model)
    assert np.allclose(got, want) and np.isclose(log_total, log_want)


def test_held_out_labelled_pages():
    forest, labels = html_extract.labelled_forest(fills=4, seed=123)
    content, _, _ = html_extract.marginals(html_extract.arrays(forest), html_extract.default_model())
    runs = np.array([t == "#run" for t in forest.tag])
    assert ((content >= 0.5) == (labels == 1))[runs].mean() > 0.95


def test_page_parts(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
    <!-- ad --><div class="ad">Buy now.</div><article><h1>A &amp; B &lt;3</h1><p><b>First   para<br>graph&nbsp;one.<p>Second, with a <a href=x>link</a> in it.
    <script>var t="</p>";</script><ul><li>Item one here</li><li>Item two here</li></ul></article><div id="comments"><p>Great post, thanks a lot!</p></div>
    <form><p>Your name</p><button>Send</button></form><aside><p>Related things</p></aside><footer>&copy; 2020 Someone &middot; All rights.</footer></body></html>"""
    assert html_extract.extract_many([page, "", "<"], html_extract.default_model())[0] == (
        "A & B <3\n\nFirst para graph one.\n\nSecond, with a link in it.\n\nItem one here\n\nItem two here")


def test_op9(spark, small_dir):
    import html
    import re
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in op9_html(spark, small_dir).collect()}
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        r = got[p.page_id]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == p.url


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<<<>>"), (4, "<p>" * 3000 + "deep"), (5, "<div>" * 3000 + "deep"), (6, "<script>never closed <p>x"),
            (7, "<a href=\"x>y"), (8, "plain " * 50_000), (8, "plain " * 50_000), (None, "&#0;&bogus;&amp")]
    df = spark.createDataFrame([(i, h, "t", 1) for i, h in rows], "page_id long, html string, text string, parent int")
    out = html_extract.extract(df).collect()
    assert len(out) == len(rows) and all(r.text is not None for r in out)
    assert [r.text for r in out if r.page_id in (1, 2, 6)] == ["", "", ""]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_parser_is_linear_in_unclosed_tags():
    for piece in ("<svg>", "<div>", "</p>", "<iframe><p>"):
        took = []
        for n in (20_000, 40_000):
            forest, began = Forest(), time.perf_counter()
            parse(forest, 0, piece * n + ("<div>" * 2000 + "</p>" * n if piece == "</p>" else ""))
            took.append(time.perf_counter() - began)
        assert took[1] < 6


# ------------------------------------------------------------------ masked language model

def test_training_raises_held_out_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 4 <> 0"), docs.filter("doc_id % 4 = 0")
    start = masked_lm.initial_model(masked_lm.word_counts(train))
    trained = masked_lm.fit(train)

    def mean(model):
        rows = masked_lm.score(test, model).select("n_tokens", "log_likelihood").toPandas()
        return rows.log_likelihood.sum() / rows.n_tokens.sum()

    assert mean(trained) > mean(start) + 0.05


def test_scores_are_brute_force(spark, docs, small_dir):
    got = {r.doc_id: r for r in op2_masked_lm(spark, small_dir).collect()}
    assert len(got) == docs.count()
    model = masked_lm.fit(docs)
    net, log_share = masked_lm.Network(model.matrix.astype(np.float64), model.n_symbols), model.log_share
    counts = {r.word: r.n for r in masked_lm.word_counts(docs).collect()}
    known = set(model.words)
    for r in docs.orderBy("doc_id").limit(20).collect():
        ids, total = model.ids(r.text), 0.0
        for t in range(len(ids)):
            around = [ids[t + k] if 0 <= t + k < len(ids) else model.n_symbols for k in (-2, -1, 1, 2)]
            hidden = np.tanh(np.concatenate([net.embedding[s] for s in around]) @ net.w1 + net.b1[0])
            z = hidden @ net.w2 + net.b2[0]
            total += z[model.class_of[ids[t]]] - np.log(np.exp(z).sum()) + log_share[ids[t]]
        total += sum(np.log(counts[w]) for w in masked_lm.tokens_of(r.text) if w not in known)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].log_likelihood == pytest.approx(total, rel=1e-5)


def test_every_word_has_its_own_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = {r.word: r.n for r in masked_lm.word_counts(docs).collect()}
    rare = sorted((w for w, n in counts.items() if n in (2, 3)), key=lambda w: (-counts[w], w))[:200]
    unseen = [f"{w}~{k}~" for k, w in enumerate(rare)]
    assert not set(unseen) & set(counts)
    some = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(30).collect()]
    own = spark.createDataFrame([*some, some[0], (-1, " ".join(rare)), (-2, " ".join(unseen)), (-3, None)], docs.schema)
    model = masked_lm.fit(docs)
    words = set(model.words)
    assert 0 < len(words) < len(counts) and not words & set(rare)
    got = masked_lm.score(own, model).collect()
    assert len(got) == len(some) + 4
    alone = {r.doc_id: r.log_likelihood for r in masked_lm.score(own, replace(model, tail=model.tail.limit(0))).collect()}
    texts = {r.doc_id: r.text or "" for r in own.collect()}
    for r in got:
        tail = sum(np.log(counts.get(w, 1)) for w in masked_lm.tokens_of(texts[r.doc_id]) if w not in words)
        assert r.log_likelihood == pytest.approx(alone[r.doc_id] + tail, rel=1e-6)
    mean = {r.doc_id: r.mean_log_likelihood for r in got}
    assert mean[-2] < mean[-1] < min(mean[i] for i, t in some if len(t.split()) > 20)
    # the shares of a hash symbol: its words and one count for all others
    other = {w: model.ids(w)[0] for w in counts if w not in words}
    mass = np.full(model.n_symbols, 1.0)
    for w, s in other.items():
        mass[s] += counts[w]
    mass[:len(words)] += [counts[w] for w in model.words]
    in_class = np.bincount(model.class_of, weights=mass)
    assert np.allclose(np.exp(model.log_share[len(words):]) * in_class[model.class_of[len(words):]], 1.0, rtol=1e-4)


def test_every_position_is_a_target_once():
    text = np.arange(1000)
    flat, at = masked_lm.padded([text[:0], text[:3], text[3:]], 5000)
    assert flat[at].tolist() == text.tolist() and (np.delete(flat, at) == 5000).all()
    assert all(flat[at[0] + k] == 5000 for k in (-1, -2)) and flat[at[2] + 1] == flat[at[3] - 2] == 5000
    # the rounds deal the positions of a text among them
    dealt = [np.random.default_rng(77).integers(0, masked_lm.ROUNDS, 1000, dtype=np.int8) == turn for turn in range(masked_lm.ROUNDS)]
    assert (np.sum(dealt, axis=0) == 1).all()


def test_classes_follow_contexts():
    rnd = np.random.default_rng(1)
    centres = rnd.standard_normal((4, masked_lm.DIM)) * 5
    points = np.repeat(centres, 50, axis=0) + rnd.standard_normal((200, masked_lm.DIM)) * 0.1
    of = masked_lm._clusters(points, np.ones(200), 4, 3)
    assert all(len(set(of[a:a + 50])) == 1 for a in range(0, 200, 50)) and len(set(of)) == 4


def test_gradient_step_by_finite_difference():
    rng = np.random.default_rng(1)
    symbols = 20
    shape = (masked_lm._rows_of(symbols), masked_lm.DIM)
    matrix = (rng.standard_normal(shape) * 0.1).astype(np.float64)
    context, target = rng.integers(0, symbols, (6, 2 * masked_lm.SIDE)), rng.integers(0, masked_lm.CLASSES, 6)

    def loss(m):
        z = masked_lm.Network(m, symbols).logits(context)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), target]))

    net = masked_lm.Network(matrix.copy(), symbols)
    net.step(context, target, 1e-3)
    assert loss(net.matrix) < loss(matrix)
    at = (int(context[0, 0]), 3)
    up, down = matrix.copy(), matrix.copy()
    up[at] += 1e-5
    down[at] -= 1e-5
    slope = (loss(up) - loss(down)) / 2e-5
    assert np.sign(matrix[at] - net.matrix[at]) == np.sign(slope)


def test_odd_rows_score(odd, none):
    model = masked_lm.fit(odd)
    rows = {(r.doc_id, r.text): r for r in masked_lm.score(odd, model).collect()}
    assert rows[1, None].n_tokens == 0 and rows[1, None].log_likelihood == 0 and rows[1, None].mean_log_likelihood is None
    assert all(r.log_likelihood <= 0 for r in rows.values())
    assert masked_lm.score(none, masked_lm.fit(none)).count() == 0
