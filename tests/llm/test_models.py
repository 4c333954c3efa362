from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from rillstream.llm import html_extract, language_id, toxicity
from rillstream.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# --- HTML

@pytest.fixture(scope="module")
def crf():
    return html_extract.trained()


def test_pages_of_unseen_layouts(crf):
    pages = html_extract.labelled_pages(150, seed=77)
    assert len(pages) > 140
    right = sum(crf.decode(b) == y for b, y in pages)
    assert right / len(pages) > 0.93


def test_the_main_text_of_a_page(crf):
    html = """<!DOCTYPE html><html><head><title>No</title><script>var t="<p>no</p>";</script><style>p{}</style></head><body>
    <header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <!-- <p>no</p> --><article><h1>Head &amp; line</h1><p>One<b>two</b>\n  three&nbsp;four.<p>Next par<br>agraph.<div class="ad">Buy now.</div><ul><li>Item &lt;1&gt;</li></ul></article>
    <section id="comments"><div class="comment"><p>I disagree with all of this.</p></div></section><aside class="sidebar"><p>Related things</p></aside>
    <form><label>Mail</label><input><button>Go</button></form><footer>&copy; Site</footer>"""
    assert html_extract.main_text(crf, html) == "Head & line Onetwo three four. Next par agraph. Item <1>"


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<a", "<!--", "<p", '<p class="', "</p></p>", "<script>", "<title>x", "a < b & c", "<p>" * 3000, "<div>" * 500 + "x", "\x00<p>\x00</p>"])
def test_broken_pages_do_not_crash(crf, html):
    assert isinstance(html_extract.main_text(crf, html), str)


ARTICLE = "<article><header><h1>Head line</h1></header><p>The first paragraph of it, long enough to be read.</p><p>And a second one, with more to say.</p></article>"
TEXT = "Head line The first paragraph of it, long enough to be read. And a second one, with more to say."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><body>{ARTICLE}</body>", f"<html><head><title>T</title><meta charset=x>{ARTICLE}", f"<title>T</title>{ARTICLE}", f"<!doctype html><head><style>p{{}}</style></head>{ARTICLE}",
    f"<head>{ARTICLE}<footer>&copy; Site</footer>", f"<body><noscript>{ARTICLE}", f"<body><svg><path>{ARTICLE}", f"<body><object><iframe>{ARTICLE}", f"<body><script>if (a </scripts>) '<p>no</p>'</script >{ARTICLE}",
])
def test_tags_may_be_left_out(crf, page):
    assert html_extract.main_text(crf, page) == TEXT


def test_deep_and_odd_pages_take_time_in_step_with_their_length(crf):
    import time

    def took(html):
        began = time.perf_counter()
        html_extract.main_text(crf, html)
        return time.perf_counter() - began

    took(ARTICLE)
    for unit in ("<div>x", "<div class='c'>x", "<b>x", "<p><b>", "<svg>x", "<ul><li>x", "<h2>x</h3>", "</p>x"):
        small, large = took(unit * 3000), took(unit * 24000)
        assert large < 24 * small + 0.5, unit  # 8 would be even, 64 quadratic


def test_paths_share_what_they_know():
    blocks = html_extract.leaf_blocks('<main class="story"><section id="a-b"><p>x<b>y</b></p></section></main><p>z')
    assert [(b.text, [e.entry for e in html_extract.chain(b.element)]) for b in blocks] == [("xy", ["main story", "section a b", "p"]), ("z", ["p"])]
    assert html_extract.path_features(blocks[0].element) == sorted(["leaf=p", "in=main", "in=section", "in=p", "word=story", "word=a", "word=b", "near=a", "near=b", "under=section"])
    assert html_extract.path_features(None) == ["leaf="]


def test_viterbi_finds_the_best_of_all_sequences(crf):
    from itertools import product

    np, r = toxicity.np, random.Random(2)
    for _ in range(60):
        field = html_extract.Field({}, np.zeros((0, 2)), np.array([[r.gauss(0, 2) for _ in range(2)] for _ in range(3)]))
        n = r.randint(1, 7)
        scores = np.array([[r.gauss(0, 2) for _ in range(2)] for _ in range(n)])
        field.scores = lambda blocks, scores=scores: scores
        m = field.moves
        best = max(product((0, 1), repeat=n), key=lambda y: m[2, y[0]] + sum(m[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(scores[k, v] for k, v in enumerate(y)))
        assert field.decode([None] * n) == list(best)


def test_gradient_equals_differences_and_sums_over_all_sequences():
    from itertools import product

    np, r = toxicity.np, np_random(5)
    for n in (1, 2, 5):
        e, t = r.normal(size=(n, 2)), r.normal(size=(3, 2))
        labels = r.integers(0, 2, n).tolist()

        def loss(e, t):
            def total(y):
                return t[2, y[0]] + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)) + sum(e[k, v] for k, v in enumerate(y))

            return np.log(sum(np.exp(total(y)) for y in product((0, 1), repeat=len(e)))) - total(labels)

        got, de, dt = html_extract.gradient(e, t, labels)
        assert abs(got - loss(e, t)) < 1e-9
        for x, d in ((e, de), (t, dt)):
            for at in np.ndindex(x.shape):
                step = np.zeros_like(x)
                step[at] = 1e-5
                high, low = (loss(e + s, t) if x is e else loss(e, t + s) for s in (step, -step))
                assert abs((high - low) / 2e-5 - d[at]) < 1e-6


def np_random(seed):
    return toxicity.np.random.default_rng(seed)


def test_articles_of_the_table(spark, crf):
    import re
    from html import unescape

    got = {r.page_id: r for r in QUERIES["op3_html_extract"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"</?(?:p|br|h1)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_pages_with_nulls_and_none(spark, crf):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "<article><p>Hello there, this is it.</p></article>", 6), (1, None, None, 5)], "page_id long, url string, html string, text int")
    rows = html_extract.extract(df, crf).collect()
    assert sorted(r.text for r in rows) == ["", "", "Hello there, this is it."]
    assert html_extract.extract(df.limit(0), crf).count() == 0


# --- languages

SCHEMA = "doc_id long, text string, lang string, score string, source string"


def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language_id"](spark, SF).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(held) > 150 and sum(held) / len(held) > 0.98


def test_filters_without_false_negatives():
    r = random.Random(1)
    texts = {"aa": ["abc abd abe"], "bb": ["xyz xyw"]}
    hashes = {k: __import__("numpy").concatenate([h for _, _, hs, _ in language_id.per_text(v) for h in hs]) for k, v in texts.items()}
    f = language_id.Filters.of(hashes, "aa")
    assert f.predict(["abc", "XYZ!", "", None, "123 ...", "qqqq", "abc abd xyz"]) [0] == ["aa", "bb", "und", "und", "und", "aa", "aa"]
    assert f.predict(["abc abd"])[1][0] > 0.99 and f.predict(["qqqq"])[1] == [0.0]
    many = [" ".join("".join(r.choices("abcxyz", k=3)) for _ in range(50)) for _ in range(20)]
    assert f.predict(many)[0] == [f.predict([t])[0][0] for t in many]  # texts do not touch each other


def slow_grams(text):
    c = " " + "".join(x if x.isalpha() else " " for x in text.lower())
    c = " ".join(c.split())
    c = f" {c} " if c else " "
    return [c[k : k + n] for n in (3, 4) for k in range(len(c) - n + 1) if " " not in c[k + 1 : k + n - 1]]


def test_popcounts_equal_sets_of_strings():
    r = random.Random(7)
    np = toxicity.np
    vocabularies = {f"l{k:02d}": ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(40)] for k in range(9)}
    learned = {k: " ".join(v) for k, v in vocabularies.items()}
    sets = {k: set(slow_grams(t)) for k, t in learned.items()}
    f = language_id.Filters.of({k: np.concatenate([h for _, _, hs, _ in language_id.per_text([t]) for h in hs]) for k, t in learned.items()}, "l00")
    texts = [" ".join(r.choices(vocabularies[r.choice(list(vocabularies))] + vocabularies["l03"], k=r.randint(1, 30))) + r.choice(["", " 12!", "É"]) for _ in range(150)]
    names, scores = f.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        grams = slow_grams(t)
        hits = {k: sum(g in own for g in grams) for k, own in sets.items()}
        assert hits[name] == max(hits.values()) and abs(score - hits[name] / len(grams)) < 0.01, t


def test_more_languages_than_a_word_has_bits(spark):
    r = random.Random(8)
    names = [f"x{k:03d}" for k in range(140)]
    words = {n: ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(30)] for n in names}
    rows = [(i, " ".join(r.choices(words[n], k=25)), n, "", "") for i, n in enumerate(names * 3)]
    f = language_id.fit(spark.createDataFrame(rows[:280], SCHEMA))
    assert f.languages == names and f.slots.shape[0] == 3
    found = f.predict([t for _, t, _, _, _ in rows[280:]])
    assert found[0] == [n for _, _, n, _, _ in rows[280:]] and min(found[1]) > 0.5


def test_languages_with_strange_rows(spark):
    rows = [(i, "the cat sat on the mat again", "en", "", "") for i in range(5)] + [(9, "der hund sass auf der matte", "de", "", ""), (None, None, None, "", ""), (11, "", "en", "", ""), (12, "42 !", "en", "", ""), (13, "the cat " * 50_000, None, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    f = language_id.fit(df)
    got = {r.doc_id: r for r in language_id.predict(df, f).collect()}
    assert got[9].lang_pred == "de" and got[13].lang_pred == "en" and got[None].lang_pred == got[11].lang_pred == got[12].lang_pred == "und"
    assert {r.doc_id for r in language_id.recognised(df, f).collect()} == {0, 1, 2, 3, 4, 9, 13}
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}
    assert language_id.recognised(df, none).count() == 7 and language_id.predict(df.limit(0), f).count() == 0


# --- toxicity

def made(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("etaoinsr", k=r.randint(2, 7))) for _ in range(2000)]
    rows = []
    for i in range(n):
        ws, bad = r.choices(words, k=r.randint(5, 80)), r.random() < 0.3
        for _ in range(r.randint(1, 3) if bad else 0):
            ws.insert(r.randrange(len(ws)), "zukwab" + r.choice(["", "le", "on", "ish,"]))
        rows.append((i, " ".join(ws), int(bad)))
    return rows


def test_held_out_accuracy_of_toxicity(spark):
    rows = made(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert sum(held) / len(held) > 0.97
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert toxicity.Scorer(again).scores(["zukwab here"]) == toxicity.Scorer(model).scores(["zukwab here"])
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "word " * 100_000 + "zukwab", 3)], "doc_id long, text string, score int")
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert scores[0] == scores[1] < toxicity.THRESHOLD <= scores[2]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.score(docs, model).collect()} == {want}


def test_toxicity_learns_from_long_texts(spark):
    rows = made(120)
    tail = " ".join(t for _, t, y in made(400, 2) if not y)[:21_000]
    docs = spark.createDataFrame([(i, f"{t} {tail}") for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    scores = toxicity.Scorer(model).scores([f"{t} {tail}" for _, t, _ in made(60, 3)])
    right = [(s >= toxicity.THRESHOLD) == bool(y) for s, (_, _, y) in zip(scores, made(60, 3), strict=True)]
    assert sum(right) / len(right) > 0.9


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """More labels of either kind than were once drawn: all are counted, in each model but its fold's, and held against."""
    np = toxicity.np
    rows = [(i, f"{'zukwab ' * (i % 3 == 0)}a{i}", int(i % 3 == 0)) for i in range(9000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    for name, value in (("SHARD_ROWS", 1000), ("EPOCHS", 1), ("STEPS", 0)):
        monkeypatch.setattr(toxicity, name, value)
    kept, best = [], []
    own_train, own_shifts = toxicity.Folds.train, toxicity.Folds.shifts
    monkeypatch.setattr(toxicity.Folds, "train", lambda f: kept.append(f) or own_train(f))
    monkeypatch.setattr(toxicity.Folds, "shifts", lambda f, models: best.append((f.logits(models).collect(), own_shifts(f, models))) or best[0][1])
    model = toxicity.fit(docs, labels)
    folds, (told, shifts) = kept[0], best[0]
    assert folds.folds == 2 and folds.shards == 5
    assert sum(sum(folds.seen(k).values()) for k in range(2)) == 9000
    assert len(told) == 9000 and sum(r.y for r in told) == 3000
    z, y = np.array([r.z for r in told]), np.array([r.y for r in told])
    cut = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)) - shifts[""]
    f1 = [2 * y[z >= c].sum() / ((z >= c).sum() + y.sum()) for c in (cut, *np.quantile(z, np.linspace(0, 1, 400)))]
    assert max(f1) == f1[0] and model.shifts == shifts
    scores = toxicity.Scorer(model).scores(["zukwab b", "b c"])
    assert scores[1] < toxicity.THRESHOLD <= scores[0]


def test_joined_models_and_averages():
    np = toxicity.np
    rows = made(300)
    y, group = np.array([y for _, _, y in rows]), np.array([""] * 300)
    texts = [t for _, t, _ in rows]
    models = [toxicity.train(texts[a::2], y[a::2], group[a::2], seed=a) for a in (0, 1)]
    one, two = (toxicity.Scorer(m).logits(texts) for m in models)
    assert np.abs(toxicity.Scorer(toxicity.joined(models)).logits(texts) - (one + two) / 2).max() < 1e-3
    own = toxicity.Texts(*toxicity.Texts.numbered(texts))
    assert np.abs(own.logits(models[0], np.arange(300)) - one).max() < 1e-3


def test_best_shift_equals_all_thresholds_tried():
    np, r = toxicity.np, np_random(6)
    for n in (1, 2, 9, 60):
        z, y = np.round(r.normal(size=n), 1), r.integers(0, 2, n)
        y[0] = 1
        cut = np.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)) - toxicity.best_shift(z, y)
        f1 = [2 * y[z >= c].sum() / ((z >= c).sum() + y.sum()) for c in (cut, *z)]
        assert f1[0] == max(f1)


def test_scores_equal_the_convolution_written_out():
    np, r = toxicity.np, np_random(3)
    m = toxicity.Model(
        r.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), r.normal(size=(toxicity.DIM, toxicity.OFFSETS * toxicity.FILTERS)).astype(np.float32),
        r.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), r.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), 0.3,
    )
    texts = ["", None, "one", "two words", "a few more words, and a tail!", "again and again " * 30, "x" * 200 + " y"]
    for text, z in zip(texts, toxicity.Scorer(m).logits(texts), strict=True):
        vecs = []
        for w in toxicity.words(text):
            flat, _ = toxicity.bucket_lists([w.strip(toxicity.STRIP)])
            vecs.append(m.emb[flat].mean(0))
        want, col, f = m.base, 0, toxicity.FILTERS
        for k, width in enumerate(toxicity.WIDTHS):
            for j in range(f):
                sums = [sum(float(vecs[i + o] @ m.conv[:, (col + o) * f + j]) for o in range(width)) for i in range(len(vecs) - width + 1)]
                want += float(m.out[k * f + j]) * max([0.0, *[s + float(m.bias[k * f + j]) for s in sums]])
            col += width
        assert abs(z - want) < 1e-3, text


def test_words_share_buckets_with_their_stems():
    flat, starts = toxicity.bucket_lists(["zukwab", "zukwabish", "", "a"])
    lists = [set(flat[a:b].tolist()) for a, b in zip(starts, [*starts[1:], len(flat)], strict=True)]
    assert len(lists[0] & lists[1]) >= 5 and all(lists)


def test_long_words_count_to_their_end():
    r = random.Random(4)
    for n in (64, 65, 112, 113, 700):
        w = "".join(r.choices("etaoinsr", k=n))
        ps = toxicity.words(f"a {w} b")[1:-1]
        assert all(len(p) <= toxicity.LONGEST for p in ps) and len(ps) == 1 + max(0, -((64 - n) // 48))
        assert all(any(w[k : k + 16] in p for p in ps) for k in range(n - 15))
    rows = made(600)
    model = toxicity.train([t for _, t, _ in rows], toxicity.np.array([y for _, _, y in rows]), toxicity.np.array([""] * len(rows)))
    far = "".join(r.choices("etaoinsr", k=200))
    clean, toxic = toxicity.Scorer(model).scores([far + "etaoin" + far, far + "zukwab" + far])
    assert toxic > clean
    flat, starts = toxicity.bucket_lists(["zukwab", "a"])
    assert all((x == y).all() for x, y in zip((flat, starts), toxicity.chunked_lists(["zukwab", "a"], 1), strict=True))


def test_toxicity_of_the_table(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op10_toxicity"](spark, SF)
    assert got.count() == 1000 and got.where("predicted <> int(score >= 0.3) or score < 0 or score > 1").count() == 0
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
    seen = got.join(labels, "doc_id").where("held_out and toxic = 1")
    assert seen.agg(F.avg("predicted")).first()[0] > 0.4  # a few dozen examples to learn from
