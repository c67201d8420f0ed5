"""Model scores over slices, quality verdicts, kernels of landmarks, pages of several templates, and the pipeline as a whole."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wellspring.llm import langid, logbloom, pages, quality, queries


def test_model_score_is_the_sum_over_slices_with_rare_words(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(vocabulary[min(int(rng.expovariate(0.25)), 29)] for _ in range(rng.randrange(30)))) for i in range(60)] + [(900, None), (901, "new words")]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in docs], "doc_id long, text string, id string, vid int, score double")
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    kept = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    train, pairs = Counter(w for t in kept for w in tok(t)), Counter(p for t in kept for p in zip([b"\n", *tok(t)], tok(t)))
    n, v = sum(train.values()), len(train)
    about = lambda c: float(logbloom.count_of(logbloom.level_of(np.array(c)))) if c else 0.0
    for hot in (1 << 22, 5):
        powers, held, least = Counter(c.bit_length() - 1 for c in train.values()), 0, 0
        for p in sorted(powers, reverse=True):
            if held + powers[p] > hot:
                least = 1 << (p + 1)
                break
            held += powers[p]
        assert (least > 1) == (hot == 5)
        count = lambda w: train[w] if train[w] >= least else about(train[w])  # noqa: E731, B023
        for r in logbloom.score_texts(df, hot_words=hot, max_filter_bytes=1 << 16, bits_per_byte=400.0).collect():
            w = tok(dict(docs)[r.doc_id])
            each = [(min(about(pairs[a, b]), count(b)) + 50 * (count(b) + 0.1) / (n + 0.1 * (v + 1))) / (count(a) + 50) for a, b in zip([b"\n", *w], w)]
            assert math.isclose(r.score, sum(map(math.log10, each)), rel_tol=1e-9), r.doc_id


def test_more_slices_than_numbers_raise(spark):
    df = spark.createDataFrame([(i, "a b c d e f g h " * 40) for i in range(40)], "doc_id long, text string")
    with pytest.raises(ValueError, match="slices"):
        logbloom.score_texts(df, max_filter_bytes=1 << 16, bits_per_byte=1e9)


def test_kept_is_the_posterior_of_the_votes(spark):
    """Votes from the rules' text in Python, the posterior by Bayes' rule over the fitted table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    def vote(f, rule):
        value, bad, good = (x.replace("v between 3.5 and 9", "3.5 <= v <= 9") for x in rule)
        v = eval(value, {"greatest": max}, f)
        return -1 if eval(bad, {}, {**f, "v": v}) else 1 if eval(good, {}, {**f, "v": v}) else 0

    names = [x.split()[0] for x in quality.FEATURES.split(", ")]
    feats = {i: dict(zip(names, quality.text_features(t or ""))) for i, t in rows.items()}
    votes = {i: tuple(vote(f, r) if f["n_words"] else 0 for r in quality.RULES.values()) for i, f in feats.items()}
    seen = Counter(votes[i] for i in rows if feats[i]["n_words"])
    patterns = sorted(seen)
    share, table = quality.fit_label_model(np.array(patterns), np.array([seen[p] for p in patterns]))
    got = {r["doc_id"]: r for r in queries.op10_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(rows)
    for i, f in feats.items():
        p = share * np.array([math.prod(table[c, j, x + 1] for j, x in enumerate(votes[i]) if x) for c in range(len(share))])
        good = p[0] / p.sum() if f["n_words"] else 0.0
        failed = f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"]
        assert got[i]["base_failed"] == failed and got[i]["quality"] == pytest.approx(good, abs=1e-6)
        assert got[i]["kept"] == (not failed and good >= 0.5)


def test_sparse_kernels_equal_sets_and_both_forms_of_the_scorer_agree():
    rng = np.random.default_rng(4)
    bags = [np.unique(rng.integers(0, 400, rng.integers(1, 90))) for _ in range(20)]
    marks = langid.Landmarks(bags)
    for g in [*bags[:5], np.array([5000]), np.empty(0, np.int64)]:
        want = [len(np.intersect1d(g, b)) / math.sqrt(max(len(g), 1) * len(b)) for b in bags]
        assert marks.kernel(g) == pytest.approx(want)
    w, bias = rng.normal(size=(20, 3)), rng.normal(size=3)
    one, other = langid.Scorer(marks, w, bias, list("abc")), langid.Scorer(marks, w, bias, list("abc"), most_bytes=0)
    assert one.vocabulary is not None and other.vocabulary is None
    assert one.project(bags) == pytest.approx(other.project(bags), abs=1e-5)


def test_every_language_is_learned_under_tight_bounds(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüßçñøåαβγδεζηθικλμ"
    rows = []
    for lang in range(30):
        own = rng.sample(letters, 8)
        rows += [(len(rows) + i, "".join(rng.choice(own + [" "]) for _ in range(120)), f"l{lang}") for i in range(40 if lang else 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scorer = langid.fit(df, most_landmarks=150, most_pairs=20_000, most_cells=100_000)
    assert len(scorer.langs) == 30
    got = langid.predict(df, scorer).join(df, "doc_id").select((F.col("lang_pred") == F.col("lang")).cast("double").alias("ok"), "lang").groupBy("lang").agg(F.avg("ok").alias("ok")).collect()
    assert len(got) == 30 and sum(r["ok"] for r in got) / 30 > 0.9 and min(r["ok"] for r in got) > 0.5


def page(kind, body):
    menu = '<nav><a href="/">Home</a> <a href="/x">News of the day</a></nav>'
    if kind == "blog":
        return f'<html><body>{menu}<div class="layout"><div class="post-body p17">{body}</div><div class="sidebar">Older posts and links</div></div><footer>All rights kept</footer></body></html>'
    return f'<html><body>{menu}<section class="docs"><div class="doc-text">{body}</div><div class="cookie-banner">We use cookies</div></section></body></html>'


def test_pages_of_a_host_with_two_templates(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        kind = "blog" if i % 3 else "docs"
        blocks = [" ".join(rng.choice(["alpha", "beta", "gamma", "x&amp;y", "delta"]) for _ in range(rng.randrange(8, 40))) + "." for _ in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{b}</p>\n" for b in blocks) + ('<p class="share-price">Shares rose by ten.</p><p>Let <math><mi>n</mi></math> be odd.</p>' if i % 2 else "")
        rows.append((i, f"http://h.example.org/{i}" if i % 10 else None, page(kind, body), "p", "t", 3))
        want[i] = "\n".join([b.replace("&amp;", "&") for b in blocks] + (["Shares rose by ten.", "Let n be odd."] if i % 2 else []))
    rows += [(100, "http://h.example.org/x", None, "p", "t", 3), (101, "", "", "p", "t", 3), (1, rows[1][1], rows[1][2], "p", "t", 3)]
    long = "<p>" + "word " * 40_000 + "</p>"
    rows.append((102, "http://h.example.org/long", page("blog", long), "p", "t", 3))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path string, text string, host int")
    got = pages.main_text(df)
    assert got.columns == ["page_id", "url", "text", "path"]
    found = got.collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[100] == by[101] == "" and by[102] == ("word " * 40_000).strip()
    in_article = {i: t for i, t in want.items() if not i % 2}
    assert {i: by[i] for i in in_article} == in_article
    assert pages.main_text(df.where("false")).collect() == []


def test_names_inside_articles_keep_their_text():
    html = '<article><p>Long enough text of an article stands here.</p><section class="search-results-study"><p>Study.</p></section><div class="share-buttons">Tweet</div><p class="share-price">Up.</p></article>'
    assert pages.extract(f"<html><body>{html}</body></html>")[0] == "Long enough text of an article stands here.\nStudy.\nUp."


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and got.count() > 50
