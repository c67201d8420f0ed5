"""Text operators against brute force, exact round trips and small edge cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wellspring.llm import bpe, chat, dedup, langid, logbloom, packing, pages, quality, topk, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "a", "one two three four five six", "one two three four five six", "é漢😀 <|endoftext|> x" * 5, "long " * 3000, "\x00\x1c\x85\xa0"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated rows, with extra columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, i, "z", 1) for i, t in enumerate(ODD)] + [(4, ODD[4], "en", 4, "z", 1), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, vid string, votes int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_byte_bpe_equals_tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcé ñ漢😀's\n\t12!?# ") for _ in range(rng.randrange(200))) for _ in range(200)] + ["ab" * 4000]
    c = bpe.Codec(BYTE, public_tokenizers.PATTERN, memory=50)
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == enc.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
        assert c.decimals(ids)[1:].decode() == " ".join(map(str, ids))


def test_byte_bpe_rows(odd, empty):
    got = bpe.round_trip(odd, BYTE, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count() and bpe.round_trip(empty, BYTE, public_tokenizers.PATTERN).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()


def test_packing_covers_each_id_once(odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(odd.where("doc_id is not null"), WORD, max_len=64).collect()
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(ODD):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        times = 2 if i == 4 else 1
        assert sum(r.length for r in pieces[i]) == times * len(ids)
        for r in pieces[i]:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part), len(ids))
    assert packing.pack_documents(empty, WORD).count() == 0


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    h = Counter(rng.randrange(1, 129) for _ in range(3000))
    patterns = packing.shortest_pack_first(h, 128)
    placed = Counter()
    for n, p in patterns:
        assert sum(a * b for a, b in p) <= 128
        for length, copies in p:
            placed[length] += n * copies
    assert placed == h
    assert sum(n for n, _ in patterns) * 128 < 1.02 * sum(k * v for k, v in h.items())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    bags = [(keys, a), (keys[10:], b[10:])]
    s = dedup.bag_min_hash(bags, 8000)
    assert abs((s[0] == s[1]).mean() - dedup.bag_overlap(*bags)) < 0.02
    assert not dedup.bag_min_hash([(keys[:0], a[:0])], 10).any()


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for k, words in enumerate(base):
        for _ in range(1 + k):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            docs.append((100 + len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bag = {i: Counter(zip(*(t.split()[j:] for j in range(5)))) for i, t in docs}
    part = {i: i for i in bag}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in bag:
        for j in bag:
            if i < j and sum((bag[i] & bag[j]).values()) >= 0.8 * sum((bag[i] | bag[j]).values()):
                a, b = find(i), find(j)
                part[max(a, b)] = min(a, b)
    got = dedup.near_duplicates(df.unionByName(odd.select("doc_id", "text")))[0].collect()
    assert {r.doc_id: r.class_id for r in got if (r.doc_id or 0) >= 100} == {i: find(i) for i in bag}
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[0] == 0 and classes[1] == 1 and classes[2] == 2 and classes[5] == 4
    assert sum(r.doc_id == 4 for r in got) == 2


def test_units_that_nobody_shares_are_spelled_out_once(spark, monkeypatch):
    """Members of one bucket, most of them far from its pivot, each with words of its own: all classes are found, from the units that are shared."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for n in [2] * 20 + [4] * 60:
        change = {10 * rng.randrange(1, 14): rng.choice(["a", "a", f"x{len(texts)}"]) for _ in range(n)}
        texts.append(" ".join(change.get(i, "") + w for i, w in enumerate(base)))
    bags = spark.createDataFrame(list(enumerate(texts)), "vid long, text string")
    members = spark.createDataFrame([(1, i, 1000 - i) for i in range(len(texts))], "key long, vid long, c long")
    kept, durable = [], dedup.durable
    monkeypatch.setattr(dedup, "durable", lambda *a, **k: kept.append(durable(*a, **k)) or kept[-1])
    search = dedup._Search(members, durable(dedup._bags(bags)), 0.8)
    search.complete(search.pivots())
    whole = dedup.shingle_bags(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if dedup.bag_overlap(whole[i], whole[j]) >= 0.8]

    def classes(pairs):
        part = list(range(len(texts)))
        for _ in texts:
            for i, j in pairs:
                part[i] = part[j] = min(part[i], part[j])
        return part

    assert classes([(r.v, r.p) for r in search.links.collect()]) == classes(links)
    rows = next(x for x in kept if {"near", "reach"} <= set(x.columns)).where("near")
    dealt = rows.selectExpr("sum(size(units))" if "units" in rows.columns else "sum(d)").first()[0]
    assert 0 < 1.1 * dealt < rows.selectExpr("sum(d)").first()[0]


def test_near_duplicates_link_through_a_closed_member(spark):
    """In each group the last text resembles one text only, which is of the class of a large group and never its centre."""
    docs = []
    for g in range(24):
        base = [f"g{g}w{i}" for i in range(200)]
        edge = ["b" + w if i in (10, 30) else w for i, w in enumerate(base)]
        far = ["c" + w if i in (50, 70, 90, 110) else w for i, w in enumerate(edge)]
        copies = [["d" + w if i == 130 + k else w for i, w in enumerate(base)] for k in range(12)]
        docs += [(1000 * g + k, " ".join(w)) for k, w in enumerate([*copies, edge, far])]
    bag = {i: Counter(zip(*(t.split()[j:] for j in range(5)))) for i, t in docs}
    links = {(i, j) for i in bag for j in bag if j - i > 0 and i // 1000 == j // 1000 and sum((bag[i] & bag[j]).values()) >= 0.8 * sum((bag[i] | bag[j]).values())}
    assert all({i for i, j in links if j == 1000 * g + 13} == {1000 * g + 12} for g in range(24))
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))[0].collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in got} == {i: (i // 1000 * 1000, 14) for i in bag}


def test_near_duplicates_keep_rows_of_any_id(spark):
    words = [f"n{i}" for i in range(100)]
    near = " ".join(["x" if i == 50 else w for i, w in enumerate(words)])
    rows = [(None, " ".join(words)), (7, near), (None, "only without id here"), (None, None), (3, "first of two texts"), (3, "second text of this id"), (9, "second text of this id"), (5, " ")]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    want = [(None, 7, 2), (7, 7, 2), (None, None, 1), (None, None, 1), (3, 3, 1), (3, 3, 2), (9, 3, 2), (5, 5, 1)]
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == Counter(want)


def test_language_model(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()] + [(100 + i, f"the cat sat on mat{i % 3} The") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    pairs = Counter(p for i, t in docs if zlib.crc32(str(i).encode()) % 10 for p in zip([b"\n", *tok(t)], tok(t)))
    about = lambda c: float(logbloom.count_of(logbloom.level_of(np.array(c)))) if c else 0.0
    train = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 10 for w in tok(t))
    n, v = sum(train.values()), len(train)
    for conf in ({}, {"hot_words": 3, "max_filter_bytes": 1 << 16, "bits_per_byte": 400.0}):
        got = logbloom.score_texts(df, **conf).collect()
        assert len(got) == len(docs)
        for r in got:
            w = tok(dict(docs)[r.doc_id])
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
            if not conf:
                single = [(train[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
                each = [(min(about(pairs[a, b]), train[b]) + 50 * p) / (train[a] + 50) for a, b, p in zip([b"\n", *w], w, single)]
                assert math.isclose(r.score, sum(map(math.log10, each)), rel_tol=1e-9)
            assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    assert logbloom.score_texts(empty).count() == 0


def test_filter_never_reads_too_little():
    rng = np.random.default_rng(2)
    key, count = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 2000, 5000)
    bits = np.zeros(logbloom.SEGMENT, dtype=bool)
    logbloom.set_bits(key, count, np.zeros(5000, np.int64), bits)
    packed = np.packbits(bits, bitorder="little")
    read = logbloom.read_levels(packed, key, np.zeros(5000, np.int64))
    assert (read >= logbloom.level_of(count)).all() and (read == logbloom.level_of(count)).mean() > 0.9


def test_levels_of_frequent_pairs_are_not_probed_again_and_stay_the_same(monkeypatch):
    rng = np.random.default_rng(8)
    key = rng.integers(1, 1 << 63, 4000).astype(np.uint64)
    count = np.where(np.arange(4000) % 4 == 0, 200, 2)
    layout = logbloom.Layout(3, 1)
    bits = np.zeros(3 * logbloom.SEGMENT, dtype=bool)
    logbloom.set_bits(key, count, layout.segment_of(key) * logbloom.SEGMENT, bits)
    packed = np.packbits(bits, bitorder="little")
    asked, real = [], logbloom.read_levels
    monkeypatch.setattr(logbloom, "read_levels", lambda f, k, s: asked.append(len(k)) or real(f, k, s))
    for slots in (1 << 16, 64):  # in few slots keys drive each other out
        recent = logbloom.Recent(slots)
        for part in (key, key[::-1], np.concatenate([key, key, rng.integers(1, 1 << 63, 500).astype(np.uint64), np.zeros(3, np.uint64)])):
            assert (recent.read(packed, part, layout) == real(packed, part, layout.segment_of(part))).all()
    assert asked[0] == 4000 and asked[1] < 3100
    assert logbloom._recent("a") is logbloom._recent("a") and logbloom._recent("a") is not logbloom._recent("b")


def test_top_products(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(400, [1.0] * 8), (450, [1.0] * 8), (451, None), (500, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids = np.array([i for i, _ in rows[:302]])
    x = np.floor(256 * np.array([np.float32(v) for _, v in rows[:302]], dtype=float)).astype(int)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s, ok = x @ x[q], ids != ids[q]
        want |= {(int(ids[q]), k + 1, int(ids[ok][j]), int(s[ok][j])) for k, j in enumerate(np.lexsort((ids[ok], -s[ok]))[:5])}
    for conf in ({}, {"bucket_rows": 17, "block_rows": 2}):
        assert {tuple(r) for r in topk.top_products(df, **conf).collect()} == want
    assert topk.top_products(df.where("false")).count() == 0


def test_feasible_range_holds():
    rng = np.random.default_rng(6)
    u = rng.normal(size=(4000, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for t in (-0.2, 0.3, 0.9):
        low, high = topk.feasible(u[0], t)
        near = u[u @ u[0] >= t]
        assert (near >= low - 1e-12).all() and (near <= high + 1e-12).all()


PAGE = """<html><body><header>Site</header><nav><a href=/>Home</a></nav><div id="cookie-bar">Cookies</div><main><article class="post-{n}"><h1>T &amp; {n}</h1>
<p>First  part<br>of <a href=x>it</a>.<p>Second &eacute;<script>if (a<b) "</p>"</script><div class="ad">Buy</div><ul><li>one<li>two</ul><section id=comments><p>me too</p></section></article></main><footer>x</footer>"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{n}", str(i))) for i in range(6)] + [(7, None, None), (8, "odd", ""), (9, "//h1.org", "just text"), (10, "http://h1.org", "<div")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T & 3\nFirst part of it.\nSecond é\none\ntwo"
    assert (got[7], got[8], got[9], got[10]) == ("", "", "just text", "")
    assert pages.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).where("host = 'h0.org'").first().path.endswith("article.post-#")


def test_reply_order(spark):
    rows = [(1, 0, "u", "Hello.\nHow are you?"), (1, 1, "b", "On Mon, X wrote:\n> How are  you?\n\nFine."), (1, 2, "u", "Other"), (1, 3, "b", "> > how are you?\n> Fine.\nGood"), (None, None, None, None), (1, 2, "u", "Other")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1))
    got = chat.reply_order(df).where("conv_id = 1").orderBy("position").collect()
    assert [(r.turn, r.parent_turn, r.depth, r.text) for r in got] == [(0, None, 0, "Hello.\nHow are you?"), (1, 0, 1, "Fine."), (3, 1, 2, "Good"), (2, None, 0, "Other"), (2, None, 0, "Other")]
    assert chat.reply_order(df).count() == 6 and chat.reply_order(df.where("false")).count() == 0


def test_positions_over_small_batches(spark):
    """A conversation that begins at the end of one Arrow batch goes on counting in the next."""
    rows = [(c, t, "u", f"turn {t}") for c in (1, 2, None) for t in range(5)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for n in (1, 2, 4):
            spark.conf.set(name, n)
            got = chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
            assert {(r.conv_id, r.turn, r.position) for r in got} == {(c, t, t) for c, t, _, _ in rows}
    finally:
        spark.conf.set(name, before)


def test_quotations_of_parts_are_linked(spark):
    """Generated conversations quote lines, sentences out of paragraphs and re-wrapped parts; every parent is found."""
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(40):
        said = []
        for t in range(8):
            words = [f"w{rng.randrange(3000)}" for _ in range(60)]
            own = " ".join(w + "." if i % 12 == 11 else w for i, w in enumerate(words))
            head = ""
            if t and rng.random() < 0.7:
                to = rng.randrange(t)
                kind, source = rng.randrange(4), said[to].split()
                if kind == 0:
                    part = [said[to]]
                elif kind == 1:
                    k = 12 * rng.randrange(5)
                    part = [" ".join(source[k : k + 12])]
                else:
                    k = rng.randrange(40)
                    part = [" ".join(source[k + j : k + j + 5]) for j in range(0, 10 if kind == 2 else 20, 5)]
                mark = rng.choice(["> ", ">"])
                head = "On Monday, X wrote:\n" + "\n".join(mark + x for x in part) + "\n\n"
                want[c, t] = to
            rows.append((c, t, "u", head + own))
            said.append(own)
    got = chat.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.parent_turn for r in got if r.parent_turn is not None} == want
    assert all(">" not in r.text and "wrote" not in r.text for r in got)


def test_quality_counts(odd, empty):
    text = "a b c d e f\na b c d e x # %\n\na b c d e f"
    words = text.split()
    n, chars, symbols, dup, rep = quality.text_features(text)[:5]
    assert (n, chars, symbols, dup) == (len(words), sum(map(len, words)), 2, 1)
    seen = Counter(zip(*(words[i:] for i in range(5))))
    cover = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    assert rep == len(cover)
    got = quality.quality_posterior(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.quality <= 1 for r in got)
    assert quality.quality_posterior(empty).count() == 0


def test_language_and_toxicity_on_small_tables(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd_langs = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd).collect()}
    assert odd_langs[0] == ("und", 0.0) and odd_langs[2] == ("und", 0.0)
    assert langid.identify(empty).count() == 0
    tox = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    right = tox.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert right > 0.9
    none = labels.where("false")
    assert toxicity.score_toxicity(odd, none).count() == odd.count()
    assert toxicity.score_toxicity(empty, none).count() == 0


def test_texts_of_a_batch_are_python_objects_a_chunk_at_a_time():
    import pyarrow as pa

    from wellspring.llm import common

    texts = ["a" * 5, None, "", "é" * 9, "b" * 30, "c", "d" * 4, "e" * 7]
    for limit in (1, 10, 12, 100):
        assert list(common.batch_chunks(pa.array(texts), limit)) == list(common.text_chunks(texts, limit))
    assert list(common.batch_chunks(pa.array([], pa.string()))) == []
