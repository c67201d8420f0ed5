"""Phrases against plain counting of every word run."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wellspring.llm import phrases

SCHEMA = "doc_id long, text string, lang string, level int, phrase string, n long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least, top, longest=4):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in cand.items():
        cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        held = any(q[0] == lang and len(q) > len(w) + 1 and any(list(q[i : i + len(w)]) == w for i in range(1, len(q))) and 100 * b >= 80 * a for q, b in cand.items())
        if not held:
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def texts(seed, count=40):
    rng = random.Random(seed)
    words = ["a", "A", "b", "ça", "x" * 300, "漢字", "\x85", "of"]
    rows = []
    for i in range(count):
        out = []
        for _ in range(rng.randrange(60)):
            out.append(rng.choice(["of the people", "a a a a a", "in spite of", *words]))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]))
        rows.append(("".join(out), rng.choice(["en", "fr", None, ""])))
    return [*rows, (None, "en"), ("", None), ("no end", "zz"), ("word " * 5000, "en"), ("...,,\n", "fr")]


@pytest.mark.parametrize("most", [96 << 20, 3000, 1000])
def test_equals_plain_counting(spark, most):
    rows = texts(1)
    df = spark.createDataFrame([(i, t, lang, 7, "p", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in phrases.mine_phrases(df, least=4, top=25, max_trie_bytes=most).collect())
    assert got == brute(rows, 4, 25)


def test_empty_table_and_rare_words(spark):
    df = spark.createDataFrame([(1, "a b c", "en", 1, "p", 1)], SCHEMA)
    assert phrases.mine_phrases(df.where("false")).collect() == []
    assert phrases.mine_phrases(df).collect() == []


@pytest.mark.parametrize("words", [3, 40, 3000])
def test_trie_accepts_what_it_holds(words):
    rng = np.random.default_rng(words)
    held = sorted({("en" if rng.random() < 0.8 else "fr", f"w{rng.zipf(1.3) % words} w{rng.integers(words)}") for _ in range(20000)})
    t = phrases.Trie(pa.array([x for x, _ in held]), pa.array([p for _, p in held]), 2, {"en"})
    assert (np.bincount(t.check[t.check >= 0]) <= 1 << t.bits).all() and (t.accept >= 0).sum() == len(held)
    every = [f"w{rng.integers(words + 5)}" for _ in range(2000)]
    got, _ = t.walk(phrases.Words(pa.array([" ".join(every), " ".join(every)])), ["en", "de"])
    place = {p: i for i, p in enumerate(held)}
    want = [place.get(("en", f"{a} {b}"), -1) for a, b in zip(every, every[1:])] + [-1] * (len(every) + 1)
    assert got.tolist() == want
