"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

Lexicons hold words and word beginnings that toxic documents of a bounded
labelled sample use far more often than clean ones. Voters over the lexicons
and over patterns of hits say toxic, clean or nothing. A generative model
estimates, from all training documents, how often each voter is right and how
voters depend on each other; a logistic regression then learns the posterior
labels from the counts of hits and the votes, and alone scores.
"""

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import common
from .packing import Memo

#: Insults that any lexicon would hold; the rest is learned.
SEEDS = ("bastard clown disgusting dumb fool garbage idiot jerk loser moron pathetic scum stupid trash ugly worthless").split()
LEXICONS = 10
STEMS = range(4, 10)
#: Pattern voters: toxic if the first holds, clean if the second does.
PATTERNS = {
    "distinct": ("n_distinct >= 2", "n_distinct = 0"),
    "many": ("n_distinct >= 4", "n_hits <= 1"),
    "density": ("n_hits >= 2 and 100 * n_hits > n_words", "300 * n_hits < n_words"),
    "repeated": ("n_most >= 2", "n_most = 0"),
    "strong": ("n_strong >= 1", "n_strong = 0"),
    "strong_many": ("n_strong >= 2", "n_strong = 0 and n_hits <= 2"),
}
_words = re.compile(r"[^\W\d_]+").findall
_state: dict = {}


class Lexicon:
    """Word beginnings ("stem") and whole words ("word$"), strongest first."""

    def __init__(self, entries: list[str], strong: int):
        self.entries, self.strong = entries, strong
        self.index = {e: i for i, e in enumerate(entries)}

    def hits(self, word: str) -> tuple[int, ...]:
        found = [self.index.get(word + "$")] + [self.index.get(word[:k]) for k in STEMS if len(word) >= k]
        return tuple(i for i in found if i is not None)


def _memo(lexicon: Lexicon) -> Memo:
    key = tuple(lexicon.entries)
    if _state.get("key") != key:
        _state["key"], _state["memo"] = key, Memo(lexicon.hits, 500_000)
    return _state["memo"]


def _share(col: Column, shares: dict, draw: Column) -> Column:
    limit = F.lit(0.0)
    for value, share in shares.items():
        limit = F.when(col == value, float(share)).otherwise(limit)
    return draw < limit


def _draw(salt: str, *cols: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1 << 30)) / float(1 << 30)


def learn_lexicon(docs: DataFrame, labels: DataFrame, size: int = 320, least_gain: float = 14.0) -> Lexicon:
    """Lexicon of the sample's telling entries; docs (id, text), labels (id, toxic) already sampled and small.

    Equal texts count once. An entry's gain is the log-likelihood ratio of its
    toxic share against that of the sample; least_gain is what none of a
    million entries is likely to reach by chance. Of entries in equally many
    documents of either kind, the longest beginning stands for all.
    """
    joined = docs.join(F.broadcast(labels), "id").select("text", "toxic").dropDuplicates()

    def run(rows):
        counts = Counter()
        for t, y in zip(rows["text"], rows["toxic"]):
            words = set(_words((t or "").lower()))
            found = {w + "$" for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}
            counts.update((e, y) for e in found)
        return {"entry": [e for e, _ in counts], "toxic": [y for _, y in counts], "n": list(counts.values())}

    totals = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    chosen = [w for w in SEEDS]
    strong = len(chosen)
    if n1 and n0:
        seen = common.map_text_chunks(joined, run, "entry string, toxic int, n long", "text")
        seen = seen.groupBy("entry").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("a"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("b"))
        seen = seen.where((F.col("a") >= 3) & (F.col("a") * n0 > 3.0 * F.col("b") * n1))
        both, base = F.col("a") + F.col("b"), n1 / (n1 + n0)
        gain = F.col("a") * F.log(F.col("a") / both / base)
        gain = gain + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / both / (1 - base))).otherwise(0.0)
        top = seen.withColumn("gain", gain).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "entry").limit(20 * size).collect()
        best: dict = {}
        for r in top:
            e, key = r["entry"], (r["entry"][:4], r["a"], r["b"])
            rank = (e[-1] != "$", len(e))
            if key not in best or rank > best[key][0]:
                best[key] = (rank, r["gain"], e, r["b"] * n1 * 20 <= r["a"] * n0)
        order = sorted(best.values(), key=lambda x: (-x[1], x[2]))
        learned = [x[2] for x in order if x[3]][:size] + [x[2] for x in order if not x[3]][: size // 2]
        strong = min(size, sum(x[3] for x in order))
        seeds = [w for w in chosen if w not in learned]
        chosen = learned[:strong] + seeds + learned[strong:]
        strong += len(seeds)
    return Lexicon(chosen, strong)


def hit_table(src: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row of src (id, held_out, text): entry numbers hit, how often, and the numbers that voters use."""
    kind = src.schema["id"].dataType.simpleString()
    names = ("entries", "times", "lexicons", "n_words", "n_hits", "n_distinct", "n_most", "n_strong")

    def run(rows):
        get = _memo(lexicon).__getitem__
        out = {"id": rows["id"], "held_out": rows["held_out"]} | {n: [] for n in names}
        for t in rows["text"]:
            words = _words((t or "").lower())
            hit = [h for h in map(get, words) if h]
            counts = Counter(i for h in hit for i in h)
            strong = {i for i in counts if i < lexicon.strong}
            which = {1 + i % LEXICONS for i in strong}
            values = (list(counts), list(counts.values()), [int(k in which) for k in range(1, LEXICONS + 1)], len(words), len(hit),
                      len(counts), max(counts.values(), default=0), sum(counts[i] for i in strong))
            for n, v in zip(names, values):
                out[n].append(v)
        return out

    schema = f"id {kind}, held_out boolean, entries array<int>, times array<int>, lexicons array<int>, n_words long, n_hits long, n_distinct long, n_most long, n_strong long"
    return common.map_text_chunks(src, run, schema, "text")


def add_votes(hits: DataFrame) -> DataFrame:
    """Adds votes array<int>: of the lexicons 1 or 0, then of the patterns 1, -1 or 0."""
    patterns = [F.expr(f"case when {a} then 1 when {b} then -1 else 0 end") for a, b in PATTERNS.values()]
    return hits.withColumn("votes", F.concat("lexicons", F.array(*patterns)))


class LabelModel:
    """Class-conditional vote probabilities, with votes discounted by how voters depend on each other."""

    def __init__(self, prior: float, table: np.ndarray, discount: np.ndarray):
        self.prior, self.table, self.discount = prior, table, discount

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.table[1]) - np.log(self.table[0])
        return np.log(self.prior / (1 - self.prior)) + (ratio[np.arange(votes.shape[1]), votes + 1] * self.discount).sum(axis=1)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, gold: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over distinct vote patterns.

    gold is 1 or 0 where a training label is known and -1 elsewhere; it acts as
    a voter that is right 19 times in 20. After each round the correlation of every pair of
    voters within the classes is estimated anew, and a voter's weight is divided by one
    plus its positive correlations with the others.
    """
    w = counts.astype(float)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    pull = np.select([gold == 1, gold == 0], [np.log(19.0), -np.log(19.0)], 0.0)
    p = np.where((votes > 0).sum(axis=1) >= 2, 0.9, 0.02)
    model = None
    for _ in range(rounds):
        prior = float(np.clip((w * p).sum() / max(w.sum(), 1e-9), 1e-4, 0.5))
        table = np.empty((2, votes.shape[1], 3))
        together = np.zeros((votes.shape[1],) * 2)
        for c, q in ((0, w * (1 - p)), (1, w * p)):
            seen = np.einsum("n,njv->jv", q, one_hot) + 0.5
            table[c] = seen / seen.sum(axis=1, keepdims=True)
            mean = (q[:, None] * votes).sum(axis=0) / max(q.sum(), 1e-9)
            d = votes - mean
            cov = (d * q[:, None]).T @ d / max(q.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            together += np.clip(cov / np.outer(sd, sd), 0, 1) / 2
        np.fill_diagonal(together, 0)
        model = LabelModel(prior, table, 1 / (1 + together.sum(axis=1)))
        p = 1 / (1 + np.exp(-np.clip(model.log_odds(votes) + pull, -50, 50)))
    return model


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression on soft labels by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * b
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        b -= step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return b


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, toxic_rows: int = 5000, clean_rows: int = 10000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs over its whole text.

    Labels are read only of ids whose crc32 modulo folds is not 0. About toxic_rows
    and clean_rows labelled rows, whatever the size of the table, teach the
    lexicons, and as many documents the classifier; votes are modelled on all
    training documents. A null or empty text has no hits and scores as such. Without
    usable labels the fixed lexicon alone votes. Labels that are null or not 0 or 1
    are ignored; of several labels for an id the largest holds.
    """
    held = common.id_bucket(F.col(id_col), folds) == 0
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    known = labels.where(~held).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    bound = {1: toxic_rows, 0: clean_rows}
    shares = {y: min(1.0, bound[y] / n) for y, n in totals.items()}
    known = durable(known.where(_share(F.col("toxic"), shares, _draw("label", "id"))).limit(2 * (toxic_rows + clean_rows)))
    lexicon = learn_lexicon(src.where(~F.col("held_out")).select("id", "text"), known)

    hits = durable(add_votes(hit_table(src, lexicon)))
    train = hits.where(~F.col("held_out"))
    seen = train.groupBy("votes").count().withColumn("gold", F.lit(-1))
    told = train.join(F.broadcast(known), "id").groupBy("votes", F.col("toxic").alias("gold")).count()
    seen = {(tuple(r["votes"]), r["gold"]): r["count"] for r in seen.unionByName(told).collect()}
    for (v, g), n in list(seen.items()):
        if g >= 0:
            seen[v, -1] -= n
    seen = sorted((k, n) for k, n in seen.items() if n > 0)
    if not seen:
        return hits.select(F.col("id").alias(id_col), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    votes, gold = np.array([k[0] for k, _ in seen]), np.array([k[1] for k, _ in seen])
    model = fit_label_model(votes, np.array([n for _, n in seen]), gold)

    firing = (F.size(F.filter("votes", lambda v: v > 0)) > 0).alias("firing")
    sized = {r["firing"]: r["count"] for r in train.groupBy(firing).count().collect()}
    share = {True: min(1.0, toxic_rows / max(sized.get(True, 0), 1)), False: min(1.0, clean_rows / max(sized.get(False, 0), 1))}
    picked = train.withColumn("firing", firing).where(_share(F.col("firing"), share, _draw("fit", "id")))
    picked = picked.join(F.broadcast(known), "id", "left").select("entries", "times", "votes", "toxic", "firing")
    rows = picked.limit(2 * (toxic_rows + clean_rows)).collect()
    n_entries = len(lexicon.entries)
    x = np.zeros((len(rows), n_entries + votes.shape[1]))
    for i, r in enumerate(rows):
        x[i, r["entries"]] = np.log1p(r["times"])
        x[i, n_entries:] = r["votes"]
    told = np.array([-1 if r["toxic"] is None else r["toxic"] for r in rows])
    pull = np.select([told == 1, told == 0], [np.log(19.0), -np.log(19.0)], 0.0)
    y = 1 / (1 + np.exp(-np.clip(model.log_odds(x[:, n_entries:].astype(int)) + pull, -50, 50))) if len(rows) else np.empty(0)
    weight = np.array([1 / share[r["firing"]] for r in rows])
    b = fit_linear(x, y, weight)

    by_entry = F.array(*[F.lit(float(v)) for v in b[:n_entries]])
    total = F.lit(float(b[-1])) + F.aggregate(
        F.zip_with("entries", "times", lambda e, t: F.element_at(by_entry, e + 1) * F.log1p(t.cast("double"))), F.lit(0.0), lambda a, v: a + v
    )
    for j in range(votes.shape[1]):
        total = total + F.col("votes")[j] * float(b[n_entries + j])
    score = (1 / (1 + F.exp(-total))).alias("score")
    scored = hits.select(F.col("id").alias(id_col), "held_out", score)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
