"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Each rule gives -1 (bad), 0 (abstains) or 1 (good). Documents with equal votes
are counted together, so EM runs on the table of vote patterns, whose size has
the bound 3 ** len(RULES) whatever the corpus holds. EM estimates how often
each rule votes each way on good documents and on each kind of bad ones; the
posterior of the good class decides, in place of a demand that all rules pass.
"""

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import common

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_symbols = re.compile(r"[#*$%&|<>]").findall

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long, n_upper long, n_bang long, n_alpha_words long, n_top long, n_ended long"

#: name -> (value as SQL, votes bad if, votes good if); a rule abstains in between and on texts without words.
RULES = {
    "length": ("n_words", "v < 10", "v >= 40"),
    "symbols": ("n_symbols / word_chars", "v > 0.05", "v < 0.01"),
    "capitals": ("n_upper / greatest(n_letters, 1)", "v > 0.4", "v < 0.15"),
    "repetition": ("n_repeat_words / n_words", "v > 0.3", "v < 0.1"),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", "v > 0.4", "v < 0.15"),
    "word_size": ("word_chars / n_words", "v < 2.5 or v > 14", "v between 3.5 and 9"),
    "letters": ("n_alpha_words / n_words", "v < 0.7", "v > 0.95"),
    "bangs": ("n_bang / n_words", "v > 0.3", "v < 0.05"),
    "one_word": ("n_top / n_words", "v > 0.3 and n_words >= 20", "v < 0.15"),
    "endings": ("n_ended / greatest(n_lines, 1)", "v < 0.1 and n_words >= 100", "v > 0.6"),
}


def repeat_words(words: list[str], size: int = 5) -> int:
    """Words that lie in a window of size words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def text_features(text: str) -> tuple:
    """The counts of FEATURES for one whole text."""
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip("\t\x0b\x0c\r ")]
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    letters = sum(map(str.isalpha, text))
    symbols = len(_symbols(text))
    return (
        len(words),
        sum(map(len, words)),
        symbols,
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        letters,
        upper,
        text.count("!!"),
        sum(not w.isdigit() and any(map(str.isalpha, w)) for w in words),
        Counter(words).most_common(1)[0][1] if words else 0,
        sum(x.rstrip()[-1:] in ".!?:;\"')»”…。！？" for x in lines),
    )


def _columns(texts: list[str | None]) -> dict[str, list[int]]:
    found = [text_features(t or "") for t in texts]
    return {x.split()[0]: [f[i] for f in found] for i, x in enumerate(FEATURES.split(", "))}


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of df, over its whole text; null text counts as empty. No shuffle."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(rows):
        return {"id": rows["id"]} | _columns(rows["text"])

    return common.map_text_chunks(src, run, f"id {kind}, {FEATURES}", "text")


def votes(feats: DataFrame) -> DataFrame:
    """Adds votes array<int>, one for each rule in order."""
    cols = []
    for value, bad, good in RULES.values():
        put = lambda s, v=value: re.sub(r"\bv\b", f"({v})", s)
        cols.append(F.expr(f"case when n_words = 0 then 0 when {put(bad)} then -1 when {put(good)} then 1 else 0 end"))
    return feats.withColumn("votes", F.array(*[c.cast("int") for c in cols]))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (share of each class, table [class, rule, vote + 1] of probabilities).

    Class 0 is good; class j + 1 is bad in the way that rule j sees, since bad
    documents seldom fail all rules together and one bad class would let the
    votes of the rules that pass outweigh the one that fails. A class keeps
    its own rule's bad vote at 0.9 or more, so classes cannot swap. The start
    shares a pattern between the classes of the rules that vote bad. A rule
    that abstains tells nothing: the table is of the votes given.
    """
    n_rules = patterns.shape[1]
    w = counts.astype(float)[:, None]
    one_hot = np.stack([patterns == -1, patterns == 2, patterns == 1], axis=2).astype(float)
    bad = (patterns < 0).astype(float)
    belongs = np.hstack([(bad.sum(axis=1, keepdims=True) == 0).astype(float), bad])
    belongs = 0.98 * belongs / belongs.sum(axis=1, keepdims=True) + 0.02 / (n_rules + 1)
    for _ in range(rounds):
        share = (w * belongs).sum(axis=0) + 1.0
        share /= share.sum()
        seen = np.einsum("nc,njv->cjv", w * belongs, one_hot) + [0.1, 0.0, 0.1]
        table = seen / seen.sum(axis=2, keepdims=True)
        for j in range(n_rules):
            own = max(table[j + 1, j, 0], 0.9)
            table[j + 1, j] = own, 0.0, 1 - own
        log = np.log(share)[None, :] + np.einsum("njv,cjv->nc", one_hot, np.log(np.maximum(table, 1e-12)))
        belongs = np.exp(log - log.max(axis=1, keepdims=True))
        belongs /= belongs.sum(axis=1, keepdims=True)
    return share, table


def quality_posterior(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes and posterior quality probability of each document.

    Returns id, the counts of FEATURES, votes and quality double. A text
    without words gets quality 0; an empty table gives an empty result. Rules
    are not told which documents are good: the model learns from votes alone.
    The one shuffle moves vote patterns, at most 3 ** len(RULES) for a task.
    """
    return _weighed(durable(votes(features(df, id_col, text_col)))).withColumnRenamed("id", id_col)


def rows_with_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of df as struct row with its counts, votes and quality, as quality_posterior has them. Texts are not shuffled."""
    return _weighed(durable(votes(common.beside(df, _columns, FEATURES, text_col))))


def _weighed(voted: DataFrame) -> DataFrame:
    """Adds quality by the label model fitted to the votes."""
    seen = voted.where("n_words > 0").groupBy("votes").count().collect()
    seen.sort(key=lambda r: r["votes"])
    if seen:
        share, table = fit_label_model(np.array([r["votes"] for r in seen]), np.array([r["count"] for r in seen]))
    else:
        share, table = np.full(len(RULES) + 1, 1 / (len(RULES) + 1)), np.full((len(RULES) + 1, len(RULES), 3), 1 / 3)
    log = np.log(np.maximum(table, 1e-12))
    odds = F.lit(0.0)  # of bad against good
    for c in range(1, len(RULES) + 1):
        total = F.lit(float(np.log(share[c] / share[0])))
        for j in range(len(RULES)):
            diff = [float(x) for x in log[c, j] - log[0, j]]
            total = total + F.element_at(F.array(*map(F.lit, diff)), F.col("votes")[j] + 2)
        odds = odds + F.exp(total)
    quality = F.when(F.col("n_words") == 0, 0.0).otherwise(1 / (1 + odds))
    return voted.withColumn("quality", quality)
