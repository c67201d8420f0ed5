"""Collocations: phrases of two to four words that hold together, by language.

Candidates are mined level by level. A pass over all texts counts the candidates
of one length by a broadcast double-array trie: all word positions of a chunk
of text hold a state, numpy advances them together word by word, and the
accepting states are counted with bincount. The same pass proposes the next
length: phrases whose parts of one word less were accepted where they stand
(Apriori), summed over tasks, of which those frequent enough are the next
candidates. Tries are cut into shards of bounded size, whose counts add up.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Bytes of text that a task tokenises at a time; a longer text stands alone.
CHUNK = 4 << 20
#: Bits of a symbol of the trie at most; a word is one or more symbols.
SYMBOL = 8
_ROUNDS, _CROWD = 64, 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE, _BREAK = (np.isin(np.arange(256), list(c)) for c in (b" \t", b".,;:!?\n\x0b\f\r"))
_GAP = _SPACE | _BREAK
COUNTS = "level int, lang string, phrase string, n long"


class Words:
    """Words of a chunk of texts: code of each word's form, its text, and its piece; forms are an Arrow array."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if len(ends) else np.empty(0, np.uint8)
        ends = ends - ends[0]
        data = _LOWER[raw]
        inside = ~_GAP[data]
        first = np.zeros(len(data) + 1, dtype=bool)  # of a text
        first[ends] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | first[1:-1]
        end[:-1] &= ~inside[1:] | first[1:-1]
        at, to = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.text = np.searchsorted(ends, at, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[data] | first[:-1]), at, side="right")
        bounds = np.concatenate(([0], np.cumsum(to - at))).astype(np.int32)
        forms = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])]).dictionary_encode()
        self.code, self.forms = forms.indices.to_numpy(zero_copy_only=False), forms.dictionary


def _chunks(batches):
    """(texts, languages) of runs of rows of about CHUNK bytes."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK)))
            yield b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo)
            lo = hi


def _rows(level: int, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(n), level, dtype=np.int32)), lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["level", "lang", "phrase", "n"])


def _count_words(batches):
    """Counts of each language's words, and of all its words together at level 0."""
    for texts, langs in _chunks(batches):
        w, lang = Words(texts), langs.dictionary_encode()
        of = lang.indices.to_numpy(zero_copy_only=False)[w.text]
        forms = max(len(w.forms), 1)
        key, n = np.unique(of.astype(np.int64) * forms + w.code, return_counts=True)
        yield _rows(1, lang.dictionary.take(pa.array(key // forms)), w.forms.take(pa.array(key % forms)), n)
        total = np.bincount(of, minlength=len(lang.dictionary))
        yield _rows(0, lang.dictionary, pa.array([""] * len(total)), total)


class Trie:
    """Double-array trie of phrases of level words each, under one root a language.

    Words are numbered by how many phrases hold them and spelled as symbols of
    a few bits. A state's children stand at its base plus their symbol and name
    it in check. Nodes of many children get blocks of their own, those of few
    are dealt at random until they fit, and only children fill what is free.
    """

    def __init__(self, langs: pa.Array, phrases: pa.Array, level: int, whole: set, seed: int = 0):
        self.level, self.langs, self.phrases = level, langs, phrases
        words = pc.split_pattern(phrases, " ").flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, level)
        order = np.argsort(-np.bincount(code.ravel(), minlength=len(words.dictionary)), kind="stable")
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        self.vocabulary, code = words.dictionary.take(pa.array(order)), number[code]
        bits = max(1, int(max(len(order) - 1, 1)).bit_length())
        self.symbols = -(-bits // SYMBOL)
        self.bits = -(-bits // self.symbols)
        roots = langs.dictionary_encode()
        self.root = {lang: i for i, lang in enumerate(roots.dictionary.to_pylist())}
        self.whole = np.array([lang in whole for lang in self.root], dtype=bool)
        self._build(code, roots.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.random.default_rng(seed))

    def spelled(self, code: np.ndarray, symbol: int) -> np.ndarray:
        return (code >> (self.bits * (self.symbols - 1 - symbol))) & ((1 << self.bits) - 1)

    def _build(self, code: np.ndarray, node: np.ndarray, rng) -> None:
        nodes, parents, symbols = len(self.root), [], []
        for j in range(self.level):
            for s in range(self.symbols):  # nodes of a depth are numbered by parent, then by symbol
                key, back = np.unique((node << self.bits) | self.spelled(code[:, j], s), return_inverse=True)
                parents.append(key >> self.bits)
                symbols.append(key & ((1 << self.bits) - 1))
                node, nodes = nodes + back, nodes + len(key)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        slot_of, base_of, size = self._place(nodes, parent, symbol, rng)
        self.base, self.check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.accept = np.full(size, -1, dtype=np.int32)
        self.base[slot_of] = base_of
        self.check[slot_of[len(self.root) :]] = slot_of[parent]
        self.accept[slot_of[node]] = np.arange(len(node))

    def _place(self, nodes: int, parent: np.ndarray, symbol: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, int]:
        """Slot and base of each node, and the number of slots; no two children share a slot."""
        roots, width = len(self.root), 1 << self.bits
        child = np.arange(len(parent)) + roots
        several, first, fan = np.unique(parent, return_index=True, return_counts=True)  # siblings stand together
        base = np.zeros(nodes, dtype=np.int64)
        crowd = np.flatnonzero(fan > _CROWD)
        begin = width + roots
        base[several[crowd]] = begin + width * np.arange(len(crowd))
        end = begin + width * len(crowd)
        free = np.ones(max(end, begin + 2 * len(parent)) + 2 * width, dtype=bool)
        free[:begin] = False
        free[-width:] = False
        of = np.repeat(np.arange(len(several)), fan)
        big = fan[of] > _CROWD
        free[base[parent[big]] + symbol[big]] = False
        extra = []
        for m in range(_CROWD, 1, -1):
            left = np.flatnonzero(fan == m)
            for _ in range(_ROUNDS):
                if not len(left):
                    break
                spell = symbol[first[left][:, None] + np.arange(m)]
                try_ = rng.choice(np.flatnonzero(free), len(left)) - spell[:, 0]
                slots = try_[:, None] + spell
                fits = (try_ >= begin - width) & free[slots].all(axis=1)
                claim = np.full(len(free), -1, dtype=np.int64)
                claim[slots[fits].ravel()] = np.repeat(np.flatnonzero(fits), m)
                fits &= (claim[slots] == np.arange(len(left))[:, None]).all(axis=1)
                base[several[left[fits]]] = try_[fits]
                free[slots[fits].ravel()] = False
                left = left[~fits]
            extra.append(left)
        extra = np.concatenate(extra)
        size = len(free)
        base[several[extra]] = size + width * np.arange(len(extra))
        only = np.flatnonzero(fan == 1)
        room = np.flatnonzero(free)[: len(only)]
        base[several[only]] = room - symbol[first[only]]
        slot = np.empty(nodes, dtype=np.int64)
        slot[:roots] = np.arange(roots)
        slot[child] = base[parent] + symbol
        return slot, base, size + width * (len(extra) + 1)

    def walk(self, words: Words, langs: list) -> tuple[np.ndarray, np.ndarray]:
        """Phrase that starts at each word, else -1; and each word's root, else -1. All positions advance together."""
        known = pc.fill_null(pc.index_in(words.forms, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        code = known[words.code].astype(np.int64) if len(words.forms) else np.empty(0, np.int64)
        root = np.array([self.root.get(x, -1) for x in langs], dtype=np.int64)[words.text]
        at = np.flatnonzero((code >= 0) & (root >= 0))
        state = root[at]
        for j in range(self.level):
            if j:
                near = at + j
                near = np.minimum(near, len(code) - 1)
                on = (at + j < len(code)) & (words.piece[near] == words.piece[at]) & (code[near] >= 0)
                at, state = at[on], state[on]
            for s in range(self.symbols):
                to = self.base[state] + self.spelled(code[at + j], s)
                on = self.check[to] == state
                at, state = at[on], to[on]
        hit = np.full(len(code), -1, dtype=np.int64)
        hit[at] = self.accept[state]
        return hit, root


def _pass(shared, extend: bool):
    """Counts of the trie's phrases, and proposals of one word more."""

    def run(batches):
        t = shared.value
        k = t.level
        for texts, langs in _chunks(batches):
            w = Words(texts)
            hit, root = t.walk(w, langs.to_pylist())
            n = np.bincount(hit[hit >= 0], minlength=len(t.phrases))
            seen = np.flatnonzero(n)
            yield _rows(k, t.langs.take(pa.array(seen)), t.phrases.take(pa.array(seen)), n[seen])
            if not extend:
                continue
            at = np.flatnonzero(hit[: max(len(hit) - k, 0)] >= 0)
            safe = (w.piece[at + k] == w.piece[at]) & ((hit[at + 1] >= 0) | ~t.whole[root[at]])
            at = at[safe]
            forms = max(len(w.forms), 1)
            key, n = np.unique(hit[at] * forms + w.code[at + k], return_counts=True)
            head = pa.array(key // forms)
            phrase = pc.binary_join_element_wise(t.phrases.take(head), w.forms.take(pa.array(key % forms)), " ")
            yield _rows(k + 1, t.langs.take(head), phrase, n)

    return run


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("level", "lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("level") == 0) | (F.col("n") >= least))


def _shards(candidates: DataFrame, most: int) -> list[tuple]:
    """(languages, part, parts) of shards of at most about most bytes; a language that is larger is cut by a hash into parts."""
    size = candidates.groupBy("lang").agg(F.sum(F.octet_length("phrase") + 16).alias("size")).collect()
    out, group, held = [], [], 0
    for r in sorted(size, key=lambda r: r["lang"]):
        if r["size"] > most:
            parts = -(-r["size"] // most)
            out += [([r["lang"]], i, parts) for i in range(parts)]
            continue
        if group and held + r["size"] > most:
            out.append((group, 0, 1))
            group, held = [], 0
        group, held = [*group, r["lang"]], held + r["size"]
    return [*out, (group, 0, 1)] if group else out


def count_phrases(docs: DataFrame, longest: int = 4, least: int = 30, max_trie_bytes: int = 96 << 20) -> DataFrame:
    """(level, lang, phrase, n) of rows (text, lang): words and phrases that occur least times or more, and at level 0 all words of a language."""
    spark = docs.sparkSession
    out = durable(_summed(docs.mapInArrow(_count_words, COUNTS), least))
    totals = out.where("level = 0")
    proposed, counted = out.where("level = 1"), []
    for level in range(1, longest + 1):
        found = []
        shards = _shards(proposed, max_trie_bytes)
        for langs, part, parts in shards:
            mine = proposed.where(F.col("lang").isin(langs))
            mine = mine.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part) if parts > 1 else mine
            held = mine.select("lang", "phrase").sort("lang", "phrase").toArrow().combine_chunks()
            lang, phrase = (held.column(i).combine_chunks() for i in (0, 1))
            trie = Trie(lang, phrase, level, set(langs) if parts == 1 else set())
            shared = spark.sparkContext.broadcast(trie)
            texts = docs.where(F.col("lang").isin(langs)) if len(shards) > 1 else docs
            found.append(durable(_summed(texts.mapInArrow(_pass(shared, level < longest), COUNTS), 1 if parts > 1 else least)))
            shared.unpersist()
        if not found:
            break
        rows = found[0]
        for f in found[1:]:
            rows = rows.unionByName(f)
        counted.append(rows.where(F.col("level") == level))
        proposed = durable(_summed(rows.where(F.col("level") == level + 1), least))
    for c in counted:
        totals = totals.unionByName(c)
    return totals


def score_phrases(counts: DataFrame, top: int = 2000, keep: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of counted phrases, the first top of each language.

    score is floor(2000000 a / (l + r)) at the cut into two parts, counted l
    and r, where it is lowest, ties to the shortest first part. A phrase inside
    a longer one of keep percent of its count is left out.
    """
    held = counts.where("level > 0").select("level", "lang", "phrase", "n")
    candidates = held.where("level > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("level") - 1)))
    cut = cut.select("lang", "phrase", "level", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("level")), " ").alias("rest"))
    for end, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(held.select("lang", F.col("phrase").alias(end), F.col("n").alias(name)), ["lang", end])
    cut = cut.withColumn("score", F.expr("cast(2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r) as long)"))
    best = cut.groupBy("lang", "phrase", "level", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("level") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("level") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")),
        )
    )
    inside = candidates.where("level > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = best.join(inside, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * cast(longer as decimal(20,0)) < {keep} * cast(a as decimal(20,0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = whole.select("lang", "phrase", "a", "b", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    totals = counts.where("level = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")


def mine_phrases(df: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, max_trie_bytes: int = 96 << 20, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased in A-Z, split into pieces at punctuation and line ends,
    and these into words at spaces and tabs; phrases lie within a piece. All
    occurrences count, overlapping ones too, and n counts all words of a
    language. A null language is und, a null text has no words; long texts are
    taken whole; repeated rows count each; an empty table gives no rows; other
    columns are not read. Counts are exact.

    A shard of candidates is broadcast at a time, of about max_trie_bytes of
    phrases; more candidates mean more passes, over the texts of the shard's
    languages only. A language larger than a shard is cut by a hash; its next
    proposals are checked at their first part only, which proposes more and
    counts the same. The window takes the first of each language from each
    partition before they meet.
    """
    docs = df.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return score_phrases(count_phrases(docs, longest, least, max_trie_bytes), top)


def oracle_sql(longest: int = 4, least: int = 30, top: int = 2000, keep: int = 80) -> str:
    """The same phrases in DuckDB SQL, every phrase of every text spelled out."""
    grams = " union all ".join(f"select lang, {k} k, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) phrase from w" for k in range(1, longest + 1))
    return rf"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d)),
g as materialized ({grams}),
c as materialized (select lang, k, phrase, count(*) f from g group by all having k = 1 or count(*) >= {least}),
tot as (select lang, sum(f)::bigint n from c where k = 1 group by lang),
cand as materialized (select lang, k, phrase, f a, string_split(phrase, ' ') ws from c where k > 1),
parts as materialized (select lang, phrase, a, j, array_to_string(ws[1:j], ' ') h, array_to_string(ws[j + 1:], ' ') e from (select *, unnest(range(1, k)) j from cand)),
cut as materialized (select p.lang, p.phrase, p.a, p.j, l.f l, r.f r, ((2000000::hugeint * p.a) // (l.f + r.f))::bigint score from parts p
 join c l on l.lang = p.lang and l.phrase = p.h join c r on r.lang = p.lang and r.phrase = p.e),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, j) x from cut) where x = 1),
spans as materialized (select lang, a, k, ws, unnest(range(2, k)) m from cand where k > 2),
sub as materialized (select lang, phrase, max(a) longer from (select lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) phrase from spans) group by all),
kept as (select b.* from best b left join sub s on s.lang = b.lang and s.phrase = b.phrase where s.longer is null or 100 * s.longer::hugeint < {keep} * b.a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join tot using (lang) where rank <= {top}"""
