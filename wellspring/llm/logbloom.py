"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

A count c is kept as its level 1 + floor(log_b c); the filter holds the n-gram
once for every level up to its own. A reader probes level 1, 2, ... until one
is absent and so gets the level, never too small and seldom too large. A worker
remembers the levels of frequent n-grams that it read. Unigrams
and bigrams share the filter. It is made of segments of fixed size, each built
by the one task that gets all counts of the n-grams hashed there, so counts
are exact before they are quantised.

The filter grows with the training text. It is broadcast in slices of bounded
size: the predicted word decides the slice, and the logarithm of a smoothed
probability, log(c(v,w) + m p(w)) - log(c(v) + m), is a sum of two terms that
each need one slice only. One slice does until the bound is reached; then every
further slice is one more pass, with the same results.
"""

import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import common
from .dedup import mix

#: Growth of the levels, bits set for an entry, bits of a segment.
BASE, PROBES, SEGMENT = 1.5, 8, 1 << 19
ALPHA, WEIGHT = 0.1, 50.0
#: Tasks that build the filter at most; each builds one group of segments after another.
MOST_TASKS = 1 << 15
#: Slices at most, as their numbers travel in 16 bits.
MOST_SLICES = 1 << 16
_U = np.uint64
#: Hash of the token that ends each text and stands before its first word.
END = np.uint64(0x5851F42D4C957F2D)
_state: dict = {}


def level_of(count: np.ndarray) -> np.ndarray:
    """Level of each count from 1 on."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """Mean of the whole numbers that share a level; 0 for level 0. A level without any has its middle."""
    level = np.asarray(level, dtype=float)
    low, high = np.ceil(BASE ** (level - 1) - 1e-9), np.ceil(BASE**level - 1e-9) - 1
    return np.where(level < 1, 0.0, np.where(high >= low, (low + high) / 2, (BASE ** (level - 1) + BASE**level) / 2))


class Layout:
    """Where n-grams go: slices by the last word, segments by the whole n-gram."""

    def __init__(self, segments: int, slices: int):
        self.slices = slices
        self.each = -(-segments // slices)

    def slice_of(self, word: np.ndarray) -> np.ndarray:
        return (mix(word + _U(0xA0761D6478BD642F)) % _U(self.slices)).astype(np.int64)

    def segment_of(self, key: np.ndarray) -> np.ndarray:
        return (mix(key ^ _U(0xE7037ED1A0B428DB)) % _U(self.each)).astype(np.int64)


def probe_bits(key: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and odd step of the bits of each entry within its segment."""
    h = mix(key + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return h, (h >> _U(32)) | _U(1)


def set_bits(key: np.ndarray, count: np.ndarray, where: np.ndarray, bits: np.ndarray) -> None:
    """Enter n-grams with counts; where is the first bit of the segment, bits a bool array."""
    level = level_of(count)
    now = 1
    while len(key):
        start, step = probe_bits(key, np.full(len(key), now))
        for i in range(PROBES):
            bits[where + ((start + _U(i) * step) & _U(SEGMENT - 1)).astype(np.int64)] = True
        now += 1
        more = level >= now
        key, level, where = key[more], level[more], where[more]


def read_levels(filter_: np.ndarray, key: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Level of each n-gram by repeated membership probes of a packed filter.

    Two probes rule out most absent entries; the others are asked for the rest at once.
    """
    out = np.zeros(len(key), dtype=np.int64)
    at, now, base = np.arange(len(key)), 1, segment * (SEGMENT >> 3)
    while len(at):
        start, step = (x.astype(np.uint32) for x in probe_bits(key, np.array([now])))  # their low bits say where
        for probes in (2, PROBES - 2):
            ok = np.ones(len(at), dtype=np.uint8)
            for _ in range(probes):
                bit = start & np.uint32(SEGMENT - 1)
                ok &= filter_[base + (bit >> 3)] >> (bit & 7).astype(np.uint8)
                start = start + step
            ok = np.flatnonzero(ok)
            at, key, base, start, step = at[ok], key[ok], base[ok], start[ok], step[ok]
        out[at] = now
        now += 1
    return out


class Recent:
    """Levels of n-grams met lately, those that took many probes only; the last one of a slot stays."""

    def __init__(self, slots: int = 1 << 20, least: int = 5):
        self.key, self.level, self.least = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint8), least

    def read(self, filter_: np.ndarray, key: np.ndarray, layout: Layout) -> np.ndarray:
        slot = (key & _U(len(self.key) - 1)).astype(np.int64)
        out = np.where(self.key[slot] == key, self.level[slot], 0).astype(np.int64)
        new = np.flatnonzero(out == 0)
        asked = key[new]
        out[new] = level = read_levels(filter_, asked, layout.segment_of(asked))
        keep = (level >= self.least) & (level < 256)
        slot, asked, level = slot[new[keep]], asked[keep], level[keep]
        self.key[slot] = asked
        won = self.key[slot] == asked
        self.level[slot[won]] = level[won]
        return out


def _recent(tag: str) -> Recent:
    """What this worker remembers of the slice of this tag; it forgets other slices."""
    if _state.get("tag") != tag:
        _state.update(tag=tag, recent=Recent())
    return _state["recent"]


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an END after each, and where each text ends.

    Only A-Z are lower-cased; words end at ASCII white space only.
    """
    from xxhash import xxh3_64_intdigest

    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(s) + 1 for s in split], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = np.full(int(ends[-1]) if len(ends) else 0, END, dtype=np.uint64)
    inner = np.ones(len(flat), dtype=bool)
    inner[ends - 1] = False
    flat[inner] = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(split)), dtype=np.uint64, count=int(inner.sum()))
    return flat, ends


def contexts(flat: np.ndarray) -> np.ndarray:
    """The token before each; END before a text's first, as the one before it ended there."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[:1] = END
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _U(0x9E3779B97F4A7C15) + mix(w ^ _U(0x8EBC6AF09C88C6E3)))


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sum counts of equal keys: (key, word, count)."""
    key, word, count = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, word, count = key[order], word[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], word[first], np.add.reduceat(count, first) if len(first) else count


class Model:
    """What scoring needs but the filter: totals, and exact counts of the most frequent words."""

    def __init__(self, tokens: int, types: int, hot_key: np.ndarray, hot_count: np.ndarray):
        self.tokens, self.types, self.hot_key, self.hot_count = tokens, types, hot_key, hot_count

    def log_base(self, count):
        return np.log10((count + ALPHA) / (self.tokens + ALPHA * (self.types + 1)))


def gather_counts(train: DataFrame, layout: Layout, groups: int) -> DataFrame:
    """Exact unigram counts and the filter's segments from one pass and one shuffle.

    train has a column text. Rows are either (key, count) of a unigram, or
    (slice, segment, bits). Tasks send packed arrays of n-grams and counts, summed over some
    megabytes of text, to the group that owns the segment.
    """
    schema = pa.schema([("g", pa.int32()), ("data", pa.binary())])

    def send(batches):
        def flush(held):
            key, word, count = _merge(held)
            part = layout.slice_of(word)
            group = (part * layout.each + layout.segment_of(key)) % groups
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order], prepend=-1))
            columns = [x[order] for x in (key, part.astype("<u2"), (key == word).astype("u1"), count.astype("<u4"))]
            out = []
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                out.append((hi - lo).to_bytes(8, "little") + b"".join(x[lo:hi].tobytes() for x in columns))
            group = group[order]
            return pa.RecordBatch.from_arrays([pa.array(group[cut], pa.int32()), pa.array(out, pa.binary())], schema=schema)

        held, size = [], 0
        for batch in batches:
            for lo, hi in common.batch_chunks(batch.column(0)):
                flat, _ = token_hashes(batch.column(0).slice(lo, hi - lo).to_pylist())
                ones = np.ones(len(flat), dtype=np.int64)
                held.append(_merge([(flat, flat, ones)]))
                held.append(_merge([(pair_key(contexts(flat), flat), flat, ones)]))
                size += len(flat)
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    back = pa.schema([("key", pa.int64()), ("count", pa.int64()), ("at", pa.int64()), ("bits", pa.binary())])

    def entries(held):
        """Rows of one group: its unigrams' counts, then its segments."""
        key, tag, count = _merge(held)
        lone = np.flatnonzero((tag & _U(1)) == 1)
        for lo in range(0, len(lone), 100_000):
            k, c = key[lone[lo : lo + 100_000]], count[lone[lo : lo + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.binary())], schema=back)
        at = (tag >> _U(1)).astype(np.int64) * layout.each + layout.segment_of(key)
        order = np.argsort(at, kind="stable")
        key, count, at = key[order], count[order], at[order]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)]):
            bits = np.zeros(SEGMENT, dtype=bool)
            set_bits(key[a:b], count[a:b], np.zeros(b - a, dtype=np.int64), bits)
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(at[a])]), pa.array([packed], pa.binary())], schema=back
            )

    def build(batches):
        """Rows come sorted by group, so a task holds one group at a time."""
        held, now, size = [], None, 0
        for batch in batches:
            for g, data in zip(batch.column("g").to_pylist(), batch.column("data")):
                if g != now:
                    if held:
                        yield from entries(held)
                    held, now, size = [], g, 0
                raw = data.as_py()
                n = int.from_bytes(raw[:8], "little")
                a, b, c = 8 + 8 * n, 8 + 10 * n, 8 + 11 * n
                key = np.frombuffer(raw[8:a], "<u8")
                tag = np.frombuffer(raw[a:b], "<u2").astype(np.uint64) * _U(2) + np.frombuffer(raw[b:c], "u1")
                held.append((key, tag, np.frombuffer(raw[c:], "<u4").astype(np.int64)))
                size += n
                if size > 2 * max(len(held[0][0]), 500_000):
                    held = [_merge(held)]
                    size = len(held[0][0])
        if held:
            yield from entries(held)

    parts = min(groups, MOST_TASKS)
    sent = train.select("text").mapInArrow(send, "g int, data binary")
    dealt = sent.repartitionById(parts, F.col("g") % parts).sortWithinPartitions("g")
    return dealt.mapInArrow(build, "key long, count long, at long, bits binary")


def score_texts(
    df: DataFrame,
    folds: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_byte: float = 1.25,
    max_filter_bytes: int = 256 << 20,
    hot_words: int = 1 << 22,
    group_bytes: int = 8 << 20,
) -> DataFrame:
    """Train on rows whose crc32 of the id modulo folds is not 0 and score every row.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    in base-10 logarithms of a whole text's probability. base_score is the
    additively smoothed unigram model with exact counts; score the bigram model
    over the filter, whose contexts have exact counts too where the word is one
    of the frequent ones, which are all up to hot_words. A null or empty text is its end token alone; with no
    training rows both models give every token probability 1. Repeated rows are
    scored each.

    Exact counts of at most hot_words frequent words are broadcast; those of
    rarer words, which are few tokens each, come by a join. max_filter_bytes
    bounds the slice of the filter that is broadcast at a time.
    """
    spark = df.sparkSession
    src = df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), (common.id_bucket(id_col, folds) == 0).alias("held_out")
    )
    train = src.where(~F.col("held_out"))
    size = train.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    segments = max(1, -(-int(size * bits_per_byte) // SEGMENT))
    slices = -(-segments * SEGMENT // 8 // max_filter_bytes)
    if slices > MOST_SLICES:
        raise ValueError(f"{slices} slices of the filter: raise max_filter_bytes")
    layout = Layout(segments, slices)
    groups = max(4, min(-(-size // group_bytes), layout.each * slices))
    with common.arrow_bytes(spark, 16 << 20):
        gathered = durable(gather_counts(train, layout, groups), blobs=True)
    words = gathered.where("key is not null")
    by_power = words.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(
        F.count("*").alias("types"), F.sum("count").alias("tokens")
    )
    powers = sorted(((r["power"], r["types"], r["tokens"]) for r in by_power.collect()), reverse=True)
    kept, least = 0, 0
    for power, types, _ in powers:
        if kept + types > hot_words:
            least = 1 << (power + 1)
            break
        kept += types
    hot = words.where(F.col("count") >= least).select("key", "count").toArrow()
    hot_key = hot.column(0).to_numpy().view(np.uint64)
    order = np.argsort(hot_key)
    narrow = np.int32 if not powers or powers[0][0] < 30 else np.int64
    hot_count = hot.column(1).to_numpy()[order].astype(narrow)
    model = Model(sum(x[2] for x in powers), sum(x[1] for x in powers), hot_key[order], hot_count)
    shared = spark.sparkContext.broadcast(model)
    floor = model.tokens + ALPHA * (model.types + 1)

    def load(number):
        packed = np.zeros(layout.each * SEGMENT // 8, dtype=np.uint8)
        first = number * layout.each
        part = gathered.where((F.col("at") >= first) & (F.col("at") < first + layout.each)).select("at", "bits")
        for r in part.toLocalIterator():
            begin = (r["at"] - first) * SEGMENT // 8
            packed[begin : begin + SEGMENT // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        return spark.sparkContext.broadcast(packed)

    def scorer(number, filter_):
        """Terms of the slice; exact counts come along with the first slice."""
        tag = uuid.uuid4().hex

        def run(rows):
            flat, ends = token_hashes(rows["text"])
            n = len(ends)
            owner = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))))
            word, where = np.unique(flat, return_inverse=True)
            m = shared.value
            at = np.minimum(np.searchsorted(m.hot_key, word), max(len(m.hot_key) - 1, 0))
            is_hot = m.hot_key[at] == word if len(m.hot_key) else np.zeros(len(word), dtype=bool)
            exact = np.where(is_hot, m.hot_count[at], 0) if len(m.hot_key) else np.zeros(len(word))
            known = is_hot if least > 1 else np.ones(len(word), dtype=bool)
            mine = layout.slice_of(word) == number
            counted = exact.astype(float)
            rare = mine & ~known
            counted[rare] = count_of(read_levels(filter_.value, word[rare], layout.segment_of(word[rare])))
            before = contexts(flat)
            use = mine[where]
            pair = pair_key(before[use], flat[use])
            seen = count_of(_recent(tag).read(filter_.value, pair, layout))
            single = counted[where]
            upper = np.log10(np.minimum(seen, single[use]) + WEIGHT * (single[use] + ALPHA) / floor)
            lower = np.log10(counted + WEIGHT)
            spot = np.empty_like(where)
            spot[1:] = where[:-1]
            spot[:1] = np.searchsorted(word, END)
            use_before = mine[spot]
            score = np.bincount(owner[use], weights=upper, minlength=n)
            score -= np.bincount(owner[use_before], weights=lower[spot[use_before]], minlength=n)
            out = {"id": rows["id"], "vid": rows["vid"], "held_out": rows["held_out"], "score": score}
            if number:
                return out
            out["n_tokens"] = np.bincount(owner, minlength=n)
            out["n_known"] = np.bincount(owner[is_hot[where]], minlength=n)
            out["base_score"] = np.bincount(owner[known[where]], weights=m.log_base(exact)[where][known[where]], minlength=n)
            unsure = ~known[where]
            rare, times = np.unique(owner[unsure] * len(word) + where[unsure], return_counts=True)
            split = np.searchsorted(rare // max(len(word), 1), np.arange(1, n))
            out["rare"] = np.split(word[rare % max(len(word), 1)].view(np.int64), split)
            out["times"] = np.split(times, split)
            return out

        return run

    src = src.withColumn("vid", F.xxhash64("text"))
    kind = src.schema["id"].dataType.simpleString()
    part = f"id {kind}, vid long, held_out boolean, score double"
    full = part + ", n_tokens long, n_known long, base_score double, rare array<long>, times array<int>"
    rows = common.map_text_chunks(src, scorer(0, load(0)), full, "text")
    for number in range(1, slices):
        more = common.map_text_chunks(src, scorer(number, load(number)), part, "text")
        more = durable(more.groupBy("id", "vid").agg(F.first("score").alias("more")))
        rows = rows.alias("r").join(more.alias("m"), F.expr("r.id <=> m.id and r.vid = m.vid"), "left")
        rows = rows.select("r.*", "more").withColumn("score", F.col("score") + F.col("more")).drop("more")
    if least > 1:
        rows = durable(rows.withColumn("uid", F.monotonically_increasing_id()))
        asked = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", "x.rare", "x.times")
        few = words.where(F.col("count") < least).select(F.col("key").alias("rare"), "count")
        c = F.coalesce("count", F.lit(0))
        sums = asked.join(few, "rare", "left").groupBy("uid").agg(
            F.sum(F.col("times") * F.log10((c + ALPHA) / floor)).alias("rare_score"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
        rows = rows.join(sums, "uid", "left")
        rows = rows.withColumn("base_score", F.col("base_score") + F.coalesce("rare_score", F.lit(0.0)))
        rows = rows.withColumn("n_known", F.col("n_known") + F.coalesce("rare_known", F.lit(0)))
    return rows.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
