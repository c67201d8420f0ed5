"""Packing of documents into sequences by shortest-pack-first over the length histogram.

Only the histogram of piece lengths (at most max_len rows) meets on the driver.
There whole groups of equal lengths are placed, longest first, into the
shortest packs that have room; the result is a list of packing patterns with
counts. Pieces then find their place by their rank among pieces of equal length.
"""

import zlib
from bisect import insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import common

_tokenizers: dict = {}


class Memo(dict):
    """What fn gives for each key asked for, remembered up to a bounded number of keys."""

    def __init__(self, fn, bound: int):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        self[key] = value = self.fn(key)
        return value


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts by a tokenizers file whose words never span white space.

    Texts are cut at blanks, tabs and line ends. A chunk of Latin-1 is
    lower-cased, cut by the file's own pattern and looked up word by word, so
    that the merges run once for each word met; any other chunk, or one that
    may hold a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str, memory: int = 400_000):
        import json

        from tokenizers import Tokenizer

        from .bpe import latin_split

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = (spec["pre_tokenizer"].get("pretokenizers", []) + [{}, {}])[:2]
        known = [x["type"] for x in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        known &= split.get("type") == "Split" and split.get("invert") is True and level.get("type") == "ByteLevel"
        self.cut = latin_split(split["pattern"]["Regex"]) if known else None
        self.letters = byte_letters()
        self.words = Memo(self._word, memory)
        self.chunks = Memo(self._chunk, memory)
        self.chunks[""] = b""

    def _word(self, word: str) -> bytes:
        found = self.tok.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in found], dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self.cut is not None and "<|" not in chunk and (chunk.isascii() or max(chunk) < "\u0100"):
            return b"".join(map(self.words.__getitem__, self.cut(chunk.lower())))
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        get = self.chunks.__getitem__
        return [
            b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts
        ]


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file, made once in each Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_pieces(df: DataFrame, path: str, max_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Token pieces of at most max_len ids: (id, start, length, ids_crc32, doc_tokens). No shuffle."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    names = ("id", "start", "length", "ids_crc32", "doc_tokens")
    end = int(end_id).to_bytes(4, "little")

    def run(rows):
        out = {k: [] for k in names}
        for i, ids in zip(rows["id"], word_tokenizer(path).encode([t or "" for t in rows["text"]])):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, max_len):
                part = ids[4 * start : 4 * (start + max_len)]
                for k, v in zip(names, (i, start, len(part) // 4, zlib.crc32(part), n)):
                    out[k].append(v)
        return out

    return common.map_text_chunks(src, run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long", "text")


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns: (how many packs, ((length, copies in a pack), ...) longest first).

    Lengths are placed longest first. Of the packs with room, the shortest
    takes the next piece; equal packs move together, so the work depends on the
    number of distinct lengths and not on that of pieces.
    """
    fills: list[int] = []  # of packs that are open, sorted
    packs: dict[int, list[list]] = {}

    def put(fill, count, pattern):
        if fill not in packs:
            packs[fill] = []
            insort(fills, fill)
        packs[fill].append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= max_len:
                fill = fills[0]
                count, pattern = packs[fill].pop()
                if not packs[fill]:
                    del packs[fill]
                    fills.pop(0)
                take = min(count, left)
                if count > take:
                    put(fill, count - take, pattern)
                if pattern and pattern[-1][0] == length:
                    pattern = pattern[:-1] + ((length, pattern[-1][1] + 1),)
                else:
                    pattern += ((length, 1),)
                put(fill + length, take, pattern)
                left -= take
            else:
                put(length, left, ((length, 1),))
                left = 0
    return [(count, pattern) for fill in fills for count, pattern in packs[fill]]


def pattern_slots(patterns: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where ranks go: (length, from rank, to rank, copies in a pack, first sequence, offset of the first copy)."""
    out, used, sequence = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            used[length] = first + count * copies
            out.append((length, first, used[length], copies, sequence, offset))
            offset += length * copies
        sequence += count
    return out


def pack_documents(
    df: DataFrame, path: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", salts: int = 512
) -> DataFrame:
    """Pieces of every document with their place: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they occur. An empty table gives no rows. Ranks among equal lengths are
    counted within salted groups and then shifted by the sizes of the groups
    before, so a length that a third of all pieces share is still dealt over
    salts groups. The table of patterns that is broadcast has at most
    max_len ** 2 / 2 rows, whatever the corpus holds.
    """
    spark = df.sparkSession
    pieces = cut_pieces(df, path, max_len, end_id, id_col, text_col)
    pieces = durable(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)).cast("int")))
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        pattern_slots(shortest_pack_first(histogram, max_len)),
        "length long, lo long, hi long, copies long, first_sequence long, first_offset long",
    )
    before = sizes.select(
        "length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")
    )
    within = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("within", F.row_number().over(within) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("within"))
    )
    step = F.col("rank") - F.col("lo")
    return (
        ranked.join(F.broadcast(slots), "length")
        .where("rank >= lo and rank < hi")
        .select(
            F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first_sequence") + F.floor(step / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + F.pmod(step, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
        )
    )
