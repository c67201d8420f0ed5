"""Byte-level BPE by a segment tree over byte positions.

Each pre-token is a row of a numpy array; many rows are merged in lockstep. The
tree over a row's byte positions holds in its root the leftmost pair of lowest
rank. A merge changes three leaves (the pair taken, and the pairs with the live
neighbour on either side), each by one climb of log2(length) nodes.
"""

import base64
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_NONE = np.int64(1) << 62
_ROWS = 4096
#: Pieces of 2^LONG bytes or more are merged one by one where a batch holds FEW of a size.
LONG, FEW = 9, 16


class Ranks:
    """A rank file: token bytes by id, and the rank of each mergeable pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, i in self.ids.items():
            tokens[i] = token
        self.tokens = tokens
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, ranks = [], []
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], _NONE)
        self.pair_ranks = np.append(np.array(ranks, dtype=np.int64)[order], _NONE)

    @cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.pair_keys[:-1].tolist(), self.pair_ranks[:-1].tolist()))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where no token is their concatenation."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)


def _merge_rows(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Merge pieces that fit one tree size together; ids of each."""
    n = len(pieces)
    lens = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    width = int(lens.max())
    leaves = 1 << max(1, (width - 1).bit_length())
    bits = leaves.bit_length()
    mask = (1 << bits) - 1
    tok = np.zeros((n, width + 1), dtype=np.int64)
    inside = np.arange(width + 1)[None, :] < lens[:, None]
    tok[inside] = ranks.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    alive = inside.copy()
    nxt = np.tile(np.arange(1, width + 2), (n, 1))
    prv = np.tile(np.arange(-1, width + 1), (n, 1))
    tree = np.full((n, 2 * leaves), _NONE, dtype=np.int64)

    def leaf(rank, pos):
        return np.where(rank < _NONE, rank << bits | pos, _NONE)

    if width > 1:
        first = leaf(ranks.pair(tok[:, :-2], tok[:, 1:-1]), np.arange(width - 1)[None, :])
        first[~inside[:, 1:-1]] = _NONE
        tree[:, leaves : leaves + width - 1] = first
    lo = leaves
    while lo > 1:
        level = tree[:, lo : 2 * lo]
        tree[:, lo // 2 : lo] = np.minimum(level[:, 0::2], level[:, 1::2])
        lo //= 2
    flat = tree.reshape(-1)

    def put(rows, pos, value):
        base = rows * (2 * leaves)
        node = leaves + pos
        flat[base + node] = value
        node = node >> 1
        while node.size and node[0] >= 1:
            at = base + 2 * node
            flat[base + node] = np.minimum(flat[at], flat[at + 1])
            node = node >> 1

    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while rows.size:
        best = tree[rows, 1]
        pos, rank = best & mask, best >> bits
        right = nxt[rows, pos]
        after = nxt[rows, right]
        before = prv[rows, pos]
        tok[rows, pos] = rank
        alive[rows, right] = False
        nxt[rows, pos] = after
        has_after = after < lens[rows]
        prv[rows[has_after], after[has_after]] = pos[has_after]
        put(rows, right, _NONE)
        new = np.full(rows.size, _NONE, dtype=np.int64)
        new[has_after] = ranks.pair(rank[has_after], tok[rows[has_after], after[has_after]])
        put(rows, pos, leaf(new, pos))
        has = before >= 0
        if has.any():
            r, p = rows[has], before[has]
            put(r, p, leaf(ranks.pair(tok[r, p], rank[has]), p))
        rows = rows[tree[rows, 1] < _NONE]
    counts = alive.sum(axis=1)
    return np.split(tok[alive], np.cumsum(counts)[:-1])


def _merge_long(piece: bytes, ranks: Ranks) -> np.ndarray:
    """Merge one long piece by the same tree, node by node; a climb ends where a node keeps its minimum."""
    n = len(piece)
    leaves = 1 << max(1, (n - 1).bit_length())
    bits = leaves.bit_length()
    mask, none = (1 << bits) - 1, int(_NONE)
    first = ranks.single[np.frombuffer(piece, dtype=np.uint8)]
    rank = ranks.pair(first[:-1], first[1:])
    level = np.full(leaves, _NONE, dtype=np.int64)
    level[: n - 1] = np.where(rank < _NONE, rank << bits | np.arange(n - 1), _NONE)
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][0::2], levels[-1][1::2]))
    tree = [none, *np.concatenate(levels[::-1]).tolist()]
    tok, nxt, prv, pair = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), ranks.pairs.get
    alive = bytearray(b"\x01") * n

    def put(pos, value):
        node = leaves + pos
        tree[node] = value
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] < none:
        pos, merged = tree[1] & mask, tree[1] >> bits
        right, before = nxt[pos], prv[pos]
        after = nxt[right]
        tok[pos], alive[right], nxt[pos] = merged, 0, after
        put(right, none)
        new = none
        if after < n:
            prv[after] = pos
            new = pair(merged << 32 | tok[after], none)
        put(pos, new << bits | pos if new < none else none)
        if before >= 0:
            new = pair(tok[before] << 32 | merged, none)
            put(before, new << bits | before if new < none else none)
    return np.array(tok, dtype=np.int64)[np.frombuffer(bytes(alive), dtype=np.uint8) == 1]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Ids of each piece; a piece that is a token is that token. The empty piece has none."""
    out: list = [None] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if p in ranks.ids or not p:
            out[i] = np.array([ranks.ids[p]] if p else [], dtype=np.int64)
        else:
            by_size.setdefault((len(p) - 1).bit_length(), []).append(i)
    for size, at in by_size.items():
        if size >= LONG and len(at) <= FEW:  # merges of so few rows in lockstep cost more than they share
            for i in at:
                out[i] = _merge_long(pieces[i], ranks)
            continue
        step = max(1, min(_ROWS, (1 << 18) >> size))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            for i, ids in zip(part, _merge_rows([pieces[i] for i in part], ranks)):
                out[i] = ids
    return out


class Gather:
    """Concatenates the byte strings that a list of ids stands for."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.lens = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(self.lens) - self.lens

    def __call__(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        if not ends.size:
            return b""
        return self.data[np.repeat(self.starts[ids] - ends + lens, lens) + np.arange(ends[-1])].tobytes()


def latin_split(pattern: str):
    """The pattern for the standard re module, right for texts of Latin-1 only; None if it has other classes.

    re is some times faster than regex but lacks Unicode property classes;
    below code point 256 they are short lists of characters.
    """
    import re

    import regex

    sets = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = regex.compile(name)
        sets[name] = "".join(re.escape(chr(i)) for i in range(256) if found.match(chr(i)))
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((n for n in sets if pattern.startswith(n, i)), None)
        if name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
            i += len(name)
        elif pattern.startswith(r"\S", i) and not inside:
            out.append(f"[^{sets[chr(92) + 's']}]")
            i += 2
        elif pattern[i] == "\\":
            return None
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    try:
        return re.compile("".join(out)).findall
    except re.error:
        return None


class Codec:
    """Encoder and decoder with a bounded memory of pieces met before."""

    def __init__(self, path: str, pattern: str, memory: int = 400_000):
        import regex

        self.ranks = Ranks(path)
        self.any_split = regex.compile(pattern).findall
        self.latin_split = latin_split(pattern)
        self.memory = memory
        self.known: dict[str, bytes] = {}
        self.decode = Gather(self.ranks.tokens)
        self.decimals = Gather([b" %d" % i for i in range(len(self.ranks.tokens))])

    def split(self, text: str) -> list[str]:
        if self.latin_split is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any_split(text)
            return self.latin_split(text)
        return self.any_split(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.split(t) for t in texts]
        new = list(set().union(*pieces).difference(self.known))
        if len(self.known) + len(new) > self.memory:
            self.known = {}
            new = list(set().union(*pieces))
        for p, ids in zip(new, encode_pieces([p.encode() for p in new], self.ranks)):
            self.known[p] = ids.astype("<u4").tobytes()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ps)), dtype="<u4") for ps in pieces]


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file, made once in each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text: (id, ids array<int>).

    A null or empty text has an empty array. Texts are encoded whole; repeated
    rows stay repeated; other columns are not looked at. No shuffle.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(rows):
        ids = codec(path, pattern).encode([t or "" for t in rows["text"]])
        return {"id": rows["id"], "ids": [x.astype("int32") for x in ids]}

    kind = src.schema["id"].dataType.simpleString()
    return common.map_text_chunks(src, run, f"id {kind}, ids array<int>", "text").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are of the decimal ids joined by one space and of the decoded
    bytes, so that a table of any size can be compared without its ids. Null
    and empty texts have no ids and the digests of the empty string.
    """
    import hashlib

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(rows):
        c = codec(path, pattern)
        ids = c.encode([t or "" for t in rows["text"]])
        return {
            "id": rows["id"],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(c.decimals(x)[1:]).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(c.decode(x)).hexdigest() for x in ids],
        }

    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_text_chunks(src, run, schema, "text").withColumnRenamed("id", id_col)
