"""Labels permuted within groups, many permutations at a time, in the order of Spark's xxhash64 of (seed, permutation, id)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_P = [np.uint64(p) for p in (0, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(x, by: int):
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _word(k):
    return _turn(k * _P[2], 31) * _P[1]


def _end(h):
    h = (h ^ (h >> np.uint64(33))) * _P[2]
    h = (h ^ (h >> np.uint64(29))) * _P[3]
    return h ^ (h >> np.uint64(32))


def _short(h, k):
    return _turn(h ^ (k * _P[1]), 23) * _P[2] + _P[3]


class Hasher:
    """xxhash64 of a column of integers or strings, from any hash before it; nulls keep that."""

    def __init__(self, ids: pa.Array):
        self.null, kind = ids.is_null().to_numpy(zero_copy_only=False), ids.type
        if pa.types.is_integer(kind):
            self.wide = 8 if kind.bit_width == 64 else 4
            k = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            self.parts = [(slice(None), self.wide, [k] if self.wide == 8 else [], k & np.uint64(0xFFFFFFFF), [])]
            return
        data = ids.fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        text, size, self.parts = np.frombuffer(data.buffers()[2] or b"", np.uint8), np.diff(ends), []
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            rows = text[ends[at][:, None] + np.arange(n)] if n else np.empty((len(at), 0), np.uint8)
            whole = n // 8 * 8
            words = list(np.ascontiguousarray(rows[:, :whole]).view("<u8").T) if whole else []
            half = np.ascontiguousarray(rows[:, whole : whole + 4]).view("<u4")[:, 0].astype(np.uint64) if n - whole >= 4 else None
            self.parts.append((at, n, words, half, list(rows[:, whole + (4 if half is not None else 0) :].T.astype(np.uint64))))

    def __call__(self, seed) -> np.ndarray:
        out = np.empty(len(self.null), np.uint64)
        with np.errstate(over="ignore"):
            seed = np.uint64(seed)
            for at, n, words, half, rest in self.parts:
                h, first = seed + _P[5], 0
                if n >= 32:
                    v = [seed + _P[1] + _P[2], seed + _P[2], seed, seed - _P[1]]
                    while first + 4 <= len(words):
                        v = [_turn(x + words[first + i] * _P[2], 31) * _P[1] for i, x in enumerate(v)]
                        first += 4
                    h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
                    for x in v:
                        h = (h ^ _word(x)) * _P[1] + _P[4]
                h = h + np.uint64(n)
                for k in words[first:]:
                    h = _turn(h ^ _word(k), 27) * _P[1] + _P[4]
                if half is not None and n != 8:
                    h = _short(h, half)
                for b in rest:
                    h = _turn(h ^ (b * _P[5]), 11) * _P[1]
                out[at] = _end(h)
        return np.where(self.null, seed, out).view(np.int64)


def _number(value: int, seed):
    """xxhash64 of one int column."""
    with np.errstate(over="ignore"):
        return _end(_short(np.uint64(seed) + _P[5] + np.uint64(4), np.uint64(value & 0xFFFFFFFF)))


def code_type(size: int):
    """The narrowest type of so many codes."""
    return np.uint8 if size <= 256 else np.uint16 if size <= 65536 else np.uint32


def permuted(nodes: DataFrame, key: list, id_col: str, seed: int, low: int, high: int, parts: int, size: int) -> DataFrame:
    """(key, part, id, codes) of nodes (key, id, code under size): the own code and that after each permutation of a part of low..high, as bytes.

    The n-th node by (hash, id) gets the code of the n-th by id. A task holds the
    ids and codes of one group, and orders them permutation by permutation.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    each, names = -(-(high - low + 1) // parts), [*key, "part", id_col]
    start, kind = _number(seed, 42), code_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [(id_col, "ascending")], null_placement="at_start"))
        first = low + rows.column("part")[0].as_py() * each
        code, hasher = rows.column("code").to_numpy().astype(kind), Hasher(rows.column(id_col).combine_chunks())
        perms = range(first, min(first + each, high + 1))
        out = np.empty((len(code), 1 + len(perms)), kind)
        out[:, 0] = code
        for i, perm in enumerate(perms, 1):
            out[np.argsort(hasher(_number(perm, start)), kind="stable"), i] = code
        wide = out.strides[0]
        for lo in range(0, len(code), 10000):
            n = min(10000, len(code) - lo)
            codes = pa.Array.from_buffers(pa.binary(wide), n, [None, pa.py_buffer(out[lo : lo + n].tobytes())]).cast(pa.binary())
            columns = [rows.column(c).slice(lo, n).combine_chunks() for c in names]
            yield from pa.Table.from_arrays([*columns, codes], names=[*names, "codes"]).to_batches()

    dealt = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-(high - low + 1) // each) - 1)))).groupBy(*key, "part")
    return dealt.applyInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in key], "part int", f"`{id_col}` {kinds[id_col]}", "codes binary"]))


def code_rows(column, size: int) -> np.ndarray:
    """[rows, permutations] of a column of codes under size."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = x.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    kind = np.dtype(code_type(size))
    return np.frombuffer(data.buffers()[2], kind, (ends[-1] - ends[0]) // kind.itemsize, ends[0]).reshape(len(x), -1)


def pair_counts(a: np.ndarray, b: np.ndarray, size: int, rank: np.ndarray, ranks: int) -> np.ndarray:
    """[ranks, size * size, permutations]: how often each pair of codes meets, by rank from 0."""
    width = a.shape[1]
    out = np.zeros(ranks * size * size * width, dtype=np.int64)
    step = max(1, (1 << 21) // width)
    for lo in range(0, len(a), step):
        at = rank[lo : lo + step, None] * (size * size) + a[lo : lo + step].astype(np.int64) * size + b[lo : lo + step]
        out += np.bincount((at * width + np.arange(width)).ravel(), minlength=len(out))
    return out.reshape(ranks, size * size, width)
