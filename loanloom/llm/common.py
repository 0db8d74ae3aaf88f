"""What several operators share: word hashes, minima of universal hashes, a bounded filter before a join."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter in ``may_match``: 128 KB, whatever the size of the tables.
FILTER_BITS = 1 << 20
#: Words whose hash a worker remembers; the memory is emptied when full.
WORD_HASHES = 200_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (space, tab to carriage return), with A-Z in lower case."""
    return text.encode().translate(LOWER).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; of fewer words, the whole sequence as one; of none, nothing."""
    n = min(k, len(words))
    if not n:
        return words[:0]
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = mixed(total * _PRIMES[0] + words[i : len(words) - n + 1 + i])
    return total


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set of hashes, whatever their order."""
    with np.errstate(over="ignore"):
        total = mixed(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mixed(total[None])[0].astype(np.int64))


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``set_key`` of many sets that lie one after the other."""
    total = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if len(hashes):
        total[full] = np.add.reduceat(mixed(hashes), (np.cumsum(sizes) - sizes)[full])
    return mixed(total + sizes.astype(np.uint64)).astype(np.int64)


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hashes."""
    draws = np.random.default_rng(seed).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return draws[0] << np.uint64(1) | np.uint64(1), draws[1]


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, stride: int = 1 << 15) -> np.ndarray:
    """The minimum of each universal hash over each (nonempty) set: one row per set, upper 32 bits."""
    out = np.empty((len(sets), len(a)), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= stride):
            held += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for j in range(len(a)):
            out[at:end, j] = np.minimum.reduceat(flat * a[j] + b[j], starts) >> np.uint64(32)
        at = end
    return out


def minima_of_runs(hashes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, stride: int = 1 << 15) -> np.ndarray:
    """``minima`` of (nonempty) sets that lie one after the other."""
    out = np.empty((len(sizes), len(a)), np.uint32)
    ends = np.cumsum(sizes)
    at = held = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, held + stride, side="right")))
        flat, starts = hashes[held : ends[end - 1]], ends[at:end] - sizes[at:end] - held
        for j in range(len(a)):
            out[at:end, j] = np.minimum.reduceat(flat * a[j] + b[j], starts) >> np.uint64(32)
        at, held = end, int(ends[end - 1])
    return out


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y|, for sorted arrays without repeats."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys: 8 to 16 each, up to 16 MB in all."""
    return min(max(FILTER_BITS, 1 << (8 * keys).bit_length()), 1 << 27)


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from the columns (whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def _marked(rows: DataFrame, key: str, keys: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """The rows with a mark (its name is given too): whether their key may be among ``keys`` (first column).

    The mark comes from a bitmap of ``bits`` bits that a distributed aggregation sets; with more keys than bits
    it is true for all rows.  It never misses a key.
    """
    part, place, held, mark = free_names(rows.columns, "_part", "_at", "_bits", "_may")
    bit = _bit(F.col(keys.columns[0]), bits)
    maps = keys.select(F.bitmap_bucket_number(bit).alias(part), F.bitmap_bit_position(bit).alias("bit"))
    maps = maps.groupBy(part).agg(F.bitmap_construct_agg("bit").alias(held))  # 4 KB for each 32,768 bits
    at = _bit(F.col(f"`{key}`"), bits)
    placed = rows.withColumn(part, F.bitmap_bucket_number(at)).withColumn(place, F.bitmap_bit_position(at)).join(F.broadcast(maps), part, "left")
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast({place} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast({place} % 8 as int))")) != 0, F.lit(False))
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), may.alias(mark)), mark


def split_matches(rows: DataFrame, key: str, wanted: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among those of ``wanted`` (first column), and the rows whose key certainly isn't."""
    marked, mark = _marked(rows, key, wanted, bits)
    return marked.filter(F.col(mark)).drop(mark), marked.filter(~F.col(mark)).drop(mark)


def may_match(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be among the keys of ``wanted`` (first column): all that are, and few others.  Thins out a
    wide table before the join that decides; beyond ``FILTER_BITS`` keys all rows pass, which costs time only."""
    return split_matches(rows, key, wanted)[0]


def without(rows: DataFrame, key: str, unwanted: DataFrame) -> DataFrame:
    """The rows whose key isn't among the keys of ``unwanted`` (one column); only rows that may be are shuffled."""
    gone, = free_names(rows.columns, "_gone")
    close, far = split_matches(rows, key, unwanted)
    close = close.join(unwanted.select(F.col(unwanted.columns[0]).alias(gone)), F.col(f"`{key}`") == F.col(gone), "left_anti")
    return far.unionByName(close)


def chunks(items: Iterable, sizes: Iterable[int], most: int):
    """The items in order, in lists whose sizes add up to about ``most``."""
    part, held = [], 0
    for item, n in zip(items, sizes, strict=True):
        part.append(item)
        held += n
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part
