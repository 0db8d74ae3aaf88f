"""Line dedup: common lines are looked up in sharded minimal perfect hash tables instead of being joined.

Texts are read in packs of bounded size.  A pack sends each of its distinct line hashes once, so a line that a third of
all documents hold arrives once per pack.  Counts and largest holders are added up by hash; the lines found often enough
are dealt to shards, and each shard becomes a minimal perfect hash (levels of collision-free bits) that indexes three
compact arrays: fingerprints, counts and largest holders.  Packs send their hashes to the shards, which answer only what
is common, and each pack turns its answers into the lines to drop.  Only texts that lose a line are then moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import filter_bits, free_names, mixed, split_matches
from loanloom.session import write_scratch

#: Code points and documents that make a line a common one, and the characters stripped off a line.
SHORTEST, LEAST, SPACE = 20, 3, " \t\n\x0b\x0c\r"
#: Bytes of text in a pack; common lines of a shard and hashes sent to a shard, both on average; hashes in a row.
PACK, SHARD, SENT, PIECE = 1 << 22, 1 << 16, 1 << 20, 512
#: Bits of a level for each key that is left.
ROOM = 2
#: Stands for a null key: below every other (the least long is taken for it).
NO_KEY = np.iinfo(np.int64).min

PACKS = "pack long, lo binary, hi binary, n binary, last binary, rows binary, ids binary, doc binary, line binary, at binary, lines binary"
DEALT = "shard long, pack long, sizes array<long>, a binary, b binary, c binary, d binary"


class MinimalHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers, about three bits a key.

    Each level has ``ROOM`` bits for every key still left; a key that is alone at its place sets the bit and is done.
    The number of set bits before a key's own is its index.
    """

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, bits
        self.flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        self.before = np.cumsum(self.flags, dtype=np.int64) - self.flags

    @staticmethod
    def places(lo: np.ndarray, hi: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(lo ^ mixed(hi + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, lo: np.ndarray, hi: np.ndarray) -> MinimalHash:
        sizes, levels, left = [], [], np.arange(len(lo))
        while len(left):
            size = -(-max(ROOM * len(left), 64) // 8) * 8
            at = cls.places(lo[left], hi[left], len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(size, bool)
            flags[at[alone]] = True
            sizes.append(size)
            levels.append(np.packbits(flags))
            left = left[~alone]
        return cls(sizes, b"".join(x.tobytes() for x in levels))

    def index(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The index of each key; of pairs that are no keys, any index or -1."""
        out, left, base = np.full(len(lo), -1, np.int64), np.arange(len(lo)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.places(lo[left], hi[left], level, size)
            hit = self.flags[at]
            out[left[hit]] = self.before[at[hit]]
            left, base = left[~hit], base + size
        return out


def compact(values: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest width that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def line_hashes(texts: pa.Array, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text the number of lines; of every line whose key is long enough its text, its place there, and its
    128-bit hash (two columns)."""
    lines = pc.split_pattern(texts, "\n")
    n = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=SPACE))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), shortest).to_numpy(zero_copy_only=False))
    doc = np.repeat(np.arange(len(n)), n)[long]
    place = long - (np.cumsum(n) - n)[doc]
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(long)).cast(pa.binary()).to_pylist()))
    return n, doc, place, np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def _pack(batch: pa.RecordBatch, shortest: int, pack: int) -> pa.RecordBatch:
    ids = batch.column(2).fill_null(int(NO_KEY)).to_numpy(zero_copy_only=False)
    n, doc, place, h = line_hashes(batch.column(3), shortest)
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(axis=1)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    h = h[order[new]]
    held, holder = np.divmod(np.unique(at * len(ids) + doc), len(ids))  # each line once a document
    starts = np.searchsorted(held, np.arange(len(h)))
    last = np.maximum.reduceat(ids[holder], starts) if len(h) else ids[:0]
    rows = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
    columns = (h[:, 0], h[:, 1], np.diff(np.append(starts, len(held))), last, rows, ids, doc.astype(np.int32), place.astype(np.int32), at.astype(np.int32), n)
    names = [c.split()[0] for c in PACKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns)], names)


def _packs(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = np.cumsum(pc.add(pc.binary_length(batch.column(3)), 64).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.searchsorted(held, np.arange(PACK, held[-1] + PACK, PACK), "right") if len(held) else []
            for a, b in zip([0, *cuts], [*cuts, len(held)], strict=True):
                if a < b:
                    yield _pack(batch.slice(a, b - a), shortest, pack)
                    pack += 1

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of a pack."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in row], ["lo", "hi", "n", "last"])


def _arrays(table: pa.Table) -> pa.Table:
    """One shard: its hash and, in the order of its indices, fingerprints, counts and largest holders."""
    lo, hi, n, last = (table[c].to_numpy() for c in ("lo", "hi", "n", "last"))
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    index = MinimalHash.of(lo, hi)
    order = np.argsort(index.index(lo, hi))
    row = [table["shard"][0].as_py(), None, index.sizes, index.bits, hi[order].tobytes(), compact(n[order]), last[order].tobytes()]
    return pa.table([pa.array([v], t) for v, t in zip(row, _DEALT.types, strict=True)], schema=_DEALT)


_DEALT = pa.schema([("shard", pa.int64()), ("pack", pa.int64()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in "abcd")])


def _deal(shards: int):
    """The hashes of each pack, to their shards in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = np.frombuffer(lo, np.int64), np.frombuffer(hi, np.int64)
                shard = hi % shards
                order = np.argsort(shard, kind="stable")
                rows = []
                for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    for piece in (at[i : i + PIECE] for i in range(0, len(at), PIECE)):
                        rows.append((int(shard[piece[0]]), pack, None, lo[piece].tobytes(), hi[piece].tobytes(), piece.astype(np.int32).tobytes(), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT.types, strict=True)], schema=_DEALT)

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over sorted rows, the arrays of a shard before the hashes sent to it; answers what is found."""
    of, index = None, None
    for batch in batches:
        out = []
        for shard, pack, sizes, a, b, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if pack is None:
                of, index, prints, last = shard, MinimalHash(sizes, a), np.frombuffer(b, np.uint64), np.frombuffer(d, np.int64)
                counts = np.frombuffer(c, f"u{len(c) // len(last)}")
            elif shard == of:
                lo, hi = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                slot = index.index(lo, hi)
                found = np.flatnonzero((slot >= 0) & (prints[slot] == hi))
                if len(found):
                    slot = slot[found]
                    out.append((pack, np.frombuffer(c, np.int32)[found].tobytes(), counts[slot].astype(np.int64).tobytes(), last[slot].tobytes()))
        if out:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["pack", "found", "n", "last"])


def _masks(pack: pa.Table, answers: pa.Table) -> pa.Table:
    """Of each document of a pack that loses a line, which lines go."""
    drops, keys = [], []
    if pack.num_rows and answers.num_rows:
        row = {c: pack[c][0].as_py() for c in pack.column_names}
        doc, place, at = (np.frombuffer(row[c], np.int32) for c in ("doc", "line", "at"))
        ids, n = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lines"], np.int64)
        rows = np.frombuffer(row["rows"], np.int64).reshape(-1, 2)
        common, last = np.zeros(int(at.max()) + 1, bool), np.zeros(int(at.max()) + 1, np.int64)
        for found, holder in zip(answers["found"].to_pylist(), answers["last"].to_pylist(), strict=True):
            found = np.frombuffer(found, np.int32)
            common[found], last[found] = True, np.frombuffer(holder, np.int64)
        gone = common[at] & (last[at] != ids[doc])
        losers, starts = np.unique(doc[gone], return_index=True)
        for d, places in zip(losers, np.split(place[gone], starts[1:]), strict=False):  # nothing to split gives a piece too
            mask = np.zeros(n[d], bool)
            mask[places] = True
            drops.append(mask)
            keys.append(rows[d])
    keys = np.array(keys, np.int64).reshape(-1, 2)
    return pa.table({"r1": keys[:, 0], "r2": keys[:, 1], "drop": pa.array(drops, pa.list_(pa.bool_()))})


def common_lines(packs: DataFrame, least: int) -> DataFrame:
    """``lo``, ``hi``, ``n``, ``last``: hashes of lines in at least so many documents, with their number and the largest
    key among them.  Added up in each task before the shuffle."""
    entries = packs.select("lo", "hi", "n", "last").mapInArrow(_entries, "lo long, hi long, n long, last long")
    return entries.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= least)


def lookup(packs: DataFrame, common: DataFrame) -> DataFrame:
    """``pack``, ``found``, ``n``, ``last``: the common lines among each pack's hashes, from the shards' arrays."""
    sent = packs.agg(F.sum(F.octet_length("lo") / 8)).first()[0] or 0
    shards = 1 + max(common.count() // SHARD, int(sent) // SENT)
    arrays = common.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInArrow(_arrays, DEALT)
    dealt = packs.select("pack", "lo", "hi").mapInArrow(_deal(shards), DEALT)
    met = arrays.unionByName(dealt).repartition("shard").sortWithinPartitions("shard", F.col("pack").asc_nulls_first())
    return met.mapInArrow(_probe, "pack long, found binary, n binary, last binary")


def drop_common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with all its columns, ``text`` without its common lines, ``n_lines`` (before) and ``n_dropped``.

    Lines end at \\n.  A line's key is the line without white space at its ends, A-Z in lower case; keys of at least
    ``shortest`` code points in at least ``least`` documents keep their lines only in the document of largest key (an
    integer), all of them.  Each row is a document, also a repeated one; rows that share the largest key all keep it.  A
    null key is smaller than every other.  Null texts stay null and count as one empty line; a text may become empty but
    its row stays; texts are taken whole, of any length.  Columns already named ``n_lines`` or ``n_dropped`` are
    replaced, other names don't matter.  Lines are told apart by 128 bits.  An empty table gives an empty table.
    """
    r1, r2 = free_names(docs.columns, "_row1", "_row2")
    rows = docs.withColumns({r1: F.xxhash64(F.col(key), F.col(text)), r2: F.xxhash64(F.col(text), F.col(key))})
    read = rows.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packs = write_scratch(read.mapInArrow(_packs(shortest), PACKS), "packs")
    common = write_scratch(common_lines(packs, least), "common-lines")
    answers = lookup(packs, common)
    masks = packs.select("pack", "rows", "ids", "doc", "line", "at", "lines").groupBy("pack").cogroup(answers.select("pack", "found", "last").groupBy("pack"))
    masks = write_scratch(masks.applyInArrow(_masks, "r1 long, r2 long, drop array<boolean>").dropDuplicates(["r1", "r2"]), "masks")
    drop, = free_names([*docs.columns, r1, r2], "_drop")
    masks = masks.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("drop").alias(drop))
    losing, whole = split_matches(rows, r1, masks, filter_bits(masks.count()))
    losing = losing.join(masks, [r1, r2], "left")
    rows = losing.unionByName(whole.withColumn(drop, F.lit(None).cast("array<boolean>")))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    kept = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.get(F.col(drop), i)), "\n"))
    gone = F.coalesce(F.size(F.filter(drop, lambda x: x)), F.lit(0))
    old = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return rows.select(
        *(kept.alias(c) if c == text else F.col(f"`{c}`") for c in old), F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(gone).cast("long").alias("n_dropped"),
    )
