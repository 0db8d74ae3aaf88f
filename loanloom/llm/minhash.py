"""MinHash near-duplicates: many universal hash minima, banding, signature verification, exact check, components.

Documents with the same shingle set form a class, which one document stands for.  Classes that agree in a band meet in a
bucket.  A bucket never gives all its pairs: its members are compared with one of them (a star).  Only what still belongs to
different components after that is compared in blocks of bounded size, by signatures and then on full sets, and a block
gives no more links than connect its components.  So a large group of near copies costs a few comparisons a member, and
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import chunks, coefficients, jaccard_at_least, may_match, minima_of_runs, set_key, set_keys, shingles, without, word_hashes, words_of
from loanloom.llm.components import components
from loanloom.session import discard, write_scratch

#: Bands and rows of a band: at a similarity of 0.85 all bands miss with a chance of 2e-8, at 0.8 of 4e-6.
BANDS, ROWS = 30, 5
SEED = 20
#: Members of a bucket compared in one block.
BLOCK = 256


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The set of each text: its distinct k-word shingles as sorted hashes."""
    return [np.unique(shingles(word_hashes(words_of(t)), k)) for t in texts]


def joined_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of ``shingle_sets`` one after the other, and the size of each: all texts at once, as most are short."""
    words = [words_of(t) for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = word_hashes(list(chain.from_iterable(words)))
    first = np.cumsum(size) - size
    count = np.where(size >= k, size - k + 1, 0)
    whose = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(whose)) + np.repeat(first - (np.cumsum(count) - count), count)
    found = shingles(flat, k)[at] if len(at) else flat[:0]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):  # the whole sequence as one
        found = np.concatenate([found, *(shingles(flat[first[i] : first[i] + size[i]], k) for i in short.tolist())])
        whose = np.concatenate([whose, short])
    order = np.lexsort((found, whose))
    found, whose = found[order], whose[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])
    return found[new], np.bincount(whose[new], minlength=len(size)).astype(np.int64)


def _features(k: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(hashes, SEED)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sigs, keys, sizes = [], [], []
            for part in chunks(texts, (len(t or "") for t in texts), 1 << 21):
                flat, n = joined_sets(part, k)
                full = n > 0
                raw, width = minima_of_runs(flat, n[full], a, b).astype("<u2").tobytes(), 2 * hashes
                rows = iter(range(0, len(raw), width))
                sigs += [raw[(at := next(rows)) : at + width] if any_ else None for any_ in full.tolist()]
                keys.append(set_keys(flat, n))
                sizes.append(n)
            columns = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sizes, keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(sigs, pa.binary())], ["id", "n", "key", "sig"])

    return run


def _alike(hashes: int, least: float):
    """Pairs whose signatures agree in ``least`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, hashes) for i in (2, 3))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    return run


def _sets_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "key", "members"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [jaccard_at_least(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


class Links:
    """The classes of a table of ``id`` and ``text``, and the links between them."""

    def __init__(self, docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int = ROWS):
        self.docs, self.k, self.percent, self.hashes = docs, k, percent, bands * rows
        share = percent / 100
        # six deviations below the threshold: a link that lies below it is as good as impossible
        self.least = self.hashes * share - 6 * (self.hashes * share * (1 - share)) ** 0.5
        long = docs.schema["id"].dataType.simpleString()
        self.rows = write_scratch(docs.mapInArrow(_features(k, self.hashes), f"id {long}, n long, key long, sig binary"), "signatures")
        full = self.rows.filter("n > 0 and id is not null")
        first = full.groupBy("key").agg(F.min(F.struct("id", "sig")).alias("f"))
        self.classes = write_scratch(first.select("key", F.col("f.id").alias("rep"), F.col("f.sig").alias("sig")), "classes")
        band = F.array(*(F.xxhash64(F.substring("sig", 2 * rows * i + 1, 2 * rows), F.lit(i)) for i in range(bands)))
        self.members = self.classes.select("rep", F.explode(band).alias("bucket"))
        shared = self.members.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n"))
        self.buckets = write_scratch(shared.filter("n > 1 and first <> last"), "buckets")

    def sets(self, ids: DataFrame) -> DataFrame:
        """``id`` and ``members``, the full set, of the classes that some ids stand for; written."""
        ids = write_scratch(ids, "wanted")
        kind = ids.schema["id"].dataType.simpleString()
        texts = may_match(self.docs, "id", ids).join(ids, "id", "left_semi")
        found = texts.mapInArrow(_sets_of(self.k), f"id {kind}, key long, members binary")
        # a repeated id may have several texts: the class knows which one is meant
        own = self.classes.select(F.col("rep").alias("id"), "key").join(ids, "id")
        out = write_scratch(found.join(own, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select("id", "members"), "sets")
        discard(ids)
        return out

    def check(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links: by signatures first, then on full sets; written."""
        sig = self.classes.select("rep", "sig")
        sides = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
        kind = sides.schema["a"].dataType.simpleString()
        alike = write_scratch(sides.select("a", "b", "x", "y").mapInArrow(_alike(self.hashes, self.least), f"a {kind}, b {kind}"), "alike")
        sets = self.sets(alike.select(F.col("a").alias("id")).unionByName(alike.select(F.col("b").alias("id"))).distinct())
        full = alike.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        out = write_scratch(full.select("a", "b", "x", "y").mapInArrow(_linked(self.percent), f"a {kind}, b {kind}"), "links")
        discard(alike, sets)
        return out

    def apart(self, found: DataFrame) -> DataFrame:
        """``rep``, ``comp`` and ``cluster`` of the members of buckets that hold more than one component; written.

        A cluster is what such buckets connect: whoever meets in one of them is in the same.
        """
        comp = F.coalesce("component", "rep")
        met = self.members.join(self.buckets.select("bucket", "first"), "bucket")
        of = write_scratch(met.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "first", "rep", comp.alias("comp")), "placed")
        several = of.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2")
        several = write_scratch(several.select("bucket"), "several")
        far = of.join(several, "bucket")
        clusters = components(far.select(F.col("first").alias("a"), F.col("rep").alias("b")))
        named = clusters.withColumnRenamed("component", "cluster")
        out = write_scratch(far.select(F.col("rep").alias("node"), "comp").distinct().join(named, "node").withColumnRenamed("node", "rep"), "apart")
        discard(of, several, clusters)
        return out

    def star(self) -> DataFrame:
        """Every member of a bucket with the bucket's first."""
        pairs = self.members.join(self.buckets, "bucket").filter("rep <> first")
        return write_scratch(pairs.select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "star")

    def rest(self, apart: DataFrame) -> DataFrame:
        """Links between components of a cluster, compared block by block: by signatures, then on full sets.

        A block gives no more links than it needs to connect what it connects.
        """
        sizes = write_scratch(apart.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
        members = self.sets(apart.select(F.col("rep").alias("id")))
        full = apart.join(self.classes.select("rep", "sig"), "rep").join(members.withColumnRenamed("id", "rep"), "rep")
        mine = F.pmod(F.xxhash64("rep"), "blocks").cast("int")
        placed = full.join(sizes, "cluster").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = placed.select("cluster", "rep", "comp", "sig", "members", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        kind = met.schema["rep"].dataType.simpleString()
        hashes, least, percent = self.hashes, self.least, self.percent

        def compare(block: pa.Table) -> pa.Table:
            comp, rep, mine, sets = (block.column(n).to_pylist() for n in ("comp", "rep", "mine", "members"))
            lo, hi = block.column("lo")[0].as_py(), block.column("hi")[0].as_py()
            sigs = np.frombuffer(b"".join(block.column("sig").to_pylist()), "<u2").reshape(-1, hashes)
            sets = [np.frombuffer(s, np.uint64) for s in sets]
            root = {c: c for c in comp}

            def top(c):
                while root[c] != c:
                    c = root[c]
                return c

            right = np.array([k for k, m in enumerate(mine) if m == hi])
            a, b = [], []
            for i in (k for k, m in enumerate(mine) if m == lo):
                others = right[right > i] if lo == hi else right
                for j in others[(sigs[others] == sigs[i]).sum(axis=1) >= least].tolist() if len(others) else ():
                    x, y = top(comp[i]), top(comp[j])
                    if x != y and jaccard_at_least(sets[i], sets[j], percent):
                        root[max(x, y)] = min(x, y)
                        a.append(min(rep[i], rep[j]))
                        b.append(max(rep[i], rep[j]))
            return pa.table({"a": pa.array(a, block.column("rep").type), "b": pa.array(b, block.column("rep").type)})

        out = write_scratch(met.groupBy("cluster", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}"), "rest")
        discard(sizes, members)
        return out

    def same_set(self) -> DataFrame:
        """Links between ids whose texts differ and whose sets don't."""
        many = self.rows.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last")
        many = write_scratch(many.select("key", "a"), "same")
        same = may_match(self.rows.filter("n > 0").select("id", "key"), "key", many.select("key"))
        return same.join(many, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()

    def linked(self) -> DataFrame:
        """Links enough to connect every component."""
        star = self.star()
        links = self.check(star)
        found = components(links)
        apart = self.apart(found)
        rest = self.rest(apart)
        discard(star, found, apart, self.buckets)
        return links.unionByName(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set is its distinct k-word shingles, or its whole word sequence if it has fewer words.  Documents are
    linked if 100 * shared >= percent * all of their two sets; ``component_id`` is the least key reachable.  Documents
    without words are linked with nothing; a null key has no component and is kept; rows that repeat a key are judged by
    their own texts; other columns are left out.
    """
    found = Links(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), k, percent)
    reached = components(found.linked())
    classes = found.classes.select("key", "rep").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    classes = write_scratch(classes.select("key", F.coalesce("component", "rep").alias("component")), "components")
    discard(reached, found.classes)
    rows = found.rows.select("id", "n", "key").withColumn("class", F.when(F.col("n") > 0, F.col("key"))).drop("key")
    placed = rows.join(classes.withColumnRenamed("key", "class"), "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those documents that a group's least key stands for.

    Rows that share a key are one document here, kept if any of them is; the other cases as in ``near_duplicates``.
    """
    judged = near_duplicates(docs, key, text, k, percent).filter(F.col(key).isNotNull())
    gone = write_scratch(judged.groupBy(key).agg(F.bool_or("kept").alias("any")).filter(~F.col("any")).select(key), "gone")
    return without(docs, key, gone)
