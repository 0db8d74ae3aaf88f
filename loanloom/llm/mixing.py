"""Mixing sources to target weights by balanced sampling (the cube method).

A document's share of the mix is its source's target over its source's size: a whole number of copies, and a fraction
that becomes an inclusion probability.  The flight phase moves the probabilities of three documents at a time through
the null space of the two balancing constraints (documents and words of the source) until each is 0 or 1, so both totals
stay as they are.  It runs in blocks of bounded size; what each block leaves open (two documents, and a few kept out of the
flight) meets in fewer blocks, until one block a source is left.  There the small landing problem is solved by giving up
the document total, rounding, and filling up the words still due.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.session import write_scratch

#: Documents that take part in one flight.
BLOCK = 4096
#: Documents, none of the largest, that a block leaves for the next round, and the last block for the landing.
PASSED_ON, RESERVE = 32, 64
#: The parts that weigh in turn, by order of source.
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST = 3
SIZE = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def targets(sized: DataFrame, source: str = "source") -> DataFrame:
    """One row per source: ``place`` (by code point, null last), ``source_size``, ``target``.

    Sources are numbered by a distributed sort and offsets per partition.  Targets fill up by weight: sources whose
    share would exceed ``MOST`` times their size stop there, and the rest is shared anew until none is above.
    """
    spark = sized.sparkSession
    sums = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    numbered = write_scratch(sums.orderBy(F.col(source).asc_nulls_last()).withColumn("_row", F.monotonically_increasing_id()), "sources")
    numbered = numbered.withColumn("_part", F.shiftright("_row", 33)).withColumn("_within", F.col("_row").bitwiseAND((1 << 33) - 1))
    parts = numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row per sort partition
    offsets, before = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in parts):
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = numbered.join(offset, "_part").withColumn("place", F.col("_before") + F.col("_within")).withColumn("weight", weight)
    placed = write_scratch(placed.select(source, "place", "weight", "source_size", "n_docs"), "placed")

    most, full, level = F.col("source_size") * MOST, -1, 0.0
    while True:
        above = most < F.lit(level) * F.col("weight")
        row = placed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, most).otherwise(0)).alias("stopped"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == full or not row["weights"]:
            break
        full, level = row["n"], (row["all"] - row["stopped"]) / row["weights"]
    share = F.lit(level) * F.col("weight")
    return placed.withColumn("target", F.when(most < share, most.cast("double")).otherwise(share))


def flight(size: list[int], chance: list[float], order: list[int], rng: random.Random) -> list[int]:
    """Move ``chance`` (in place) to 0 or 1, three documents at a time, keeping sum(chance) and sum(chance * size);
    returns the documents still open: two at most, or three that no direction moves."""
    waiting, open_ = iter(order), []
    while True:
        while len(open_) < 3 and (k := next(waiting, None)) is not None:
            open_.append(k)
        if len(open_) == 3:
            a, b, c = (size[k] for k in open_)
            u = (1.0, -1.0, 0.0) if a == b else (float(b - c), float(c - a), float(a - b))
        elif len(open_) == 2 and size[open_[0]] == size[open_[1]]:
            u = (1.0, -1.0)
        else:
            return open_
        open_ = _step(chance, open_, u, rng)


def _step(chance: list[float], open_: list[int], u: tuple[float, ...], rng: random.Random) -> list[int]:
    """One move along ``u``, forth or back as far as it goes, by chances that keep each probability on average."""
    forth = min(((1 - chance[k]) / x if x > 0 else chance[k] / -x) for k, x in zip(open_, u, strict=True) if x)
    back = min((chance[k] / x if x > 0 else (1 - chance[k]) / -x) for k, x in zip(open_, u, strict=True) if x)
    by = forth if rng.random() * (forth + back) < back else -back
    still = []
    for k, x in zip(open_, u, strict=True):
        p = chance[k] + by * x
        chance[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
        if _EPS <= p <= 1 - _EPS:
            still.append(k)
    if len(still) == len(open_):  # rounding left all within: settle the one nearest to a bound
        k = min(still, key=lambda k: min(chance[k], 1 - chance[k]))
        chance[k] = float(round(chance[k]))
        still.remove(k)
    return still


def landing(size: list[int], chance: list[float], open_: list[int], reserve: list[int], rng: random.Random) -> None:
    """Settle the last documents: give up the document total, keep the words and round what is left of ``open_``; then
    the documents in ``reserve``, large ones first, fill up the words that are still due."""
    due = sum(chance[k] * size[k] for k in (*open_, *reserve))
    every = open_
    while len(open_) > 1:
        a, b = (size[k] for k in open_[:2])
        u = (float(b), -float(a)) if a and b else (1.0, 0.0) if not a else (0.0, 1.0)
        open_ = _step(chance, open_[:2], u, rng) + open_[2:]
    for k in open_:
        chance[k] = float(chance[k] >= 0.5)
    due -= sum(chance[k] * size[k] for k in every)
    after = sum(size[k] for k in reserve)
    for k in sorted(reserve, key=lambda k: -size[k]):
        after -= size[k]
        take = due >= size[k] or due - after > size[k] / 2
        chance[k] = float(take)
        due -= size[k] * take


def _fly(final: bool, seed: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "id", "size"], kind="stable")
        size, chance = part["size"].tolist(), part["chance"].tolist()
        order = sorted(range(len(size)), key=lambda k: -size[k])
        n = min(RESERVE if final else PASSED_ON, len(order) // 2)
        rest = order[len(order) // 4 :]
        reserve = rest[:: max(1, len(rest) // n)][:n] if n else []
        rng = random.Random(f"{seed} {part['place'].iat[0]} {part['block'].iat[0]} {final}")
        open_ = flight(size, chance, [k for k in order if k not in set(reserve)], rng)
        if final:
            landing(size, chance, open_, reserve, rng)
        return part.assign(chance=chance)

    return run


def draw(sized: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix of a table of ``key``, ``source`` and ``size``: a row each with ``source_size``, ``target`` and ``copies``."""
    sized = write_scratch(sized.select(key, source, "size"), "sized")
    goals = write_scratch(targets(sized, source), "targets")
    same = sized[source].eqNullSafe(goals[source])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shared = sized.join(goals, same).select(sized[key].alias("id"), sized[source].alias("source"), "size", "place", "source_size", "target", share.alias("share"))
    whole = F.floor(F.col("share") + _EPS).cast("long")
    rest = F.greatest(F.col("share") - whole, F.lit(0.0))
    drawn = write_scratch(
        shared.select(
            "id", "source", "size", "place", "source_size", "target", whole.alias("whole"), F.when(rest < _EPS, 0.0).otherwise(rest).alias("chance"),
            F.xxhash64("id", "size", F.lit(seed)).alias("order"), F.lit(0).alias("block"),
        ),
        "chances",
    )
    settled, open_ = [], drawn
    while True:
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(open_.filter(~is_open))
        open_ = open_.filter(is_open)
        counts = open_.groupBy("place").agg(F.count("*").alias("n"))
        blocks = counts.select(F.col("place"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        dealt = open_.join(blocks, "place").withColumn("block", F.pmod(F.xxhash64("order", F.lit(most)), "blocks").cast("int"))
        flown = []
        for final, part in ((True, dealt.filter("blocks = 1")), (False, dealt.filter("blocks > 1"))):
            if final or most > 1:
                flown.append(part.select(drawn.columns).groupBy("place", "block").applyInPandas(_fly(final, seed), drawn.schema))
        open_ = write_scratch(flown[0] if len(flown) == 1 else flown[0].unionByName(flown[1]), "flown")
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    return every.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("whole") + F.col("chance").cast("long")).alias("copies"))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SIZE)), F.lit(0)).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: the key, the source, ``size`` in words, ``source_size``, ``target`` and ``copies``, how
    often the mix takes the document.

    Null and empty texts have size 0; a null source is a source of its own, the last; null keys and repeated rows take
    part as rows of their own; without any words all targets are 0; other columns are left out.
    """
    return draw(docs.select(F.col(key), F.col(source), size_of(text).alias("size")), key, source, seed)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``docs``, with all their columns, each as often as it is taken.

    The same defined cases as in ``mix``; equal rows share what is taken of them evenly.
    """
    rows = docs.withColumn("_row", F.xxhash64(key, source, text))
    drawn = draw(rows.select("_row", source, size_of(text).alias("size")), "_row", source, seed)
    taken = write_scratch(drawn.groupBy("_row").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_equal")).filter("_copies > 0"), "taken")
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    found = rows.join(taken, "_row").withColumn("_nth", nth)
    times = F.expr("_copies div _equal + if(_nth <= _copies % _equal, 1, 0)").cast("int")
    again = F.explode(F.array_repeat(F.lit(0), times))
    return found.withColumn("_again", again).select(*(F.col(f"`{c}`") for c in docs.columns))
