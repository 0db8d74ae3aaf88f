"""Filter interaction audit: what each filter of a chain removes, for every order of the filters.

Documents are counted by part and by the set (mask) of filters that they fail.  For one mask and one step, the orders in
which the first failing filter stands at that step share prefixes, and the permutations that share a prefix are an
interval of their lexicographic (Lehmer) ranks.  So a count is added where such an interval starts and taken away where
it ends, and a prefix sum over the ranks gives what each step of each order removes: nothing is tried out order by order.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.session import write_scratch

#: Fixed values of the five filters.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"


def rank_of(prefix: tuple[int, ...], n: int) -> int:
    """Lexicographic rank of the first permutation of 0..n-1 that starts so: the Lehmer digits in the factorial base."""
    digits = (p - sum(q < p for q in prefix[:i]) for i, p in enumerate(prefix))
    return sum(d * factorial(n - 1 - i) for i, d in enumerate(digits))


def removal_intervals(n: int = len(LETTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, stop): of the orders ranked start to stop - 1, step removes what fails just the mask's filters.

    One row for each prefix and each mask that has its last filter and none before it: n = 5 gives 840.
    """
    out = []
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            rest = [f for f in range(n) if f not in prefix]
            start = rank_of(prefix, n)
            for more in (c for k in range(len(rest) + 1) for c in combinations(rest, k)):
                out.append((sum(1 << f for f in (prefix[-1], *more)), step, start, start + factorial(n - step)))
    return out


def text_failures(text: Column) -> Column:
    """The mask (int) of the filters A to D that a text fails."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE)  # without words one empty string: A and B come out the same
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        F.lit(100).cast("long") * capitals > MOST_CAPITALS * F.char_length(text),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("int")


def count_failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: documents by the set of filters that they fail.

    A null text is empty, a null part is the empty string.  A document fails E if a smaller key has the same text (by
    SHA-256); rows without a key neither fail E nor make others fail, and rows that share key and text don't either.
    Each row counts.  Labels are joined by key; of several for a key, quality 1 or toxic 1 in any of them counts.
    Texts are taken whole, of any length; other columns don't matter; an empty table gives an empty table.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(content, 256)).alias("digest"), text_failures(content).alias("mask")
    )
    rows = write_scratch(rows.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n")), "audited")
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("g"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("t")
    )
    marked = rows.filter("id is not null").join(marks, "id", "left").select(
        "id", "digest", "part", "mask", "n", (F.col("n") * F.coalesce("g", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic")
    )
    counts = ("n", "good", "toxic")
    # copies collapse before they meet: a text gives one row for each of its parts
    texts = marked.groupBy("digest", "part", "mask").agg(*(F.sum(c).alias(c) for c in counts), F.min(F.struct("id", *counts)).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    texts = texts.select("part", "mask", *counts, F.when(F.col("first.id") == least, F.col("first")).alias("first"))
    kept = [F.coalesce(F.col(f"first.{c}"), F.lit(0)) for c in counts]
    split = F.array(
        F.struct(F.col("mask"), *(k.alias(c) for c, k in zip(counts, kept, strict=True))),
        F.struct(F.col("mask").bitwiseOR(1 << LETTERS.index("E")).alias("mask"), *((F.col(c) - k).alias(c) for c, k in zip(counts, kept, strict=True))),
    )
    known = texts.select("part", F.explode(split).alias("cell")).select("part", "cell.*").filter("n > 0")
    keyless = rows.filter("id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(keyless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in counts))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step from the counts by mask (``part``, ``mask``, ``n``, ``good``, ``toxic``).

    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley`` (removed by the
    step's filter, summed over all orders), all long and zero where nothing is.  No cells, no rows.  The tables joined
    here hold 840 and 600 rows for five filters, whatever the input.
    """
    spark, n, counts = cells.sparkSession, len(letters), ("n", "good", "toxic")
    cells = write_scratch(cells, "cells")
    orders = [(r, s + 1, "".join(letters[f] for f in p), letters[f]) for r, p in enumerate(permutations(range(n))) for s, f in enumerate(p)]
    orders = spark.createDataFrame(orders, "rank int, step int, filter_order string, letter string")
    intervals = spark.createDataFrame(removal_intervals(n), "mask int, step int, start int, stop int")

    ends = F.array(F.struct(F.col("start").alias("rank"), *counts), F.struct(F.col("stop").alias("rank"), *((-F.col(c)).alias(c) for c in counts)))
    deltas = cells.join(F.broadcast(intervals), "mask").select("part", "step", F.explode(ends).alias("end")).select("part", "step", "end.*")
    deltas = deltas.groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in counts))

    totals = cells.groupBy("part").agg(F.sum("n").alias("total"))
    grid = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    along = Window.partitionBy("part", "step").orderBy("rank")
    found = grid.join(deltas, ["part", "step", "rank"], "left")
    found = found.select("part", "total", "step", "rank", *(F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in counts))

    failing = F.filter(F.array(*(F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(letters))), lambda f: F.col("mask").bitwiseAND(f["bit"]) != 0)
    fails = cells.select("part", "mask", "n", F.explode(failing).alias("f")).groupBy("part", F.col("f.letter").alias("letter")).agg(
        F.sum("n").alias("fails"), F.sum(F.when(F.col("mask") == F.col("f.bit"), F.col("n")).otherwise(0)).alias("unique_fails")
    )
    rows = found.join(F.broadcast(orders), ["rank", "step"]).join(fails, ["part", "letter"], "left")
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), F.col("n").alias("removed"),
        (F.coalesce("fails", F.lit(0)) - F.col("n")).alias("redundant"), F.coalesce("unique_fails", F.lit(0)).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )
