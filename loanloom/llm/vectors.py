"""What the two vector searches share: usable vectors, classes of equal ones, and the way from classes back to rows.

Equal vectors form a class that is searched once; a class keeps no more ids than a result can name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.session import write_scratch

#: Rows whose id this divides are queries.
EVERY = 20


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows with an id and a vector of finite components, repeated rows once."""
    found = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return found.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)


def classes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: classes of equal vectors (``rep``, the least id; ``v``; ``ids``, the k + 1 least; ``query``, whether a
    query is among all of them), and the queries (``query_id``, ``rep``)."""
    vectors = write_scratch(vectors.distinct(), "vectors")
    first = vectors.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    named = first.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    asked = vectors.filter(F.col("id") % EVERY == 0)
    has_query = asked.select("v").distinct().withColumn("query", F.lit(True))
    table = write_scratch(named.join(has_query, "v", "left").select("rep", "v", "ids", F.coalesce("query", F.lit(False)).alias("query")), "classes")
    queries = write_scratch(asked.join(table.filter("query").select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep"), "queries")
    return table, queries


def best(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group: highest score, then least id (the last of ``by``)."""
    order = Window.partitionBy(*by[:-1]).orderBy(F.desc("score"), by[-1])
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def results(found: DataFrame, table: DataFrame, queries: DataFrame, own: Callable[[Column], Column], k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` from the best classes (``query``, ``rep``, ``score``) of each query class.

    ``own`` gives a class's score with itself, for the other ids of a query's class.
    """
    itself = table.filter(F.col("query") & (F.size("ids") > 1)).select(F.col("rep").alias("query"), "rep", own(F.col("v")).alias("score"))
    classes_of = best(found.select("query", "rep", "score"), k, "query", "rep").drop("rank").unionByName(itself)
    ids = classes_of.join(table.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("vec_id"), "score")
    ids = write_scratch(best(ids, k + 1, "query", "vec_id").drop("rank"), "ids")  # one of them may be the query itself
    rows = queries.withColumnRenamed("rep", "query").join(ids, "query").filter("vec_id <> query_id")
    return best(rows, k, "query_id", "vec_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
