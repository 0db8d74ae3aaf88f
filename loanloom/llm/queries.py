"""Named queries over the shared tables: one thin query for each operator.  SQL stands beside a query it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import byte_bpe, curves, filter_audit, license_scan, lines, minhash, mixing, paragraphs, pivots, quality, repeats, token_counts, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the 32k piece model."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions of every document."""
    return license_scan.summarize(license_scan.scan(documents(spark, sf_dir)))


@query(
    "op4_minhash",
    """
    WITH RECURSIVE worded AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingled AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)),
    reached(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.id, links.y FROM reached JOIN links ON reached.other = links.x)
    SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reached GROUP BY 1) c USING (doc_id)
    """,
)
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(documents(spark, sf_dir), k=3, percent=85)


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again by the 50k multilingual byte vocabulary."""
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source weights: words taken of each document, copies counted."""
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query("op10_repeats")
def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document also has, removed from every document."""
    return repeats.remove_repeats(documents(spark, sf_dir))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from preference pairs of labelled ones."""
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op3_hilbert_neighbours")
def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth vector, by inner product."""
    return curves.search(embeddings(spark, sf_dir))


@query(
    "op8_pivot_search",
    """
    WITH whole AS (
      SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM scored) WHERE nth <= 20
    """,
)
def op8_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    return pivots.search(embeddings(spark, sf_dir))


@query("op6_paragraphs")
def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the paragraphs and passages that an earlier document has, and what was cut out of it."""
    cut = paragraphs.remove_paragraphs(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    first = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["first"])))
    return cut.select("doc_id", "text", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", first.alias("earlier_docs"))


@query(
    "op12_filter_audit",
    """
    WITH texts AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             regexp_matches(coalesce(text, ''), '[#$%&*|]') AS symbols FROM documents),
    marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS g, max(CAST(toxic = 1 AS INTEGER)) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    failing AS (
      SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN symbols THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM texts),
    cells AS (SELECT part, fails, count(*) AS n, sum(coalesce(g, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM failing LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
               WHERE a.l <> b.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)),
    steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS l, substr(filter_order, 1, step - 1) AS before
              FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    hits AS (
      SELECT part, filter_order, step, l, sum(n) AS total, sum(CASE WHEN contains(fails, l) THEN n ELSE 0 END) AS failed, sum(CASE WHEN fails = l THEN n ELSE 0 END) AS single,
             sum(CASE WHEN here THEN n ELSE 0 END) AS removed, sum(CASE WHEN here THEN good ELSE 0 END) AS good, sum(CASE WHEN here THEN toxic ELSE 0 END) AS toxic
      FROM (SELECT *, contains(fails, l) AND length(translate(fails, before, '')) = length(fails) AS here FROM cells, steps) GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, CAST(total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
           CAST(removed AS BIGINT) AS removed, CAST(failed - removed AS BIGINT) AS redundant, CAST(single AS BIGINT) AS unique_fails,
           CAST(good AS BIGINT) AS good_lost, CAST(toxic AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
    FROM hits
    """,
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each language's documents, in all 120 orders."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.count_failures(documents(spark, sf_dir), labels))


@query(
    "op13_lines",
    """
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT row, doc_id, unnest(l) AS line, unnest(range(len(l))) AS nth FROM texts),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row) >= 3),
    judged AS (SELECT row, doc_id, line, nth, common.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN common USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY row, doc_id
    """,
)
def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more documents hold, but for the largest of these."""
    kept = lines.drop_common_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _vector_code_sql(rounds: int = 4) -> str:
    """Plain product codes: every part against every entry, round by round."""
    near = """
    near{k} AS MATERIALIZED (
      SELECT row, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
      FROM (SELECT row, part, entry, CAST(pp - 2 * list_inner_product(p, c) + list_inner_product(c, c) AS BIGINT) AS d FROM parts JOIN book{k} USING (part)) GROUP BY 1, 2),"""
    book = """
    book{n} AS MATERIALIZED (
      SELECT part, entry, coalesce(mean, c) AS c FROM book{k} LEFT JOIN (
        SELECT part, entry, list(m ORDER BY pos) AS mean FROM (
          SELECT part, entry, pos, floor(sum(x) / count(*)) AS m FROM (SELECT row, part, unnest(p) AS x, unnest(range(len(p))) AS pos FROM parts) JOIN near{k} USING (row, part)
          GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (part, entry)),"""
    steps = "".join(near.format(k=k) + book.format(k=k, n=k + 1) for k in range(rounds)) + near.format(k=rounds)
    return f"""
    WITH kept AS (
      SELECT row_number() OVER () AS row, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    part_no AS (SELECT unnest([0, 1, 2, 3]) AS part),
    parts AS MATERIALIZED (SELECT row, vec_id, part, p, list_inner_product(p, p) AS pp FROM (
      SELECT row, vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS p FROM kept, part_no)),
    book0 AS MATERIALIZED (
      SELECT part, entry, p AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL)) USING (vec_id)
      WHERE entry < 256),{steps}
    digest AS (
      SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS pos FROM book{rounds})),
    coded AS (SELECT row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), digest
    """


@query("op11_vector_codes", _vector_code_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of all vectors, with their errors and the errors of their labels."""
    coded, books = vector_codes.compress(embeddings(spark, sf_dir))
    found = vector_codes.label_errors(coded).withColumn("codebooks_sha256", F.lit(vector_codes.books_digest(books)))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
