from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import documents, texts
from loanloom.llm import lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    footer, wide = "All rights of this footer are kept by nobody", "É" * 19 + "x"
    out = texts() + [(600 + i, f"own line number {i} of this document\n \t{footer.upper() if i % 2 else footer}\x0b\n{footer}", "s0") for i in range(60)]
    out += [(700 + i, f"{wide}\n{'y' * 19}\n{'é' * 19}\x85\n\n", "s1") for i in range(3)]  # 20, 19 and 20 code points
    out += [(800, "in two rows of one document\r", "a"), (800, "in two rows of one document", "a"), (801, "IN TWO ROWS OF ONE DOCUMENT", "b")]
    out += [(None, footer, "s0"), (None, "only rows without any key hold this", "x")] + [(None, "only rows without any key hold this", "x")] * 3
    return out + [(900, "\n".join([*(f"line {i} of a very long text here" for i in range(20000)), footer]), "s0"), (901, "a\n", "x"), (902, "\n\n", "x"), (903, footer + "\n" + footer, "x")]


def brute(docs, least=3, shortest=20):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for n, (_, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            if len(key(line)) >= shortest:
                holders[key(line)].add(n)
    rank = lambda d: -(2**63) if d is None else d
    last = {k: max(rank(docs[n][0]) for n in v) for k, v in holders.items() if len(v) >= least}
    out = []
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if last.get(key(x), rank(d)) == rank(d)]
        out.append((str(d), len(all_lines), len(all_lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_lines_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("PACK", 2000), ("SHARD", 8), ("SENT", 50), ("PIECE", 3)):
            monkeypatch.setattr(lines, name, value)
    got = lines.drop_common_lines(documents(spark, rows()))
    assert found(got) == brute([(i, t) for i, t, _ in rows()])
    assert sum(r.n_dropped for r in got.collect()) > 100


def test_other_columns_stay_and_own_names_may_clash(spark):
    docs = documents(spark, rows()[-12:])
    names = ["n_lines", "_row1", "_row2", "_drop", "_may", "_part", "_at", "_bits", "r1", "r2", "shard", "lo", "hi", "n", "last", "drop", "lines", "bit"]
    more = docs.select("*", *(F.lit(f"user's {c}").alias(c) for c in names))
    got = lines.drop_common_lines(more)
    assert got.columns == [c for c in more.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert found(got) == brute([(i, t) for i, t, _ in rows()[-12:]])
    assert all(r[c] == f"user's {c}" for r in got.collect() for c in names[1:])


def test_no_documents_and_no_common_lines(spark):
    assert lines.drop_common_lines(documents(spark, [])).collect() == []
    few = [(1, "a line that stands here alone", "x"), (2, None, "x"), (None, "", None)]
    assert found(lines.drop_common_lines(documents(spark, few))) == brute([(i, t) for i, t, _ in few])


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_hash(n):
    rng = np.random.default_rng(n)
    lo, hi = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    lo[: n // 2] = 7  # keys that agree in one half
    index = lines.MinimalHash.of(lo, hi)
    again = lines.MinimalHash(index.sizes, index.bits)
    assert sorted(again.index(lo, hi)) == list(range(n))
    assert len(index.bits) <= max(64, n)  # less than a byte a key
    others = rng.integers(0, 2**64, (2, 1000), dtype=np.uint64)
    assert set(again.index(*others)) <= set(range(-1, n))


def test_query_digest(spark, sf):
    from loanloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {(d, n, k, sha256((t or "").encode()).hexdigest()) for d, n, k, t in brute([tuple(r) for r in docs])}
    assert {(str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op13_lines"](spark, sf).collect()} == expected
