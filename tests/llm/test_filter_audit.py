import re
from collections import Counter
from itertools import permutations

import pytest

from cases import documents, texts
from loanloom.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, id string, n string, mask string, part string"


def rows():
    shouted = " ".join(f"LOUD{i}" for i in range(150))
    same = " ".join(["again"] * 200)
    out = texts() + [(600, shouted, "x"), (601, same, "x"), (602, same, "x"), (590, same, "x"), (603, same + " #", "x"), (604, "a b c " * 60, "x"), (None, same, "x")]
    return out + [(700 + i, same, "x") for i in range(40)]  # one very common text


def table(spark):
    langs = ["en", None, "", "fr"]
    df = documents(spark, rows())
    return spark.createDataFrame([(*r[:2], langs[i % 4], *r[3:]) for i, r in enumerate(df.collect())], df.schema).repartition(3)


def brute(docs, labels):
    """Every document against every order, one by one."""
    good, toxic = ({d for d, *x in labels if x[i] == 1} for i in (0, 1))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = Counter()
    parts = {p or "" for *_, p in docs}
    for d, t, p in docs:
        t, p = t or "", p or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for s, f in enumerate(order, 1):
                if tests[f] and not gone:
                    gone = True
                    for what in ("removed", *["good_lost"] * (d in good), *["toxic_lost"] * (d in toxic)):
                        out[p, order, s, what] += 1
                    out[p, f, "shapley"] += 1
                elif tests[f]:
                    out[p, order, s, "redundant"] += 1
                out[p, order, s, "kept"] += not gone
                out[p, order, s, "unique_fails"] += tests[f] and sum(tests.values()) == 1
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s): (*(out[p, o, s, n] for n in names), out[p, o[s - 1], "shapley"]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


def test_every_order_against_brute_force(spark):
    docs = table(spark)
    labels = [(600, 1, 0), (601, 0, 1), (590, 1, None), (590, None, 1), (None, 1, 1), (3, 1, 0), (100, 1, 1), (9999, 1, 1), (15, 1, 0), (710, 1, 0)]
    marks = spark.createDataFrame([(*x, "?", "?", "?", "?") for x in labels], LABELS)
    found = filter_audit.audit(filter_audit.count_failures(docs, marks)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found}
    assert len(got) == len(found)
    plain = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert got == brute(plain, [x for x in labels if x[0] is not None])


def test_empty_tables(spark):
    empty, none = documents(spark, []), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.count_failures(empty, none)).collect() == []
    found = filter_audit.audit(filter_audit.count_failures(documents(spark, [(1, None, "x")]), none)).collect()
    assert len(found) == 600 and {r.removed for r in found if r.filter_order[0] == "A" and r.step == 1} == {1}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_intervals_cover_each_order_once(n):
    orders = list(permutations(range(n)))
    seen = Counter()
    for mask, step, start, stop in filter_audit.removal_intervals(n):
        for rank in range(start, stop):
            assert mask >> orders[rank][step - 1] & 1 and not any(mask >> f & 1 for f in orders[rank][: step - 1])
            seen[mask, rank] += 1
    assert seen == {(m, r): 1 for m in range(1, 1 << n) for r in range(len(orders))}
    assert [filter_audit.rank_of(p, n) for p in orders] == list(range(len(orders)))
