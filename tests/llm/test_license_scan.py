import re

import pytest

from cases import documents, texts
from loanloom.llm import license_scan as scan


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_brute_force(spark):
    odd = ["ALL RIGHTS RESERVED all-rights_reserved; all rights\nreserved", "cc\x00by", "éall rights reserved", "cc by" * 3, "Cc.By/cc*by", "general public license"]
    rows = texts() + [(900 + i, t, "x") for i, t in enumerate(odd)]
    found = scan.summarize(scan.scan(documents(spark, rows))).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in found)
    assert got == sorted((str(i), n, b, str(f), str(last), x) for i, t, _ in rows for n, b, f, last, x in [brute(t)])
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in found)
    by = {r.doc_id: r for r in found}
    assert by[500].labels == "cc-by,cc-by-nc,gpl,mit" and by[500].expressions == ["MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)"]
    assert by[400].score == 0 and by[400].labels == ""


@pytest.mark.parametrize(
    ("text", "grade", "labels"),
    [
        ("MIT", 0.2, ["mit"]),
        ("MIT OR GPL-3.0-only", 0.2, ["gpl", "mit"]),
        ("MIT AND GPL-3.0-only", 0.7, ["gpl", "mit"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0", 0.7 * 0.75, ["gpl"]),
        ("MIT OR GPL-3.0-only AND AGPL-3.0-only", 0.2, ["agpl", "gpl", "mit"]),
        ("(MIT OR GPL-3.0-only) AND AGPL-3.0-only", 0.8, ["agpl", "gpl", "mit"]),
    ],
)
def test_expressions(text, grade, labels):
    tokens = text.replace("(", "( ").replace(")", " )").split()
    assert scan.evaluate(tokens) == (pytest.approx(grade), labels)


@pytest.mark.parametrize("text", ["", "OR", "MIT OR", "( MIT", "MIT )", "MIT GPL", "( )", "MIT OR OR GPL"])
def test_malformed_expressions(text):
    assert scan.evaluate(text.split()) is None


def test_longest_well_formed_part_counts():
    assert scan.expression_at("x MIT OR Apache-2.0 licences apply\n", 1)[0] == "MIT OR Apache-2.0"
    assert scan.expression_at("x ( MIT", 1) is None


def test_empty_table(spark):
    assert scan.summarize(scan.scan(documents(spark).filter("false"))).count() == 0
