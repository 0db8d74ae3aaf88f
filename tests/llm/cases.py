"""Small tables with awkward rows, for the tests of all operators."""

import random

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, id string, row string, size string, key string, "
    "start string, part string, pack string, score string, place string, block string, copies string, features string, spans string"
)
CLASH = ("?",) * 14

WORDS = "the of and rather quick brown fox jumps over lazy dogs while seven wizards box jovially under éclair straße naïve".split()


def prose(rnd: random.Random, n: int) -> str:
    """Words that hardly ever come together twice, in lines."""
    words = [f"{rnd.choice(WORDS)}{rnd.randrange(400)}" for _ in range(n)]
    lines, at = [], 0
    while at < n:
        step = rnd.randint(15, 60)
        lines.append(" ".join(words[at : at + step]))
        at += step
    return "\n".join(lines)


def texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text, source): prose, exact and near copies, shared passages, nulls, empty and very long texts, ties."""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(40, 220)) for _ in range(24)]
    passage = prose(rnd, 70).replace("\n", " ")
    out = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    out += [(100 + i, base[i], "s0") for i in range(4)]
    for i in range(4, 9):  # one word changed
        words = base[i].split(" ")
        words[len(words) // 2] = "changed"
        out.append((200 + i, " ".join(words), "s1"))
    for i in range(9, 13):  # a passage within a line
        words = base[i].split(" ")
        out.append((300 + i, " ".join([*words[:11], passage, *words[11:]]), "s2"))
    out += [(400, None, "s0"), (401, "", None), (402, " \n\t ", None), (403, "One", "é"), (404, "one", "z"), (405, "a b", "z"), (406, prose(rnd, 6000), "s3")]
    out += [(None, base[13], "s0"), (None, None, None), (15, base[15], "s3"), (15, base[15], "s3"), (17, base[18], "s1")]
    out += [(500, "Licensed under CC BY-NC 4.0. cc by cc by\nSPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)", "s2")]
    return out


def documents(spark, rows: list[tuple] | None = None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *CLASH) for i, t, s in rows], DOCUMENTS).repartition(3)


def groups(ids, links) -> dict:
    """Least member of each id's component."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
