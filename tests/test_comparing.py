"""Differences of texts and records, aligned word by word, against all alignments."""

from __future__ import annotations

import random
from functools import cache

from citeweave.operators import comparing as c


def cheapest(said, meant):
    @cache
    def rest(i, j):
        able = [c.ALONE * (len(said) - i + len(meant) - j)]
        if i < len(said) and j < len(meant):
            able.append(c.COSTS.get(c.likeness(said[i], meant[j]), c.UNLIKE) + rest(i + 1, j + 1))
        if i < len(said):
            able.append(c.ALONE + rest(i + 1, j))
        if j < len(meant):
            able.append(c.ALONE + rest(i, j + 1))
        return min(able)

    return rest(0, 0)


def test_likeness():
    cases = [
        ("lake", "lake", "same"), ("Lake", "lake", "case"), ("Öster", "oster", "accent"), ("laek", "lake", "spelling"), ("lak", "lake", None), ("oxygen", "oxigen", "spelling"), ("A", "B", "initial"), ("1999", "2001a", "year"), ("12", "13", "number"),
        ("1999", "12", "number"), ("carp", "lake", None), ("observations", "obsrevatoins", "spelling"), ("高地", "高原", None), ("", "", "same"),
    ]
    assert [(a, b, c.likeness(a, b)) for a, b, _ in cases] == cases


def test_alignments_are_the_cheapest():
    rng = random.Random(3)
    pool = ["lake", "laek", "Lake", "carp", "1999", "2000", "12", "A", "B", "öre", "ore", "oxygen", "oxigen"]
    for _ in range(400):
        said, meant = ([rng.choice(pool) for _ in range(rng.randint(0, 7))] for _ in range(2))
        found = c.aligned(said, meant)
        assert [s for _, s, _ in found if s is not None] == said and [m for *_, m in found if m is not None] == meant
        assert sum(c.ALONE if k in ("missing", "extra") else c.COSTS.get(k, c.UNLIKE) for k, *_ in found) == cheapest(tuple(said), tuple(meant))


def test_differences_of_rows(spark):
    rows = [(1, "Orrin, A. (2011). Oxigen loss in lakes", "Orrin, A. (2012). Oxygen loss in upland lakes"), (2, None, "one word"), (3, "", None), (4, "a b", "a b"), (None, "x", "x y"), (4, "Öre", "Ore"), (5, "w " * 5_000, "w")]
    df = spark.createDataFrame(rows, "id bigint, text string, record string")
    got = [tuple(r) for r in c.differences(df).filter("coalesce(id, 0) <> 5").collect()]
    assert sorted(got, key=repr) == sorted([
        (1, 0, "year", "2011", "2012"), (1, 1, "spelling", "Oxigen", "Oxygen"), (1, 2, "missing", None, "upland"), (2, 0, "missing", None, "one"), (2, 1, "missing", None, "word"), (None, 0, "missing", None, "y"), (4, 0, "accent", "Öre", "Ore"),
    ], key=repr)
