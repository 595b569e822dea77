"""Spans: phrases, entries in a text, runs of citations, against brute force and by hand."""

from __future__ import annotations

import random

from citeweave.operators import spans


def test_disjoint_takes_from_the_left_and_the_longest(spark):
    rng = random.Random(2)
    rows = [(rng.choice((1, 2, None)), (s := rng.randrange(60)), s + rng.randrange(0, 12), rng.choice("ab")) for _ in range(300)]
    rows += [(7, 3, 9, "b"), (7, 3, 9, "a"), (7, 9, 9, "a"), (7, 9, 10, "c"), (7, 4, 20, "d")]
    got = {tuple(r) for r in spans.disjoint(spark.createDataFrame(rows, "doc_id int, start int, end int, name string")).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        upto = -1
        for k, start, end, name in sorted((r for r in rows if r[0] == key and r[2] > r[1]), key=lambda r: (r[1], -r[2], r[3])):
            if start >= upto:
                want.add((k, start, end, name))
                upto = end
    assert got == want and {(7, 3, 9, "a"), (7, 9, 10, "c")} <= got
    assert spans.disjoint(spark.createDataFrame([], "doc_id int, start int, end int")).count() == 0


def test_phrases_equal_all_substrings(spark):
    rng = random.Random(5)
    phrases = ["iron age", "iron age tomb", "age", "tomb of the kings", "of", "the kings", "iron", " ", "une époque"]
    texts = [(i, " ".join(rng.choice(("Iron", "age", "TOMB", "of", "the", "kings", "x", "une", "époque")) + rng.choice(("", ",", "-")) for _ in range(40))) for i in range(30)]
    texts += [(90, None), (91, ""), (92, "IRON AGE"), (93, "ironage"), (94, "😀 iron  age")]
    got = {tuple(r) for r in spans.phrase_spans(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    import re

    want = set()
    for key, text in texts:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text or "")]
        i = 0
        while i < len(words):
            n = max((len(p.split(" ")) for p in phrases if p.strip() and [w[2] for w in words[i : i + len(p.split(" "))]] == p.split(" ")), default=0)
            if n:
                want.add((key, words[i][0], words[i + n - 1][1], " ".join(w[2] for w in words[i : i + n])))
            i += max(n, 1)
    assert got == want and (94, 2, 11, "iron age") in got


def test_words_of_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "of the iron age tomb"), (1, "of the iron age tomb"), (2, "iron age")], "doc_id int, text string")
    got = spans.phrase_spans(texts, spark.createDataFrame([("iron age tomb",), ("iron",)], "phrase string"))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 20, "iron age tomb"), (2, 0, 4, "iron")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert spans.phrase_spans(texts, spark.createDataFrame([], "phrase string")).count() == 0


def test_entries_are_found_in_order(spark):
    text = "See Abel 2001.\n\nREFERENCES\n[1] Abél, A. (2001). On rivers and their\nmeanders at length. Wa-\nter, 3, 1–9.\n[2] Abel, A. (2001). On rivers and their meanders at length. Water, 4, 1.\n[3] short\n[4] Costa, C. (2003). Estuaries of the south: read otherwise"
    entries = [(1, 1, "Abel, A. (2001). On rivers and their meanders at length. Water, 3, 1-9."), (1, 2, "Abel, A. (2001). On rivers and their meanders at length. Water, 4, 1."), (1, 3, "short"), (1, 4, "Costa, C. (2003). Estuaries of the north and their salt"), (1, 5, "Never there at all, 1999"), (2, 1, "Abel"), (1, 6, None)]
    got = {r.entry_no: text[r.start : r.end] for r in spans.entry_places(spark.createDataFrame([(1, text), (3, None)], "doc int, text string"), spark.createDataFrame(entries, "doc int, entry_no int, entry string")).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].startswith("Abél") and got[1].endswith("1–9.") and got[2].startswith("Abel") and got[2].endswith("4, 1.") and got[4].startswith("Costa, C. (2003). Estuaries of the south")


def test_an_entry_is_not_looked_for_in_a_whole_one_before(spark):
    first, second = "Abel, A., Borg, B., & Costa, C. (1988). Old widget of the economy series. Press.", "Old widget of the economy series. (1989). Journal."
    entries = [(1, 1, first), (1, 2, "Old widget of the economy series, quite another end")]
    got = spans.entry_places(spark.createDataFrame([(1, f"{first}\n{second}")], "doc int, text string"), spark.createDataFrame(entries, "doc int, entry_no int, entry string")).collect()
    assert sorted((r.entry_no, r.start, r.end) for r in got) == [(1, 0, len(first)), (2, len(first) + 1, len(first) + 1 + len(second))]


def runs(spark, text):
    rows = spans.citation_runs(spark.createDataFrame([(1, text)], "doc int, text string")).collect()
    return [(list(r.names), r.second, r.year, r.suffix, r.locator) for r in sorted(rows, key=lambda r: (r.run_no, r.at_no))]


def test_citation_runs(spark):
    assert runs(spark, "(Abel 2019, 2020a: 5–7; see Borg & Costa, 2001, p. 12, 15)") == [(["abel"], "", "2019", "", ""), (["abel"], "", "2020", "a", "5–7"), (["borg", "costa"], "costa", "2001", "", "p. 12, 15")]
    assert runs(spark, "As de Silva et al. (1999b) and, in Norway, Lund's (n.d.) say; Figure 2001; nothing 2002.") == [(["de silva".replace(" ", "")], "", "1999", "b", ""), (["norway", "lund"], "lund", "nd", "", "")]
    assert runs(spark, "World Health Organization (in press), Fabre, Grant and Holm [2011]") == [(["organization"], "", "inpress", "", ""), (["fabre", "grant", "holm"], "", "2011", "", "")]
    assert runs(spark, None) == [] and runs(spark, "No names (2001) here. 12, 1999") == []


def test_runs_are_linked(spark):
    entries = [
        (1, 1, "Abel", "abel", "2019", ""), (1, 2, "Abel", "abelborg", "2020", "a"), (1, 3, "Abel", "abelcosta", "2020", "b"), (1, 4, "de Silva", "desilva", "1999", ""), (1, 5, "World Health Organization", "worldhealthorganization", "2003", ""),
        (1, 6, "Lund", "lund", "1988", ""), (1, 7, "Lund", "lund", "1988", "a"),
    ]
    text = "Abel (2019, 2020b), Abel & Borg 2020, Silva 1999, the Organization (2003), in Russia, Lund (1988), Abel 2020, Nobody 2019"
    made = spark.createDataFrame(entries, "doc int, entry_no int, first string, authors string, year string, suffix string")
    got = {}
    for r in spans.link_runs(spans.citation_runs(spark.createDataFrame([(1, text)], "doc int, text string")), made).collect():
        got.setdefault((r.run_no, r.at_no), set()).add(r.entry_no)
    assert got == {(0, 0): {1}, (0, 1): {3}, (1, 0): {2}, (2, 0): {4}, (3, 0): {5}, (4, 0): {6}, (5, 0): {2, 3}}
