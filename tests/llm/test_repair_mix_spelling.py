"""Conversation repair, mixing and spelling variants against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from citeweave.llm import conversations, mixing, queries, spelling

TALK = "conv_id bigint, turn bigint, role string, text string, key string, mark boolean, dropped int"
DOCS = "doc_id bigint, text string, source string, size string, s int, part string"


def cheapest(rows):
    """(cost, audit) by relaxing every (position, state) with the least (cost, audit)."""
    best, follows = {(0, "-"): (0, "")}, {"-": "u", "s": "u", "u": "a", "a": "u"}

    def put(at, found):
        best[at] = min(best.get(at, found), found)

    for i in range(len(rows) + 1):
        for _ in range(3):
            for state in "-sua":
                if (i, state) in best:
                    cost, audit = best[i, state]
                    put((i, follows[state]), (cost + 5, audit + "I"))
        if i < len(rows):
            initial, fault = rows[i]
            for state in "-sua":
                if (i, state) in best:
                    cost, audit = best[i, state]
                    put((i + 1, state), (cost + 2, audit + "D"))
                    if fault not in ("blank", "duplicate"):
                        cost += 5 * (fault == "truncated")
                        put((i + 1, follows[state]), (cost + 1, audit + "R"))
                        if initial == follows[state] or (initial == "s" and state == "-"):
                            put((i + 1, initial), (cost, audit + "K"))
    return min(best[len(rows), s] for s in "-a" if (len(rows), s) in best)


def repaired(rows):
    """The whole operator, row by row, over (conv_id, turn, role, text)."""
    talks = {}
    for conv, turn, role, text in rows:
        held = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        held += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = {}
    for conv, held in talks.items():
        held.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in held:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f) for r, f in zip(held, faults, strict=True)])
        state, at, lines = "-", 0, []
        for letter in audit:
            role, text = {"u": "user", "a": "assistant"}[{"-": "u", "s": "u", "u": "a", "a": "u"}[state]], ""
            if letter != "I":
                role, text = held[at][1] if letter == "K" else role, held[at][2]
                at += 1
            if letter != "D":
                lines.append(f"{role}:{text}")
                state = role[0]
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(held))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_talks(rng, n):
    texts = ["Yes.", "No!", "why?  \n", "cut short", "", " \t", None, "é. ü?", "Yes.", "x" * 5_000 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice((1, 2, 4, 7, 30))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", None, "tool", ""))
            rows.append((conv, rng.choice((turn, turn, turn, turn + 3, None)), role, rng.choice(texts)))
    rows += [(None, None, None, None)] * 3 + [(None, 2, "user", "Hi.")] * 2 + [(n, t, "user", "same text.") for t in range(40)]
    # A conversation of which every row is dropped.
    gone = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Hi.")]


@pytest.mark.parametrize("block", [1, 5, 16])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    rows = odd_talks(random.Random(block), 60)
    want = repaired(rows)
    # Workers import the module anew, so other blocks are tried here.
    df = spark.createDataFrame([(*r, "clash", True, 3) for r in rows], TALK)
    if block == 16:
        got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_conversations(df).collect()}
    else:
        monkeypatch.setattr(conversations, "BLOCK", block)
        got = {}
        for conv, (gaps, *_) in want.items():
            talk = conversations.Conversation(conv)
            damaged = conversations.damage(df.filter(df.conv_id.eqNullSafe(conv))).filter("not dropped") if conv in (0, 1, None) else None
            if damaged is None:
                continue
            seen, key = set(), lambda r: ((r.turn is not None, r.turn or 0), r.role, hashlib.sha256(f"{len(r.role)}:{r.role}{r.text}".encode()).digest())
            for r in sorted(damaged.collect(), key=key):
                talk.add(r.turn, r.role, r.text, (r.role, r.text) in seen)
                seen.add((r.role, r.text))
            got[conv] = talk.result()[1:]
        want = {c: want[c] for c in got}
    assert got == want


def test_search_in_blocks_is_exact(monkeypatch):
    rng, roles = random.Random(3), ("user", "assistant", "user", "assistant", "system", "tool", "")
    texts = {"": "Hi.", "truncated": "Hi", "blank": " "}
    for block in (1, 3, 16):
        monkeypatch.setattr(conversations, "BLOCK", block)
        for _ in range(300):
            talk, rows = conversations.Conversation(1), []
            for i in range(rng.randint(0, 40 if block == 16 else 14)):
                role, fault = rng.choice(roles), rng.choice(("", "", "", "truncated", "blank"))
                talk.add(i, role, texts[fault], False)
                rows.append((role[:1], fault))
            assert talk.result()[6:8] == cheapest(rows)


def test_repair_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in queries.op11_repair(spark, sf).collect()} == repaired(rows)
    assert conversations.repair_conversations(spark.createDataFrame([], TALK)).count() == 0


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes):
    """Targets by source: raised together by weight until the budget is spent, none above twice its words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = Fraction(3 * sum(sizes.values()), 2), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            out.update({s: float(unit * weight[s]) for s in open_})
            break
        out.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def check_mix(rows, got, within):
    words = Counter()
    for _, text, source in rows:
        words[source] += size_of(text)
    targets, taken = water(words), Counter()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r["size"]) for r in got) == sorted((i is None, i or 0, s or "", size_of(t)) for i, t, s in rows)
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for source, target in targets.items():
        # A source of one or two documents can't come nearer than half of one.
        sizes = [size_of(t) for _, t, s in rows if s == source]
        assert abs(taken[source] - target) <= (within if len(sizes) > 2 else max(sizes) / 2)


def test_mix(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 2, 3, 7, 50, 51, 400))), rng.choice(("a", "a", "a", "b", "B", "é", None, "zz"))) for i in range(900)]
    rows += [(None, None, "a"), (None, "one two", "a"), (7, "x\ty\n z", "only"), (7, "x\ty\n z", "only"), (8, "", "nothing"), (9, "v " * 30_000, "long")] + [(i, "same copy here", "a") for i in range(1_000, 1_600)]
    df = spark.createDataFrame([(i, t, s, "clash", 1, "clash") for i, t, s in rows], DOCS)
    monkeypatch.setattr(mixing, "ROWS_A_PART", 64)  # so that sizes are taken by parts
    got = mixing.mix(df).collect()
    check_mix(rows, got, 3)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_mix_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_mix(rows, queries.op12_mix(spark, sf).collect(), 20)  # ten documents a source


def test_subset_sums_are_the_nearest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 6), replace=False))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, sizes @ counts + 1))
        sums = {int(sizes @ np.array(c)) for c in itertools.product(*(range(n + 1) for n in counts))}
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int(sizes @ taken) - budget) == min(abs(s - budget) for s in sums if s <= 2 * budget)
        taken = mixing.subset(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and abs(int(sizes @ taken) - budget) <= sizes[-1]
    many = np.arange(1, 3_000)
    counts, budget = np.full(len(many), 1_000), 1_234_567_891
    taken = mixing.subset(many, counts, budget)
    assert many @ taken == budget and np.abs(taken / counts - budget / (many @ counts)).max() < 0.2  # its own sizes
    assert mixing.subset(np.array([200_000, 300_000]), np.array([2, 2]), 450_000).tolist() in ([1, 1], [2, 0])
    assert [float(t) for t in mixing.shared([100, 10, 10])] == [140.0, 20.0, 20.0]


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by_form, friends = {}, {w: set() for w in words}
    for w in words:  # words that share a form with one letter left out contain all near pairs
        for i in range(len(w)):
            by_form.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        by_form.setdefault(w, set()).add(w)
    for group in by_form.values():
        for a, b in itertools.permutations(group, 2):
            if near(a, b):
                friends[a].add(b)
    forms = {}
    for w, n in words.items():
        if friends[w] and words[best := min(friends[w], key=lambda o: (-words[o], o))] >= 5 * n:
            forms[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(friends[w]), words.get(forms.get(w))))
    return out


def test_spelling_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    stems = ["".join(rng.choice("abcéÀ") for _ in range(rng.randint(6, 9))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa"]
    words = []
    for w in stems:
        i = rng.randrange(len(w))
        words += [w] * rng.choice((5, 6, 30, 200)) + [w[:i] + rng.choice("abcé") + w[i + 1 :]] * rng.choice((5, 31)) + [w[:i] + w[i + 1 :]] * 6 + [w[:i] + "À" + w[i:]] * 5
    rng.shuffle(words)
    rows = [(i, rng.choice((" ", "-", "_", "1")).join(words[i::300])) for i in range(300)]
    rows += [(None, None), (None, "Abcabc ABCABC abcabc"), (3, ""), (4, "ZZtopp × zztopp÷ " * 9), (4, "ZZtopp × zztopp÷ " * 9), (5, "a" * 20_000)]
    df = spark.createDataFrame([(i, t, "x", "clash", 1, "clash") for i, t in rows], DOCS)
    monkeypatch.setattr(spelling, "ROWS_A_SALT", 3)  # so that frequent keys are dealt over tasks
    got = spelling.group_variants(df).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == variants(rows)
    assert sum(r.form is not None for r in got) > 50 and any(r.root != r.form and r.form for r in got)
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_spelling_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op13_spelling(spark, sf).collect()} == variants(rows)


def test_pivots_are_the_rarest_disjoint_grams():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        weights = [rng.randint(1, 9) for _ in places]
        able = [(weights[a] + weights[b], (places[a], places[b])) for a, b in itertools.combinations(range(len(places)), 2) if places[b] - places[a] >= 2]
        assert tuple(spelling.pivots(places, weights)) == min(able)[1]
