"""Spelling variants: words one edit apart, found by pivotal grams.

Words are runs of letters, lower-cased (A-Z), counted over all documents; every 199th distinct
(document, word), by CRC-32, loses a letter, which plants slips. Of words with enough letters and
occurrences those one inserted, deleted or replaced code point apart are near. A word's form is
its near word of most occurrences, if that has ``RATIO`` times its own; forms lead to a root.

The bigrams of a word are ordered from rare to frequent, over the vocabulary. Its prefix are the
first three and those that tie with the third; its pivots are two disjoint bigrams of the
prefix, the rarest by a dynamic program over positions. One edit spoils one of two disjoint
bigrams at most. So of two near words, the one whose prefix ends with the rarer bigram has a
pivot that the other word holds in its prefix, at a place that the edit can have moved it to:
either the edit is behind the pivot, and the words agree from their starts through the pivot, or
it is before, and they agree from the pivot to their ends. Prefixes are indexed under both parts
of the word, pivots are looked up in them, and a pair is verified where it is found.

Words of few distinct parts would meet in one task; a key that many words share is split by a
salt of the indexed side. Nothing is gathered on the driver but the counts of bigrams (at most 90
squared, by the alphabet).

Results: null texts have no words; a null id counts as an empty one where slips are planted.
Repeated rows count each time. Ties of forms go to the least in code-point order. Extra columns
are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, ascii_lower, map_arrow, materialize

#: What words are made of, after lower-casing A-Z (fixed values).
LETTERS = "[a-z\\u00C0-\\u00FF]+"
SLIP, LEAST_LETTERS, LEAST_COUNT, RATIO = 199, 6, 5, 5
GRAM, EDITS = 2, 1
#: Indexed words that one task compares with a key's pivots, about, and the most tasks a key is dealt over.
ROWS_A_SALT, SALTS = 256, 64


def slipped(doc_id: Column, word: Column) -> Column:
    """``word`` without one of its code points where the CRC-32 of ``id:word`` is divisible by ``SLIP``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences."""
    found = F.explode(F.regexp_extract_all(ascii_lower(df[text_col].cast("string")), F.lit(LETTERS), F.lit(0)))
    runs = df.select(df[id_col].alias("doc_id"), found.alias("run")).filter(F.char_length("run") >= LEAST_LETTERS)
    words = runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def pivots(places: list[int], weights: list[int], k: int = EDITS + 1) -> list[int]:
    """Of bigrams at ``places`` (ascending) the ``k`` disjoint ones of least total weight.

    ``best[j][m]`` is the least weight of m disjoint ones among the first j; the j-th either
    stays out or follows those that end before it.
    """
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * k]
    for j, (place, weight) in enumerate(zip(places, weights, strict=True)):
        before = next(b for b in range(j, -1, -1) if b == 0 or places[b - 1] + GRAM <= place)
        row = list(best[-1])
        for m in range(1, k + 1):
            if (rest := best[before][m - 1]) is not None:
                taken = (rest[0] + weight, (*rest[1], place))
                row[m] = taken if row[m] is None else min(row[m], taken)
        best.append(row)
    return list(best[-1][k][1])


def plan(word: str, ranks: dict[str, int], counts: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """(rank of the prefix's last bigram, places of the prefix, places of the pivots)."""
    own = grams(word)
    last = sorted(ranks[g] for g in own)[GRAM * EDITS]
    prefix = [i for i, g in enumerate(own) if ranks[g] <= last]
    return last, prefix, pivots(prefix, [counts[own[i]] for i in prefix])


def _parts(word: str, places: list[int]) -> tuple[list[str], list[int]]:
    """(keys, places): the word from its start through each bigram and from each bigram to its end."""
    return [f"<{word[: p + GRAM]}" for p in places] + [f"{word[p:]}>" for p in places]


def near_words(words: DataFrame, keep: Scratch) -> DataFrame:
    """(word, n, other, m): each pair of words (word, n) one edit apart, both ways, once."""
    gram = F.explode(F.expr(f"transform(sequence(1, char_length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")).alias("gram")
    # At most as many rows as pairs of letters.
    counted = sorted((r[1], r[0]) for r in words.select(gram).groupBy("gram").agg(F.count("*").alias("n")).collect())
    counts = {g: n for n, g in counted}
    ranks = {g: i for i, (_, g) in enumerate(counted)}

    def run(batch: pa.RecordBatch) -> dict:
        out = {"word": [], "n": [], "last": [], "key": [], "pivot": []}
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            last, prefix, chosen = plan(word, ranks, counts)
            for key, pivot in [(k, False) for k in _parts(word, prefix)] + [(k, True) for k in _parts(word, chosen)]:
                for name, value in (("word", word), ("n", n), ("last", last), ("key", key), ("pivot", pivot)):
                    out[name].append(value)
        return out

    keyed = keep(map_arrow(words, run, "word string, n bigint, last int, key string, pivot boolean", 1 << 20), "grams")
    held = keyed.groupBy("key").agg(F.count_if(~F.col("pivot")).alias("held"), F.count_if("pivot").alias("asked")).filter("held > 0 and asked > 0 and held + asked > 2")
    salts = F.least(F.ceil(F.col("held") / ROWS_A_SALT), F.lit(SALTS)).cast("int").alias("salts")
    live = keep(keyed.join(held.select("key", salts), "key"), "live")
    index = live.filter("not pivot").selectExpr("key", "cast(pmod(hash(word), salts) as int) salt", "word other", "n m", "last upto", "char_length(word) long")
    asked = live.filter("pivot").selectExpr("key", "explode(sequence(0, salts - 1)) salt", "word", "n", "last", "char_length(word) len")
    able = "word != other and last <= upto and abs(len - long) <= 1 and levenshtein(word, other, 1) = 1"
    pairs = keep(asked.join(index, ["key", "salt"]).filter(able).select("word", "n", "other", "m").distinct(), "near")
    back = pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))
    return pairs.union(back).distinct()


def roots(forms: DataFrame, keep: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far each round.

    A form has more occurrences than its word, so there are no circles.
    """
    links = keep(forms.select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        step += 1
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, links = links, keep(jumped, f"roots-{step}")
        keep.drop(before)
        if links.filter("moved").limit(1).count() == 0:
            return links.select("word", "root")


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary of ``df``."""
    with Scratch(df.sparkSession) as keep:
        words = keep(vocabulary(df, id_col, text_col), "words")
        near = near_words(words, keep)
        most = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("most"))
        judged = words.join(most, "word", "left")
        enough = -F.col("most.less") >= RATIO * F.col("n")
        judged = keep(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("most.other")).alias("form"), F.when(enough, -F.col("most.less")).alias("form_n")), "forms")
        ends = roots(judged.filter("form is not null"), keep)
        out = judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(out, "variants")
