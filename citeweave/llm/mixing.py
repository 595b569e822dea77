"""Mixing sources to target weights by subset sums.

A document's size is the number of its words (runs without white space). Sources, in the order
of their code points with null last, weigh 5, 2, 1 and again; they share a budget of 150 % of
all words by weight. No source may give more than twice its words; what exceeds that is shared
again by weight until nothing does.

A source with budget b and w words takes each document ``b // w`` times, and once more so many
documents of every exact size as bring it nearest to what is left of b. Sizes are counted over
all documents; of the number of each size a proportional share is taken, so the mix has the
source's own sizes, and the remaining budget, small by then, is met by a bounded knapsack: sums
of sizes as bits of one number, counts split into powers of two. Which documents of a size are
taken is decided by a seeded hash of id and text, so reruns agree.

Nothing is gathered but a source's distinct sizes: k of them need k * k / 2 words, so a source
of n words has at most sqrt(2 n). Documents of one size are ranked by parts of the hash, which
are counted first; only the part in which the count is reached is sorted.

Results: null texts have no words; documents without words are returned and take none. A null
source is a source. Rows that are equal in id, text and source are interchangeable. Null ids
are told apart by their texts. Extra columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.llm.common import Scratch, materialize, small

WEIGHTS = (5, 2, 1)
#: The budget as a share of all words, in percent, and how often a document may be taken.
PERCENT, REPEATS = 150, 2
SEED = 20
#: Words that the knapsack may have left to fill at most.
ROOM = 1 << 16
#: Documents of one size and hash part that are ranked together, about.
ROWS_A_PART = 4_096


def shared(sizes: list[int], percent: int = PERCENT, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[Fraction]:
    """Targets of sources by their words, in order: by weight, none above ``repeats`` times its words."""
    targets, open_ = [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = Fraction(percent * sum(sizes), 100)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if unit * weights[i % len(weights)] > repeats * sizes[i]]
        for i in full or open_:
            targets[i] = Fraction(repeats * sizes[i]) if full else unit * weights[i % len(weights)]
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return targets


def subset(sizes: np.ndarray, counts: np.ndarray, budget: int, room: int = ROOM) -> np.ndarray:
    """How many of each size to take, ``counts`` at most, so that their sum is as near to ``budget`` as the knapsack finds.

    ``sizes`` are distinct and positive. What the proportional shares leave is filled by one
    of each size, largest first, until it is within ``room``; the sum of the rest is the nearest that can be made.
    """
    taken = np.zeros(len(sizes), np.int64)
    total = int(sizes @ counts) if len(sizes) else 0
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return counts.copy()
    # Proportional shares by exact integers, where they leave room for the knapsack to choose.
    share = np.array([int(c) * budget // total for c in counts], np.int64)
    taken += np.maximum(share - 1, 0) if len(sizes) > 1 else share
    left = budget - int(sizes @ taken)
    order, moved = np.argsort(-sizes), True
    while left > room and moved:  # one more of each, so no size is favoured by much
        moved = False
        for i in order:
            if left <= room:
                break
            if taken[i] < counts[i] and sizes[i] <= left:
                taken[i] += 1
                left -= int(sizes[i])
                moved = True
    grain = max(1, left // room)  # only where every size left exceeds the room
    return taken + knapsack(np.maximum(sizes // grain, 1), counts - taken, left // grain)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The bounded subset sum nearest to ``budget``, the lower of two as near.

    Bit s of ``reach`` says whether s can be made. Small sizes come last: they close what
    large ones leave. Sums up to the budget and the least size beyond it are kept.
    """
    taken = np.zeros(len(sizes), np.int64)
    able = [i for i in np.argsort(-sizes) if counts[i] > 0 and sizes[i] <= 2 * budget]
    if not able or budget <= 0:
        return taken
    mask = (1 << (2 * budget + 1)) - 1
    reach, steps = 1, []
    for i in able:
        rest, unit = min(int(counts[i]), 2 * budget // int(sizes[i])), 1
        while rest:
            n = min(unit, rest)
            steps.append((i, n, reach))
            reach |= (reach << (n * int(sizes[i]))) & mask
            rest, unit = rest - n, unit * 2
        if reach >> budget & 1:
            break  # met exactly; what is left can't do better
    low = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> budget
    high = budget + (above & -above).bit_length() - 1 if above else None
    at = high if high is not None and high - budget < budget - low else low
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(sizes[i])
    return taken


def _numbered(df: DataFrame, keep: Scratch) -> DataFrame:
    """``df`` (source, ...) with ``number``: the place of a source in the order of code points, null last.

    Sources are sorted over all tasks; places are counted by task.
    """
    ordered = keep(df.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()), "sources")
    tasks = ordered.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("held"), F.min("at").alias("first"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    starts = tasks.select("task", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    placed = ordered.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("task"))
    return placed.select(*df.columns, (F.col("start") + F.col("at") - F.col("first")).alias("number"))


def targets(sizes: DataFrame, percent: int, weights: tuple[int, ...], repeats: int, keep: Scratch) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    A round finds the words a unit of weight gets; sources that are above their bound by it get
    the bound. Sources without words get nothing. Exact: sums are whole numbers, one division at the end.
    """
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % n + 1).cast("int"))
    numbered = keep(_numbered(sizes, keep).withColumn("weight", weight.cast("decimal(38,0)")), "numbered")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = numbered.agg(F.sum(big("source_size"))).first()[0] or 0
    left, heavy = Fraction(percent * int(total), 100), None
    while True:
        # unit = left / heavy; a source is above its bound if unit * weight > repeats * size.
        row = numbered.filter("source_size > 0")
        unit = left / heavy if heavy else None
        if unit is None:
            full = F.lit(False)
        else:
            full = big("weight") * F.lit(unit.numerator).cast("decimal(38,0)") > big("source_size") * F.lit(repeats * unit.denominator).cast("decimal(38,0)")
        got = row.agg(F.sum(F.when(full, big("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        now = int(got[1] or 0)
        if now == heavy or not now:
            break
        heavy, left = now, Fraction(percent * int(total), 100) - repeats * int(got[0] or 0)
    if unit is None:
        target = F.lit(0.0)
    else:
        exact = F.element_at(F.array(*(F.lit(float(unit * w)) for w in weights)), (F.col("number") % n + 1).cast("int"))
        target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(full, (F.col("source_size") * repeats).cast("double")).otherwise(exact)
    return numbered.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame, percent: int = PERCENT, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) for every row of ``df``."""
    text = df[text_col].cast("string")
    docs = df.select(
        df[id_col].alias("doc_id"),
        df[source_col].alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), df[id_col].cast("string"), text).alias("hash"),
    )
    with Scratch(df.sparkSession) as keep:
        docs = keep(docs, "mix-sizes")
        histogram = keep(docs.groupBy("source", "size").agg(F.count("*").alias("held")), "mix-counts")
        aims = keep(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("held")).alias("source_size")), percent, weights, repeats, keep), "mix-targets")

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            """One source's distinct sizes: whole rounds, and how many of each size once more."""
            words, budget = int(frame.source_size.iloc[0]), round(float(frame.target.iloc[0]))
            sized = frame["size"].to_numpy() > 0
            extra, rounds = np.zeros(len(frame), np.int64), budget // words if words else 0
            if words:
                extra[sized] = subset(frame["size"].to_numpy()[sized], frame.held.to_numpy()[sized], budget - rounds * words)
            return frame.assign(rounds=rounds, extra=extra)

        same = F.col("source").eqNullSafe(F.col("s"))
        wanted = histogram.join(small(aims.withColumnRenamed("source", "s")), same).drop("s")
        source = f"source {docs.schema['source'].dataType.simpleString()}"
        chosen = wanted.groupBy("source").applyInPandas(choose, f"{source}, size long, held long, source_size long, target double, rounds long, extra long")
        chosen = keep(chosen.withColumn("parts", F.ceil(F.col("held") / ROWS_A_PART)), "mix-chosen")

        by_size = small(chosen.withColumnRenamed("source", "s").withColumnRenamed("size", "z"))
        part = F.floor(F.shiftrightunsigned("hash", 33) * F.col("parts") / F.lit(1 << 31)).alias("part")
        dealt = keep(docs.join(by_size, same & (F.col("size") == F.col("z"))).select(*docs.columns, "held", "source_size", "target", "rounds", "extra", part), "mix-dealt")
        # Parts before the one that reaches the count are taken whole, those behind it not at all.
        some = dealt.filter("0 < extra and extra < held")
        counts = some.groupBy("source", "size", "part", "extra").agg(F.count("*").alias("inside"))
        before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        places = counts.withColumn("before", F.coalesce(F.sum("inside").over(before), F.lit(0))).select(
            F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "before", "inside"
        )
        here = same & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))
        cut = some.join(places, here)
        edge = F.expr("before < extra and extra < before + inside")
        rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("hash", "doc_id"))
        ranked = cut.filter(edge).withColumn("once", (F.col("before") + rank <= F.col("extra")).cast("long"))
        clear = cut.filter(~edge).withColumn("once", (F.col("before") < F.col("extra")).cast("long"))
        rest = dealt.filter("extra = 0 or extra = held").withColumn("once", (F.col("extra") > 0).cast("long"))
        columns = ("doc_id", "source", "size", "source_size", "target", "rounds", "once")
        out = rest.select(*columns).unionByName(clear.select(*columns)).unionByName(ranked.select(*columns))
        copies = (F.col("rounds") + F.col("once")).alias("copies")
        return materialize(out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies), "mixed")
