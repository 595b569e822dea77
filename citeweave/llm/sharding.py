"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group. A group is placed whole unless it alone outweighs
an eighth of a shard; then it is cut into pieces by a hash of the row. Light groups travel
in hash bundles, heavy ones singly, so that the number of items to place has a bound that
does not depend on the data: ``BUNDLES`` bundles and fewer than ``HEAVY`` single groups
(each outweighs 1/HEAVY of the total) with their pieces. Items go to shards largest
first, each where the dot product of its vector with the residual capacity is highest
among the shards in which it fits in all three dimensions; one that fits nowhere goes where
most is left of what it exceeds least. Then items swap or move between two shards while
that lowers the squared deviations in all three, at last with bytes before all.

Tokens stand for runs of characters other than white space: what a tokeniser would count
costs more than all the rest, and grows with it.

Slots number a shard's rows without gaps: each row has a rank in its (shard, part), the
parts being hash parts of a bounded expected size, and parts start after one another.

Results: null and empty texts weigh ``OVERHEAD`` bytes and form one group (their CRC-32
is 0). Repeated rows and null ids are placed as any row. Extra columns are never read.
An empty table gives an empty result. The law kept is ``bytes``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.llm.common import materialize

SHARDS = 24
OVERHEAD = 8
BUNDLES = 24 * 512
HEAVY = 24 * 512
PIECE_SHARE = 8
#: Expected rows of a hash part of a shard, and the most parts of a shard.
ROWS_A_PART, MOST_PARTS = 2048, 65_536
#: Weights of bytes, tokens and rows in the squared deviations, in turn; bytes are what the law holds.
WEIGHTS = ((1.0, 1.0, 1.0), (10_000.0, 1.0, 1.0))


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``vectors`` has a row (bytes, tokens, rows) an item."""
    capacity = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    items = vectors / capacity
    residual = np.ones((shards, items.shape[1]))
    where = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        room = (residual - items[i]).min(axis=1)
        s = int(np.argmax(np.where(room >= 0, residual @ items[i], -np.inf) if (room >= 0).any() else room))
        where[i] = s
        residual[s] -= items[i]
    for weights in WEIGHTS:
        where = level(items, where, shards, np.array(weights))
    return where


def level(items: np.ndarray, where: np.ndarray, shards: int, weights: np.ndarray, steps: int = 4_000, tried: int = 96) -> np.ndarray:
    """Swap or move items between two shards while that lowers their weighted squared deviations.

    A step takes the shard that deviates most and another, and the best of ``tried`` times
    ``tried`` swaps; it ends when a round over all others brings nothing.
    """
    rng = np.random.default_rng(17)
    load = np.stack([np.bincount(where, items[:, d], shards) for d in range(items.shape[1])], axis=1) - 1
    held = [np.flatnonzero(where == s) for s in range(shards)]
    idle = 0
    for _ in range(steps if shards > 1 else 0):
        cost = (load**2 * weights).sum(axis=1)
        worst = int(np.argmax(cost))
        other = int(rng.integers(shards - 1))
        other += other >= worst
        mine, theirs = (np.append(held[s][rng.permutation(len(held[s]))[:tried]], -1) for s in (worst, other))  # -1: nothing back
        zero = np.zeros((1, items.shape[1]))
        delta = np.vstack([items[mine[:-1]], zero])[:, None] - np.vstack([items[theirs[:-1]], zero])[None]
        gain = cost[worst] + cost[other] - (((load[worst] - delta) ** 2 + (load[other] + delta) ** 2) * weights).sum(axis=2)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] <= 1e-15:
            idle += 1
            if idle > 4 * shards:
                break
            continue
        idle = 0
        load[worst] -= delta[i, j]
        load[other] += delta[i, j]
        for item, source, target in ((mine[i], worst, other), (theirs[j], other, worst)):
            if item >= 0:
                where[item] = target
                held[source] = held[source][held[source] != item]
                held[target] = np.append(held[target], item)
    return where


def shard_documents(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", bundles: int = BUNDLES, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, n_tokens) for every row of ``df``."""
    spark = df.sparkSession
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    base = df.select(
        df[id_col].alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"),
        F.unhex(F.md5(text)).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written, so a row keeps its number: rows without ids and equal texts are told apart by it.
    base = materialize(base, "shard-base").withColumn("spread", F.pmod(F.xxhash64("row"), F.lit(1 << 30)))
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    threshold, piece = max(1, total // heavy), max(1, total // (shards * PIECE_SHARE))
    # Fewer than ``heavy`` groups can exceed the threshold, whatever the data.
    single = base.groupBy("group").agg(F.sum("size").alias("weight")).filter(F.col("weight") > threshold)
    single = spark.createDataFrame(
        [(bytes(g), i, -(-w // piece)) for i, (g, w) in enumerate(sorted((bytes(r[0]), r[1]) for r in single.collect()))], "group binary, number int, pieces bigint"
    )
    item = F.when(F.col("number").isNotNull(), F.concat(F.lit("g"), F.col("number"), F.lit(":"), F.col("spread") % F.col("pieces"))).otherwise(
        F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(bundles)))
    )
    dealt = base.join(F.broadcast(single), "group", "left").withColumn("item", item)
    sums = sorted(tuple(r) for r in dealt.groupBy("item").agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).collect())
    where = place(np.array([r[1:] for r in sums], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(r[0], int(s)) for r, s in zip(sums, where, strict=True)], "item string, shard int")
    parts = min(max(1, -(-rows // (shards * ROWS_A_PART))), MOST_PARTS)
    sharded = dealt.join(F.broadcast(placed), "item").select("doc_id", "size", "text_crc32", "n_tokens", "shard", F.pmod(F.hash("spread"), F.lit(parts)).alias("part"))
    sharded = materialize(sharded, "sharded")
    counts = sharded.groupBy("shard", "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    ranked = sharded.withColumn("rank", rank)
    return ranked.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens"
    )
