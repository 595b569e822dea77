"""Near-duplicate detection: one-permutation MinHash, banded buckets, star edges.

A text is lower-cased (A-Z), split at white space, and stands for the set of its
distinct five-word shingles. Equal word sequences are one node. A signature takes
one hash a shingle: its high bits choose a bin, the least value of a bin counts, and
an empty bin borrows from a bin that a fixed random walk of its own reaches first
(optimal densification). Bands of bins give buckets. A bucket proposes edges from one
centre to its members only, so a bucket of n members gives n - 1 pairs; edges count
only when the full sets confirm them.

The centre is the member that meets most others over all its buckets, which finds the
text that the others copy. A star can still hide a link between two members that both
miss the centre. So after the stars are joined into components, members of buckets that
hold several components are compared across them, unless it is certain that they can't
link: a member's shingles that occur nowhere else bound the size of any partner, and the
parity marks of two sets bound how much they differ. Groups of near copies are one
component by then, and texts that merely share a passage have too much of their own, so
few pairs are left and no link is lost. Marks are compared within the join; in a family
of texts that all just miss the similarity that is still a comparison for each pair of a
bucket, of some words of bits, but only pairs that the marks leave open are emitted.

Results: a null or empty text (or one without words) has an empty set and links with
nothing. Repeated rows fall on one node. Extra columns are never read. An empty
table gives an empty result. Rows without an id take part; the smallest known id of a
component names it, and a component without any id is named null.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, TASK_CACHES, map_arrow, materialize, row_key, small, texts

WORDS = 5
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: A bucket of so many members is compared in one task, a larger one in more, up to SALTS.
ROWS_A_SALT, SALTS = 512, 256
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_HASHES: dict[bytes, int] = {}
TASK_CACHES.append(_HASHES)


def words_of(text: str) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes know only ASCII there."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_MIX[3])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_MIX[4])
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > 300_000:
        _HASHES.clear()
    get = _HASHES.get
    hashed = [get(w) for w in words]
    if None in hashed:
        for i, h in enumerate(hashed):
            if h is None:
                h = xxhash.xxh3_64_intdigest(words[i])
                if len(words[i]) < 40:
                    _HASHES[words[i]] = h
                hashed[i] = h
    h = np.array(hashed, np.uint64)
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        n = len(h) - width + 1
        total = np.full(n, len(words) if len(words) < WORDS else 0, np.uint64)
        for k in range(width):
            total = (total ^ (h[k : k + n] * np.uint64(_MIX[k % 7] + 2 * k))) * np.uint64(_MIX[(k + 3) % 7])
            total ^= total >> np.uint64(31)
        return np.unique(_avalanche(total))


@lru_cache(maxsize=2_000)
def _walk(step: int, bins: int) -> np.ndarray:
    """For each bin, the bin that its fixed random walk visits at a step."""
    return np.random.default_rng(7_000 + step).integers(0, bins, bins)


def signature(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each bin; empty bins filled by optimal densification."""
    where = (shingles >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.searchsorted(where, np.arange(bins))  # sorted hashes: the first of a bin is its least
    full = first < len(where)
    full[full] = where[first[full]] == np.arange(bins)[full]
    out = np.zeros(bins, np.uint64)
    out[full] = shingles[first[full]]
    empty, step, filled = np.flatnonzero(~full), 0, full.copy()
    while len(empty):
        donor = _walk(step, bins)[empty] if step < 2_000 else np.full(len(empty), np.flatnonzero(full)[0])
        lucky = full[donor]
        out[empty[lucky]] = out[donor[lucky]]
        filled[empty[lucky]] = True
        empty, step = empty[~lucky], step + 1
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket name a band."""
    rows = sig.reshape(bands, -1)
    with np.errstate(over="ignore"):
        total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_MIX[5])
        for k in range(rows.shape[1]):
            total = _avalanche(total ^ (rows[:, k] * np.uint64(_MIX[k % 7])))
    return total.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False)))


def _read(text: str) -> tuple[int, int, np.ndarray]:
    """128-bit name of the word sequence and the shingle set; the words themselves are let go."""
    words = words_of(text)
    digest = hashlib.sha256(b" ".join(words)).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True), shingle_set(words)


def sign(df: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, row_key, k1, k2, n, bands): 128-bit name of the word sequence, set size, bucket names."""

    def run(batch: pa.RecordBatch) -> dict:
        k1, k2, n, bands = [], [], [], []
        for text in texts(batch):
            one, two, items = _read(text)
            k1.append(one)
            k2.append(two)
            n.append(len(items))
            bands.append(band_keys(signature(items)) if len(items) else np.empty(0, np.int64))
        return {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "k1": k1, "k2": k2, "n": n, "bands": _lists(bands)}

    return map_arrow(df, run, f"doc_id {id_type}, row_key binary, k1 bigint, k2 bigint, n bigint, bands array<bigint>")


def parity_marks(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each of 2 to 4 cells a shingle: whether the cell holds an odd number of them.

    Cells that differ between two sets each hold a shingle of one set alone, so their number
    never exceeds the symmetric difference. The second marks are for half as many cells.
    """
    cells = max(64, 1 << max(2 * len(shingles) - 1, 0).bit_length())
    odd = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    full = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return full, full[: len(full) // 2] ^ full[len(full) // 2 :] if len(full) > 1 else full


def shingles(df: DataFrame) -> DataFrame:
    """(k1, k2, items, marks, half): the full sets and their parity marks."""

    def run(batch: pa.RecordBatch) -> dict:
        read = [_read(t) for t in texts(batch)]
        marks = [parity_marks(items) for _, _, items in read]
        return {
            "k1": [one for one, _, _ in read], "k2": [two for _, two, _ in read], "items": _lists([items.view(np.int64) for _, _, items in read]),
            "marks": _lists([m for m, _ in marks]), "half": _lists([h for _, h in marks]),
        }

    return map_arrow(df, run, "k1 bigint, k2 bigint, items array<bigint>, marks array<bigint>, half array<bigint>", 2 << 20)


def components(edges: DataFrame, keep: Scratch, tag: str = "cc") -> DataFrame:
    """(nid, comp) for every node of ``edges`` (u, v): comp is the least node reachable.

    Labels spread by minimum over neighbours, then jump to their label's label; a
    round is one join and one pre-aggregated minimum, and its result is written.
    """
    both = keep(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{tag}-edges")
    labels = keep(both.groupBy(F.col("u").alias("nid")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("nid").alias("v"), "comp"), "v").groupBy(F.col("u").alias("nid")).agg(F.min("comp").alias("near"))
        spread = keep(labels.join(near, "nid").select("nid", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")), f"{tag}-{step}a")
        keep.drop(labels)
        jump = spread.select(F.col("nid").alias("comp"), F.col("comp").alias("further"))
        labels = keep(spread.join(jump, "comp").select("nid", F.col("further").alias("comp"), "old"), f"{tag}-{step}b")
        keep.drop(spread)
        if labels.filter("comp != old").limit(1).count() == 0:
            keep.drop(both)
            return labels.select("nid", "comp")


def _in_size(a: str, b: str, percent: int) -> F.Column:
    """Sets whose sizes differ too much cannot link."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _may_link(percent: int) -> F.Column:
    """Whether the parity marks of u and v allow the similarity.

    Sets of n and m reach it only if they differ in (100 - percent) / (100 + percent) * (n + m)
    shingles at most. Marks of unlike length are compared at the shorter one's; if that is
    shorter than half the longer one's, the pair stays open.
    """
    u = F.expr("if(size(um) <= size(vm), um, uh)")
    v = F.expr("if(size(vm) <= size(um), vm, vh)")
    unlike = F.aggregate(F.zip_with(u, v, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    return F.coalesce(unlike, F.lit(0)) * (100 + percent) <= (F.col("un") + F.col("vn")) * (100 - percent)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (u, v) whose full sets reach the similarity."""
    with_u = pairs.join(sets.select(F.col("nid").alias("u"), F.col("items").alias("iu")), "u")
    both = with_u.join(sets.select(F.col("nid").alias("v"), F.col("items").alias("iv")), "v")
    shared = F.size(F.array_intersect("iu", "iv"))
    counted = both.select("u", "v", shared.alias("both"), (F.size("iu") + F.size("iv")).alias("sum"))
    return counted.filter(F.expr(f"100L * both >= {percent}L * (sum - both)")).select("u", "v")


def _mixed(seen: DataFrame) -> DataFrame:
    """(bucket, main): buckets of several components, and the largest there."""
    by_comp = seen.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    return by_comp.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("bucket", "main")


def _possible(rest: DataFrame, sets: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """Those members of buckets of several components that may have a partner in another one.

    Shingles that no other text there has can't be shared. With s of n shared at most, sets
    of n and m reach the similarity only if s >= percent / (100 + percent) * (n + m), which
    bounds m; a member whose bound lies below every size in its bucket has no partner there.
    What is dropped leaves more shingles unshared, so this may be repeated.
    """
    items = sets.join(rest.select("nid").distinct(), "nid").select("nid", F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count("*").alias("c"), F.min("nid").alias("nid")).filter("c = 1").groupBy("nid").agg(F.count("*").alias("alone"))
    alone = keep(alone, "alone")
    bound = F.floor(F.expr(f"(n - coalesce(alone, 0)) * {100 + percent} / {percent}") - F.col("n") + F.lit(1e-6))
    bounded = keep(rest.drop("bound").join(alone, "nid", "left").select("bucket", "nid", "n", "comp", bound.alias("bound")), "bounded")
    least = bounded.groupBy("bucket").agg(F.min("n").alias("least"))
    kept = keep(bounded.join(least, "bucket").filter("bound >= least").drop("least"), "kept")
    alive = keep(kept.join(_mixed(kept).select("bucket"), "bucket"), "alive")
    keep.drop(alone, bounded, kept, rest)
    return alive


def _across(alive: DataFrame, sets: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    """Pairs (u, v) of different components in a bucket that their sizes and marks leave open.

    A bucket of many members is dealt over ``SALTS`` tasks at most: one side by its node,
    the other copied to each.
    """
    main = keep(_mixed(alive).join(alive.groupBy("bucket").agg(F.count("*").alias("held")), "bucket"), "mixed")
    salts = F.least(F.ceil(F.col("held") / ROWS_A_SALT), F.lit(SALTS)).cast("int").alias("salts")
    marked = keep(alive.join(sets.select("nid", "marks", "half"), "nid").join(main.select("bucket", "main", salts), "bucket"), "marked")
    left = marked.filter("comp != main").selectExpr("bucket", "cast(pmod(hash(nid), salts) as int) salt", "nid u", "n un", "comp uc", "bound ub", "marks um", "half uh")
    right = marked.selectExpr("bucket", "explode(sequence(0, salts - 1)) salt", "nid v", "n vn", "comp vc", "bound vb", "marks vm", "half vh", "main")
    open_ = left.join(right, ["bucket", "salt"]).filter("uc != vc and (vc = main or u < v) and vn <= ub and un <= vb").filter(_in_size("un", "vn", percent)).filter(_may_link(percent))
    return open_.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, with_rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``.

    ``with_rows`` adds ``row_key`` (128 bits of the text as it stands) and ``grouped`` (the
    component by number; null for a row without words), by which a row without an own id is known.
    """
    with Scratch(df.sparkSession) as keep:
        out = _linked(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), percent, keep)
        return materialize(out if with_rows else out.drop("row_key", "grouped"), "near")


def _linked(docs: DataFrame, percent: int, keep: Scratch) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = keep(sign(docs.withColumn("row_key", row_key(F.col("text"))), id_type), "signed")
    groups = signed.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    groups = keep(groups.withColumn("nid", F.monotonically_increasing_id()), "groups")
    # Buckets of the distinct texts; the rows of other copies stay behind.
    named = groups.select("k1", "k2", "first_id", "nid")
    firsts = signed.filter("n > 0").join(named, ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    buckets = keep(firsts.select("nid", "n", F.explode("bands").alias("bucket")), "buckets")
    active = buckets.groupBy("bucket").agg(F.min("nid").alias("near"), F.max("nid").alias("far"), F.count("*").alias("held")).filter("near < far").select("bucket", "held")
    met = keep(buckets.join(active, "bucket"), "met")
    keep.drop(buckets)
    # The text of which many are copies meets them in more buckets than they meet each other:
    # the member that meets most is the centre.
    weight = met.groupBy("nid").agg(F.sum("held").alias("meets"))
    members = keep(met.join(weight, "nid").select("bucket", "nid", "n", "meets"), "members")
    keep.drop(met)
    centres = keep(members.groupBy("bucket").agg(F.max(F.struct("meets", "nid", "n")).alias("c")).select("bucket", F.col("c.nid").alias("centre"), F.col("c.n").alias("cn")), "centres")
    stars = members.join(centres, "bucket").filter(F.col("nid") != F.col("centre")).filter(_in_size("n", "cn", percent))
    stars = keep(stars.select(F.least("centre", "nid").alias("u"), F.greatest("centre", "nid").alias("v")).distinct(), "stars")
    # Full sets of the texts in any active bucket, once each.
    wanted = keep(members.select("nid").distinct().join(groups, "nid").select("nid", "k1", "k2", "first_id"), "wanted")
    ids = wanted.select(F.col("first_id").alias("doc_id")).filter("doc_id is not null").distinct()
    chosen = docs.join(small(ids), "doc_id", "left_semi").select("text").unionByName(docs.filter("doc_id is null").select("text"))
    sets = keep(shingles(chosen).join(small(wanted.drop("first_id")), ["k1", "k2"]).select("nid", "items", "marks", "half").dropDuplicates(["nid"]), "sets")

    links = keep(_confirm(stars, sets, percent), "links")
    comps = components(links, keep, "cc1")
    # Members of buckets in which several components are left.
    seen = keep(members.join(comps, "nid", "left").select("bucket", "nid", "n", F.coalesce("comp", "nid").alias("comp")), "seen")
    alive, size = keep(seen.join(_mixed(seen).select("bucket"), "bucket"), "rest"), None
    keep.drop(members, centres, seen, wanted)
    while size is None or alive_rows < 0.8 * size:
        size = alive.count()
        alive = _possible(alive, sets, percent, keep)
        alive_rows = alive.count()
    across = keep(_across(alive, sets, percent, keep), "across")
    more = keep(_confirm(across.join(stars, ["u", "v"], "left_anti"), sets, percent), "more")
    if more.limit(1).count():
        comps = components(links.unionByName(more), keep, "cc2")

    grouped = keep(groups.join(comps, "nid", "left").select("k1", "k2", "first_id", F.coalesce("comp", "nid").alias("comp")), "grouped")
    names = grouped.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(names, "comp").select("k1", "k2", "component_id", F.col("comp").alias("grouped"))
    out = signed.select("doc_id", "row_key", "k1", "k2", "n").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("grouped").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id").eqNullSafe(component), F.lit(False))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "row_key", "grouped")
