"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids plus an end id; only what exceeds a sequence is cut. The
histogram of piece lengths (at most ``SIZE`` numbers, whatever the corpus) goes to the
driver. There the covering program over configurations (multisets of lengths that fit
a sequence) is solved by multiplicative weights: lengths that lag behind their share gain
weight, an unbounded-knapsack dynamic program prices the best configuration for these
weights, and the configuration is raised by a step, until the cover scaled by its least
share is within ``GAP`` of the dual bound. The multiplicities are rounded, what stays over
is solved again until few pieces are left, and best fit over those closes the plan. Where
that needs more sequences than best fit over everything, the configurations with most
pieces are taken back, as few as will do: short pieces are what fills the last rooms. The
plan is a run-length list of (length, rank range) -> (sequence, offset), whose size also
depends on ``SIZE`` only.

Ranks of pieces of one length come from hash parts of a bounded expected size, so a
frequent length is never gathered into one task.

Results: a null or empty text is the end id alone. Repeated rows and null ids are packed
as any row. Extra columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import logging
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeweave.llm.common import map_arrow, materialize, texts
from citeweave.llm.segments import WHITE, segment_lists

SIZE, END = 2048, 0
#: The program is solved to this duality gap, a remainder to twice that; softness of the weights.
GAP, EPSILON = 0.05, 4.0
#: Passes end when so small a share of the pieces, or so few pieces, are left to best fit.
REST_SHARE, LEAST_PIECES = 0.03, 64
#: Expected pieces of a hash part, and the most parts of one length.
ROWS_A_PART, MOST_PARTS = 256, 16_384
#: Bytes of text that are numbered at once: more share more segments.
SLICE = 6 << 20
#: The pattern of byte-level pre-tokenisers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file; distinct segments are encoded once a batch.

    The file's vocabulary, merges and byte alphabet are read from it. A segment of bytes
    that the file would encode in one way is encoded by ``tiktoken`` with the same ranks,
    which is many times faster for short texts; a file that is not byte-level BPE of the
    common pattern is refused. Texts that hold one of the file's added tokens, which are
    matched in the text itself, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        step = model["pre_tokenizer"] or {}
        if model["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or model.get("normalizer"):
            raise ValueError("not a byte-level BPE without prefix space")
        self.path, self.added = path, [t["content"] for t in model["added_tokens"]]
        special = {t["id"] for t in model["added_tokens"] if t["special"]}
        table = {c: b for b, c in byte_alphabet().items()}
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError("merges are not in the order of the vocabulary")
        ranks = {bytes(table[c] for c in token): i for token, i in vocab.items() if i not in special}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each token
        self.widths[list(ranks.values())] = [len(b) for b in ranks]

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        marked = [i for i, text in enumerate(batch) if any(token in text for token in self.added)]
        if not marked:
            return self._encode(batch)
        plain = list(batch)
        for i in marked:
            plain[i] = ""
        out = self._encode(plain)
        for i in marked:
            out[i] = np.array(self.tokenizer.encode(batch[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _encode(self, batch: list[str]) -> list[bytes]:
        offsets, codes, later, own = segment_lists(batch)
        n = len(later)
        line, open_end = (np.asarray(x) for x in (pc.starts_with(later, "\n"), pc.match_substring_regex(later, f"(^|[{WHITE}])$")))
        ids, counts = [], np.zeros(n + len(own), np.int64)
        order = []
        for group, lead in ((~line & ~open_end, " "), (line & ~open_end, "")):
            if group.any():
                some = later.filter(pa.array(group))
                got, held = self._distinct(some, lead)
                ids.append(got)
                order.append(np.flatnonzero(group))
                counts[order[-1]] = held
        odd = np.flatnonzero(open_end)
        rest = [" " + s if s[:1] != "\n" else s for s in later.take(pa.array(odd)).to_pylist()] + own
        single = [self.bpe.encode_ordinary(s) for s in rest]
        order.append(np.concatenate([odd, n + np.arange(len(own))]))
        counts[order[-1]] = [len(x) for x in single]
        ids.append(np.array([i for x in single for i in x], np.int64))
        flat, order = np.concatenate(ids), np.concatenate(order)
        starts = np.zeros(n + len(own), np.int64)
        starts[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
        # The ids of all texts in a row: each code's run of ids copied to its place.
        lens = counts[codes]
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - (ends - lens), lens)
        out = flat[at].astype("<u4")
        bounds = np.concatenate([[0], ends])[offsets]
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _distinct(self, segments: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many segments, encoded as one text, and how many each has: each starts a pre-token."""
        sizes = np.asarray(pc.binary_length(segments)).astype(np.int64) + len(lead)
        joined = lead + pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(segments)]), segments), lead)[0].as_py()
        ids = np.asarray(self.bpe.encode_to_numpy(joined, disallowed_special=())).astype(np.int64)
        held = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(held, prepend=0)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    return out | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): what is packed; the first piece takes the remainder."""
    id_type = df.schema[id_col].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        ids_of = encoder(path).encode(texts(batch))
        out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for key, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
            ids += tail
            n = len(ids) // 4
            start, stop, k = 0, n % size or min(n, size), 0
            while start < n:
                part = ids[4 * start : 4 * stop]
                for name, value in zip(out, (key, k, start, stop - start, zlib.crc32(part), part), strict=True):
                    out[name].append(value)
                start, stop, k = stop, stop + size, k + 1
        return out

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return map_arrow(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), run, schema, SLICE)


def price(weights: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain of each length, best): ``best[c]`` is the greatest weight within ``c`` (unbounded knapsack)."""
    dense = np.full(size + 1, -np.inf)
    dense[lengths] = weights
    best = np.zeros(size + 1)
    for c in range(1, size + 1):
        best[c] = max(best[c - 1], (dense[1 : c + 1] + best[c - 1 :: -1][:c]).max())
    return dense, best


def configuration(first: int, dense: np.ndarray, best: np.ndarray, size: int) -> list[int]:
    """Lengths of a sequence that starts with ``first`` (none if 0) and gains most by present weights and the prices ``best``.

    Where that leaves room, one length grows by it if there is such a length: full sequences waste nothing.
    """
    parts, c = [first] * (first > 0), size - first
    while c:
        gains = dense[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(gains.argmax()) + 1
        if not gains[k - 1] > 0:
            break
        parts.append(k)
        c -= k
    room = size - sum(parts)
    for i in range(len(parts) - 1, -1 if first == 0 else 0, -1) if room else ():
        if dense[parts[i] + room] > -np.inf:
            parts[i] += room
            break
    return parts


class Cover:
    """A growing fractional cover of the counts: how often each configuration is used, and each length's covered share."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int):
        self.lengths, self.counts, self.size = lengths, counts, size
        self.at = np.full(size + 1, -1)
        self.at[lengths] = np.arange(len(lengths))
        self.share, self.used, self.total = np.zeros(len(lengths)), {}, 0.0
        self.lower = float((lengths * counts).sum()) / size

    def weights(self, some=slice(None), base: float = 0.0) -> np.ndarray:
        return self.lengths[some] * np.exp(-(self.share[some] - base) / EPSILON)

    def prices(self) -> tuple[np.ndarray, np.ndarray]:
        """Prices of the present weights; they bound the program from below by duality."""
        weights = self.weights(base=self.share.min())
        dense, best = price(weights, self.lengths, self.size)
        self.lower = max(self.lower, float((weights * self.counts).sum() / best[self.size]))
        return dense, best

    def add(self, parts: list[int], step: float) -> np.ndarray:
        """Raises a configuration until one of its lengths is covered by ``step`` more."""
        inside, times = np.unique(self.at[parts], return_counts=True)
        x = float((self.counts[inside] / times).min()) * step
        self.share[inside] += x * times / self.counts[inside]
        key = tuple(sorted(parts, reverse=True))
        self.used[key] = self.used.get(key, 0.0) + x
        self.total += x
        return inside

    def gap(self) -> float:
        """How far the cover, scaled by its least share, lies above the bound."""
        low = self.share.min()
        return self.total / low / self.lower - 1 if low > 0 else np.inf


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, gap: float = GAP) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """(configurations with fractional multiplicities that cover all counts, duality gap).

    Multiplicative weights, starting at the lengths (the dual prices of a program without
    waste). In each sweep every length that lags gets a configuration of its own. Steps
    shrink once the counts are covered a few times, so shares even out, and start anew at
    twice the cover while that narrows the gap. Should it stall
    above the gap (waste can't be avoided, prices must move), plain rounds follow, in which
    the best configuration alone is raised, at most ``8 * len(lengths) + 1000`` of them.
    """
    cover = Cover(lengths, counts, size)
    step, turn, before = 0.5, 2.0, np.inf
    while cover.gap() > gap:
        if step < 0.01:  # shares are as even as these steps make them: go on at twice the cover, if that helps
            if cover.gap() > 0.97 * before or turn > 200:
                break
            step, turn, before = 0.5, 2 * turn, cover.gap()
        base = cover.share.min()
        late = np.flatnonzero(cover.share < base + step)
        for j, i in enumerate(late[np.argsort(cover.share[late], kind="stable")]):
            if j % 32 == 0:
                base = cover.share.min()
                dense, best = cover.prices()
                goal = base + step if j == 0 else goal
            if cover.share[i] < goal:
                inside = cover.add(configuration(int(lengths[i]), dense, best, size), step)
                dense[lengths[inside]] = cover.weights(inside, base)
        if cover.share.min() >= turn:
            step *= 0.75
    if cover.gap() > gap:
        plain = Cover(lengths, counts, size)
        plain.lower = cover.lower
        for _ in range(8 * len(lengths) + 1000):
            plain.add(configuration(0, *plain.prices(), size), 0.5)
            cover.lower = plain.lower
            if min(plain.gap(), cover.gap()) <= gap:
                break
        cover = min(cover, plain, key=Cover.gap)
    low = cover.share.min()
    return [(parts, x / low) for parts, x in cover.used.items()], cover.gap()


def program(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[np.ndarray, int]], list[tuple[np.ndarray, int]], list[float]]:
    """(sequences of the program's configurations, those of best fit, duality gap of each pass).

    Multiplicities are rounded at random with a fixed seed, full sequences first, and
    never exceed what is left; what stays over is solved again. The whole never has more
    sequences than best fit alone.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    fewest, pieces_ = sum(n for _, n in best_fit(left, size)), sum(left.values())
    out: list[tuple[np.ndarray, int]] = []
    rng, gaps = np.random.default_rng(7), []
    while sum(left.values()) > max(REST_SHARE * pieces_, LEAST_PIECES):
        lengths = np.array(sorted(left))
        solution, gap = solve(lengths, np.array([left[k] for k in lengths]), size, GAP if not gaps else 2 * GAP)
        gaps.append(float(gap))
        before = sum(k * n for k, n in left.items())
        for parts, x in sorted(solution, key=lambda s: (-sum(s[0]), -s[1], s[0])):
            times = min(int(x + rng.random()), *(left[k] // n for k, n in Counter(parts).items()))
            if times:
                out.append((np.array(parts), times))
                for k in parts:
                    left[k] -= times
        left = {k: n for k, n in left.items() if n}
        if sum(k * n for k, n in left.items()) > 0.75 * before:
            break
    if max(gaps, default=0) > 2 * GAP:
        logging.getLogger(__name__).warning("configuration program: duality gap %.4f above %.4f", max(gaps), 2 * GAP)
    out.sort(key=lambda s: (-int(s[0].sum()), len(s[0]), -int(s[0][-1])))
    return *_taken_back(out, left, size, fewest), gaps


def _taken_back(out: list, left: dict[int, int], size: int, fewest: int) -> tuple[list, list]:
    """(the longest beginning of ``out`` found that needs no more than ``fewest`` sequences in all, best fit over the rest)."""

    def after(keep: int) -> list[tuple[np.ndarray, int]]:
        rest = Counter(left)
        for parts, n in out[keep:]:
            for k in parts.tolist():
                rest[k] += n
        return best_fit(rest, size)

    def fits(keep: int) -> bool:
        return sum(n for _, n in out[:keep]) + sum(n for _, n in after(keep)) <= fewest

    low, high, step = len(out), len(out), max(1, len(out) // 64)
    while low and not fits(low):  # at 0 best fit has everything
        low, high, step = max(0, low - step), low, 2 * step
    while high - low > max(1, len(out) // 200):
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return out[:low], after(low)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[np.ndarray, int]]:
    """Whole multiplicities: [(lengths of one sequence, longest first, how many such)]."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    full = [(np.array([size]), left.pop(size))] if left.get(size) else []
    solved, rest, _ = program(left, size)
    return full + solved + rest


def best_fit(left: dict[int, int], size: int) -> list[tuple[np.ndarray, int]]:
    """Best fit over a histogram, longest first: each sequence takes the longest lengths that still fit,
    and a whole run of equal sequences is made at once."""
    left, out = dict(left), []
    while left:
        room, config = size, []
        order = sorted(left, reverse=True)
        held: dict[int, int] = {}
        for k in order:
            n = min(left[k], room // k)
            if n:
                # Leave room that the rest can fill exactly where one length less would not.
                held[k] = n
                config += [k] * n
                room -= n * k
        times = max(1, min(left[k] // n for k, n in held.items()))
        for k, n in held.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((np.array(config), times))
    return out


def intervals(configs: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, sequence of from_rank, offset): rank r of a length goes to sequence + r - from_rank."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for config, times in configs:
        offset = 0
        for k in map(int, config):
            at = next_rank.get(k, 0)
            out.append((k, at, at + times - 1, sequence, offset))
            next_rank[k] = at + times
            offset += k
        sequence += times
    return out


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece."""
    spark = df.sparkSession
    cut = materialize(pieces(df, path, id_col, text_col, size, end, with_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    configs = plan(counts, size)
    slots = sorted(intervals(configs))
    # A table of as many rows as the plan has places; see the bound in the module's text.
    places = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length bigint, low bigint, high bigint, sequence bigint, offset bigint")
    parts = {k: min(-(-n // ROWS_A_PART), MOST_PARTS) for k, n in counts.items()}
    sizes = spark.createDataFrame(sorted(parts.items()) or [(0, 1)], "length bigint, parts bigint")
    dealt = cut.join(F.broadcast(sizes), "length").withColumn("part", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece", "ids_crc32"), F.col("parts")))
    held = dealt.groupBy("length", "part").agg(F.count("*").alias("held"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("within") - 1)
    # Ranges of one length follow one another, so the range of a rank is the last that starts at or before it.
    ranges = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "sequence", "offset"))).alias("ranges"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn("range", _last_at("ranges", "rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("range.sequence") + F.col("rank") - F.col("range.low")).alias("sequence_id"), F.col("range.offset").alias("offset")]
    return found.select(*columns, *(["ids"] * with_ids))


def _last_at(ranges: str, rank: str) -> F.Column:
    """The last struct whose ``low`` does not exceed the rank."""
    return F.expr(f"element_at(filter({ranges}, r -> r.low <= {rank}), -1)")
