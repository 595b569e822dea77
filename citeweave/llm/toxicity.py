"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and their beginnings, hashed to ``BUCKETS`` indices. The score
is the logistic of bias + linear weights + pairwise interactions <v_i, v_j>, so that two
terms which matter only together (an insult and a mention of a group) are learnt. Linear
weights are fitted by proximal steps with an L1 penalty: terms without evidence get zero exactly,
so long texts do not gather noise.

Terms get a vector by evidence of their own, or by joint evidence: over the residuals of
the additive weights, pairs of terms are tested, so words that say nothing alone and much
together (a xor b) are learnt too. No term is left out of that but those that can't pass: the
statistic of a pair is at most the root of the number of texts that hold both, so a term of
fewer texts than the limit squared has no pair that reaches it. Blocks of pairs are tested in
Spark tasks, over a broadcast of the sample's terms.

The fit takes a bounded sample of labelled rows (``SAMPLE`` rows with the least hash, of which
those whose terms fit in ``SAMPLE_BYTES``, one after another; a text that alone is larger is
passed over); scoring reads every row and whole text.

Results: null and empty texts get the score of no terms. Null labels and null ids are not
learnt from. Repeated rows are scored alike. Extra columns are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, TASK_CACHES, map_arrow, texts

BUCKETS = 1 << 20
FACTORS = 4
#: Labelled rows that a fit takes at most.
SAMPLE = 12_000
#: Bytes of hashed terms that a fit takes at most.
SAMPLE_BYTES = 24 << 20
#: Pairs of terms that chance may pass in all; terms a side of the blocks that a task tests.
CHANCE, BLOCK = 0.01, 1_500
THRESHOLD = 0.7
_TERM = re.compile(r"\w+")
#: Lengths of the word beginnings that are terms beside the word itself.
BEGINNINGS = (5, 6, 7)
_INDEX: dict[str, tuple[int, ...]] = {}
TASK_CACHES.append(_INDEX)


def _indices(word: str) -> tuple[int, ...]:
    names = [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) > k)]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names)


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text: words, beginnings of words, and those that
    two, three or more distinct words share, each as a term of its own."""
    if len(_INDEX) > 200_000:
        _INDEX.clear()
    flat: list[int] = []
    for word in set(_TERM.findall(text.lower())):
        known = _INDEX.get(word)
        if known is None:
            known = _INDEX[word] = _indices(word)
        flat += known
    once, times = np.unique(np.array(flat, np.int64), return_counts=True)
    return np.concatenate([once, *((once[times >= k] * 2_654_435_761 + k * 40_503) % BUCKETS for k in (2, 3))])


@dataclass
class Machine:
    """A fitted machine: its sorted term indices, their weights and vectors, the bias."""

    index: np.ndarray
    weight: np.ndarray
    vector: np.ndarray
    bias: float

    def scores(self, batch: list[np.ndarray]) -> np.ndarray:
        if not batch:
            return np.empty(0)
        out = np.full(len(batch), self.bias)
        if len(self.index):
            lens = np.array([len(b) for b in batch])
            flat, row = np.concatenate(batch), np.repeat(np.arange(len(batch)), lens)
            at = np.minimum(np.searchsorted(self.index, flat), len(self.index) - 1)
            known = self.index[at] == flat
            at, row = at[known], row[known]
            out += np.bincount(row, self.weight[at], len(batch))
            for k in range(self.vector.shape[1]):
                v = self.vector[at, k]
                out += 0.5 * (np.bincount(row, v, len(batch)) ** 2 - np.bincount(row, v * v, len(batch)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def evidence(count: np.ndarray, bad: np.ndarray, n: int, positives: float) -> np.ndarray:
    """|z| of each term's log odds ratio between the classes, smoothed by half a text."""
    inside, outside = bad + 0.5, count - bad + 0.5
    rest_in, rest_out = positives - bad + 0.5, n - positives - (count - bad) + 0.5
    return np.abs(np.log(inside * rest_out / (outside * rest_in))) / np.sqrt(1 / inside + 1 / outside + 1 / rest_in + 1 / rest_out)


@dataclass
class Pairs:
    """What the test of pairs reads: by text the places of its eligible terms, and its residual."""

    starts: np.ndarray
    places: np.ndarray
    residual: np.ndarray
    eligible: int
    limit: float
    alone: np.ndarray

    @classmethod
    def of(cls, inverse: np.ndarray, row: np.ndarray, count: np.ndarray, residual: np.ndarray) -> tuple[Pairs, np.ndarray]:
        """The pairs of terms given by text, and the terms that are eligible."""
        seen = int((count >= 8).sum())
        limit = float(np.sqrt(2 * np.log(max(2.0, seen * (seen - 1) / 2) / CHANCE)))
        some = np.flatnonzero((count >= limit**2) & (count <= 0.9 * len(residual)))
        place = np.full(len(count), -1, np.int32)
        place[some] = np.arange(len(some), dtype=np.int32)
        at = place[inverse]
        keep = at >= 0
        at, e = at[keep], residual.astype(np.float32)
        starts = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(residual)))])
        own = e[row[keep]]
        alone = np.abs(np.bincount(at, own, len(some))) / np.sqrt(np.bincount(at, own * own, len(some)) + 1e-3)
        return cls(starts, at, e, len(some), limit, alone), some

    def blocks(self) -> list[tuple[int, int]]:
        starts = range(0, self.eligible, BLOCK)
        return [(i, j) for i in starts for j in starts if i <= j]

    def _dense(self, first: int, texts: slice) -> np.ndarray:
        """Which of the terms from ``first`` on the texts hold."""
        lo, hi = self.starts[texts.start], self.starts[texts.stop]
        row = np.repeat(np.arange(texts.stop - texts.start), np.diff(self.starts[texts.start : texts.stop + 1]))
        at = self.places[lo:hi] - first
        inside = (at >= 0) & (at < BLOCK)
        out = np.zeros((texts.stop - texts.start, min(BLOCK, self.eligible - first)), np.float32)
        out[row[inside], at[inside]] = 1
        return out

    def strong(self, i: int, j: int) -> np.ndarray:
        """Places of the terms of two blocks that have a pair across them whose joint residual is evidence.

        z of a pair is the sum of the residuals of the texts that hold both over its standard
        deviation; the limit is what few chance values of so many would reach. What a term's own
        residual explains is no interaction: a pair must stand out against that of its lesser term.
        """
        wide = (min(BLOCK, self.eligible - i), min(BLOCK, self.eligible - j))
        total, both = np.zeros(wide, np.float32), np.zeros(wide, np.float32)
        for start in range(0, len(self.residual), 1_024):
            texts = slice(start, min(start + 1_024, len(self.residual)))
            x, e = self._dense(i, texts), self.residual[texts, None]
            y = x if i == j else self._dense(j, texts)
            total += x.T @ (y * e)
            both += x.T @ (y * (e * e))
        z = np.abs(total) / np.sqrt(both + 1e-3)
        z[both < 8 * np.mean(self.residual**2)] = 0
        if i == j:
            np.fill_diagonal(z, 0)
        lesser = np.minimum(self.alone[i : i + wide[0], None], self.alone[None, j : j + wide[1]])
        passed = z > np.maximum(self.limit, 1.5 * lesser)
        return np.unique(np.concatenate([i + np.flatnonzero(passed.any(axis=1)), j + np.flatnonzero(passed.any(axis=0))]))


def joint_terms(inverse: np.ndarray, row: np.ndarray, count: np.ndarray, residual: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """Terms of pairs whose joint residual is evidence; blocks of pairs are tested by tasks of ``spark``, if given."""
    pairs, some = Pairs.of(inverse, row, count, residual)
    blocks = pairs.blocks()
    if spark is None or len(blocks) < 2:
        found = [pairs.strong(i, j) for i, j in blocks]
        return some[np.unique(np.concatenate(found)).astype(np.int64)] if found else some[:0]
    shared = spark.sparkContext.broadcast(pairs)  # SAMPLE_BYTES of terms at most

    def run(batch: pa.RecordBatch) -> dict:
        found = [shared.value.strong(i, j) for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)]
        return {"place": np.unique(np.concatenate(found)) if found else []}

    dealt = spark.createDataFrame(blocks, "i int, j int").repartition(len(blocks), "i", "j")
    strong = np.array(sorted(r[0] for r in map_arrow(dealt, run, "place int").distinct().collect()), np.int64)
    shared.destroy()
    return some[strong]


def fit(samples: list[np.ndarray], labels: np.ndarray, epochs: int = 200, l1: float = 3e-4, decay: float = 1e-3, seed: int = 11, joint: bool = True, spark: SparkSession | None = None) -> Machine:
    """Full-batch proximal Adagrad steps on the logistic loss.

    The L1 penalty of a term falls with the evidence for it, so that plain terms vanish
    and telling ones are hardly shrunk; terms with some evidence, alone or jointly, may
    interact. Without ``joint`` joint evidence is left out.
    """
    if not len(labels) or labels.min() == labels.max():
        base = float(labels.mean()) if len(labels) else 0.0
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)), float(np.log((base + 1e-3) / (1 - base + 1e-3))))
    n = len(labels)
    flat, row = np.concatenate(samples), np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in samples])
    index, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    inverse = inverse.astype(np.int32)
    z = evidence(count, np.bincount(inverse, labels[row], len(index)), n, labels.sum())
    told = (count >= 3) & (z >= 1)  # a term of one or two texts is no evidence
    paired = told & (z >= 2.5)  # terms that may interact
    keep = told[inverse]
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    _, w, v, b = _descend(row[keep], inverse[keep], labels, told, paired & False, z, bias, epochs // 3 if joint else 0, l1, decay, seed)
    if joint:
        margin = b + np.bincount(row, w[inverse], n)
        together = joint_terms(inverse, row, count, labels - 1 / (1 + np.exp(-np.clip(margin, -30, 30))), spark)
        told[together] = paired[together] = True
        z[together] = np.maximum(z[together], 4)
    keep = told[inverse]
    used, w, v, bias = _descend(row[keep], inverse[keep], labels, told, paired, z, bias, epochs, l1, decay, seed)
    return Machine(index[used], w[used], v[used], bias)


def _descend(row, inverse, labels, told, paired, z, bias, epochs, l1, decay, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(used, weights, vectors, bias) over all terms after ``epochs`` steps on those ``told``."""
    place = np.cumsum(told) - 1
    inverse, some, paired, n = place[inverse], np.flatnonzero(told), paired[told], len(labels)
    m = len(some)
    penalty = l1 * np.minimum(16, (4 / z[told]) ** 4)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS)) * paired[:, None]
    gw, gv, gb = np.full(m, 1e-8), np.full((m, FACTORS), 1e-8), 1e-8
    on = paired[inverse]
    r, i = row[on], inverse[on]
    for epoch in range(epochs):
        margin = bias + np.bincount(row, w[inverse], n)
        sums = []
        if pairs := epoch >= epochs // 3 and len(i) > 0:  # interactions join once linear weights stand
            for k in range(FACTORS):
                vi = v[i, k]
                sums.append(np.bincount(r, vi, n))
                margin += 0.5 * (sums[k] ** 2 - np.bincount(r, vi * vi, n))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        grad = np.bincount(inverse, error[row], m) / n
        gw += grad * grad
        rate = 0.5 / np.sqrt(gw)
        w = w - rate * grad
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        gb += error.mean() ** 2
        bias -= 0.3 * error.mean() / np.sqrt(gb)
        if pairs:
            for k in range(FACTORS):
                g = np.bincount(i, error[r] * (sums[k][r] - v[i, k]), m) / n + decay * v[:, k]
                gv[:, k] += g * g
                v[:, k] -= 0.05 * g / np.sqrt(gv[:, k]) * paired
    weights, vectors = np.zeros(len(told)), np.zeros((len(told), FACTORS))
    weights[some], vectors[some] = w, v
    return (weights != 0) | vectors.any(axis=1), weights, vectors, bias


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows for which ``allowed`` (of the labels' id) holds, and ``SAMPLE_BYTES`` of their terms."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).filter("doc_id is not null and label is not null").filter(allowed)
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(sample)
    # At most ``sample`` ids: a broadcast of a proven size.
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = text.select(F.xxhash64(F.col("doc_id").cast("string"), "text", "label").alias("order"), "label", "text")

    def run(batch: pa.RecordBatch) -> dict:
        made = [np.sort(terms(t)).astype("<i4").tobytes() for t in texts(batch)]
        return {"order": batch.column("order"), "label": batch.column("label"), "terms": made, "size": [len(m) for m in made]}

    with Scratch(docs.sparkSession) as keep:
        made = keep(map_arrow(rows, run, "order bigint, label int, terms binary, size bigint"), "toxic-train")
        # Rows with the least hash, as many as the bounds allow: an id that many rows have is sampled as any.
        fits, total = [], 0
        for order, size in made.orderBy("order").select("order", "size").limit(sample).collect():
            if total + size <= SAMPLE_BYTES:
                fits, total = [*fits, (order,)] if not fits or fits[-1][0] != order else fits, total + size
        taken = docs.sparkSession.createDataFrame(fits, "order bigint")
        got = made.join(F.broadcast(taken), "order").orderBy("order").limit(sample).select("label", "terms").collect()
    return fit([np.frombuffer(r[1], "<i4") for r in got], np.array([float(r[0]) for r in got]), spark=docs.sparkSession)


def score_documents(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``df``."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # at most one entry a bucket with a weight
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        scores = shared.value.scores([terms(t) for t in texts(batch)])
        return {"doc_id": batch.column("doc_id"), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    return map_arrow(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), run, f"doc_id {id_type}, score double, predicted int")
