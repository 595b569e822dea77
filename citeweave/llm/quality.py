"""Quality by random Fourier features, ridge normal equations and isotonic calibration.

A text gives ``len(STATISTICS)`` statistics of its characters, words and lines. They are
standardised by the labelled rows and mapped to ``FEATURES`` cosines of random
projections, whose inner products approximate a Gaussian kernel. Each partition sums its
own share of the normal equations; the shares are added by position (a table of a size
fixed by ``FEATURES``) and the ridge system is solved on the driver. Raw scores of all
labelled rows are counted in ``BINS`` bins and made monotone by pool-adjacent-violators.

Results: null and empty texts have zero statistics and get a score like any. Null labels
and null ids are not learnt from; without any label of both classes all scores are the
labels' mean (1 if there are none). Repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, map_arrow, release, texts

STATISTICS = (
    "log_chars", "log_words", "log_lines", "mean_word", "long_words", "distinct_words", "top_word", "top_pair",
    "letters", "capitals", "digits", "blanks", "marks", "rare_marks", "pipes", "marked_words", "repeated_marks",
    "distinct_lines", "mean_line", "distinct_chars", "sentence_ends", "adjacent_repeats",
)
FEATURES = 128
RIDGE = 1e-3
BINS = 512
THRESHOLD = 0.3
_KIND = bytes(0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\r\x0b\x0c" else 4 if b in b".,;:!?'\"()-" else 5 for b in range(256))


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in order of ``STATISTICS``."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    words, lines = data.split(), data.split(b"\n")
    m = max(len(words), 1)
    kinds = data.translate(_KIND)
    share = [kinds.count(k) / n for k in range(6)]
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter()
    marked = sum(c for w, c in counts.items() if w[-1:] in b"#$%&*@^~|" or w == b"|")
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), min(n / m, 50) / 10, sum(c for w, c in counts.items() if len(w) > 12) / m,
        len(counts) / m, max(counts.values(), default=0) / m, max(pairs.values(), default=0) / m,
        share[0], share[1], share[2], share[3], share[4], share[5], data.count(b"|") / n * 10, marked / m, sum(data.count(x) for x in (b"##", b"$$", b"%%", b"**", b"&&", b"!!", b"??")) / m,
        len(set(lines)) / len(lines), math.log1p(n / len(lines)), min(len(set(data)), 120) / 120, (data.count(b".") + data.count(b"!") + data.count(b"?")) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
    ]


@dataclass
class Classifier:
    """Standardisation, projection, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]
    seed: int

    def raw(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(stats))
        return features(stats, self.mean, self.scale, self.seed) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # A trace of the raw score keeps an order where the calibrated curve is flat.
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, seed: int, count: int = FEATURES) -> np.ndarray:
    """Random Fourier features and a constant."""
    rng = np.random.default_rng(seed)
    d = len(mean)
    projection, phase = rng.normal(0, 1 / math.sqrt(2 * d), (d, count)), rng.uniform(0, 2 * math.pi, count)
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([math.sqrt(2 / count) * np.cos(z @ projection + phase), np.ones((len(z), 1))])


def monotone(score: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins: (score, calibrated value) knots."""
    blocks: list[list[float]] = []  # weight, good, sum of score * weight
    for s, t, g in zip(score, total, good, strict=True):
        blocks.append([t, g, s * t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, len(STATISTICS))


def document_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) for every row, whole texts."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "stats": [statistics(t) for t in texts(batch)]}

    return map_arrow(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), run, f"doc_id {id_type}, stats array<double>")


def learn(stats: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", label_col: str = "quality", seed: int = 5) -> Classifier:
    """Fit on all labelled rows for which ``allowed`` (of the labels' id) holds."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")).filter("doc_id is not null and label is not null").filter(allowed)
    with Scratch(stats.sparkSession) as keep:
        return _fit(keep(known.join(stats, "doc_id").select("label", "stats"), "quality-train"), seed)


def _fit(rows: DataFrame, seed: int) -> Classifier:
    d = len(STATISTICS)
    moments = [f(F.get("stats", F.lit(k))) for k in range(d) for f in (F.avg, F.stddev_pop)]
    got = rows.agg(F.count("*"), F.avg("label"), *moments).first()
    if not got[0] or got[1] in (0, 1):
        base = float(got[1]) if got[0] else 1.0
        return Classifier(np.zeros(d), np.ones(d), None, (np.array([0.0]), np.array([base])), seed)
    mean, scale = np.array(got[2::2], float), np.maximum(np.array(got[3::2], float), 1e-3)

    def partial(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = features(_matrix(batch), mean, scale, seed)
            total += x.T @ np.hstack([x, np.asarray(batch.column("label")).astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["share"])

    shares = rows.mapInArrow(partial, "share array<double>")
    added = shares.select(F.posexplode("share").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    system = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for at, x in added:
        system[at] = x
    system = system.reshape(FEATURES + 1, FEATURES + 2)
    weights = np.linalg.solve(system[:, :-1] + RIDGE * got[0] * np.eye(FEATURES + 1) * np.append(np.ones(FEATURES), 0)[:, None] / FEATURES + 1e-9 * np.eye(FEATURES + 1), system[:, -1])
    model = Classifier(mean, scale, weights, (np.zeros(1), np.zeros(1)), seed)

    def binned(batches):
        for batch in batches:
            at = np.clip(np.floor((model.raw(_matrix(batch)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.int32())], ["bin", "label"])

    bins = sorted(tuple(r) for r in rows.mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.count("*"), F.sum("label")).collect())
    table = np.array(bins, float)
    model.knots = monotone((table[:, 0] + 0.5) / BINS * 2 - 0.5, table[:, 1], table[:, 2])
    return model


def score_statistics(stats: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, stats)."""
    id_type = stats.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        scores = model.scores(_matrix(batch))
        return {"doc_id": batch.column("doc_id"), "score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    return map_arrow(stats.select("doc_id", "stats"), run, f"doc_id {id_type}, score double, predicted int")


def statistics_of(text: Column) -> Column:
    """The statistics of whole texts as a column; null counts as empty."""

    @F.arrow_udf("array<double>")
    def measured(column: pa.Array) -> pa.Array:
        made = np.empty((len(column), len(STATISTICS)))
        for at in range(0, len(column), 256):
            for i, one in enumerate(column.slice(at, 256).to_pylist(), at):
                made[i] = statistics(one or "")
        release()
        offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(STATISTICS))
        return pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))

    return measured(text)


def keep_good(df: DataFrame, model: Classifier, text_col: str = "text", threshold: float = THRESHOLD, stats_col: str | None = None) -> DataFrame:
    """Rows of ``df`` that the classifier does not reject, by ``stats_col`` where the texts are measured already."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))))

    return df.filter(score(F.col(stats_col) if stats_col else statistics_of(F.col(text_col))) >= threshold)
