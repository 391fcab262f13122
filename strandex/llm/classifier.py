"""Quality classifier on document statistics.

Statistics of a text (lengths, shares of kinds of characters, repetition of words, pairs of words and lines) are
standardised; random Fourier features of them approximate a Gaussian kernel; ridge regression on these is solved from
normal equations, which tasks sum over their rows and Spark sums over tasks. Labelled documents left out of that fit
calibrate its score to a probability by isotonic regression. Statistics are of whole texts, and nothing but the text enters.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .base import forget, written

FEATURES = 512
WIDTH = 8.0  # of the kernel, in standard deviations
RIDGE = 1.0
SEED = 13
THRESHOLD = 0.7
BINS = 4000  # of uncalibrated scores from -1 to 2; what the driver holds of them

STATISTICS = (
    "chars", "words", "word_length", "longest_word", "upper", "digits", "symbols", "marks", "stops", "other_ascii", "not_ascii", "blanks", "upper_words",
    "no_letters", "short_words", "distinct", "commonest", "repeats", "pair_repeats", "lines", "line_repeats", "line_length", "sentence_length", "first_upper", "capitalised",
)
_DIGITS, _SYMBOLS, _MARKS, _STOPS = b"0123456789", b"#*$%&|<>", b"!?", b".,;:"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, shares by their square root and counts by logarithm; an empty text has zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kind = lambda some: int(hist[list(some)].sum())
    chars = len(data) - int(hist[128:192].sum())
    n = len(words)
    upper, lower, digits = kind(_UPPER), kind(_LOWER), kind(_DIGITS)
    blanks = kind(b" \t\n\r\x0b\x0c")
    symbols, marks, stops, wide = kind(_SYMBOLS), kind(_MARKS), kind(_STOPS), int(hist[192:].sum())
    counted = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    capital = no_letters = short = shout = 0
    letters = _UPPER + _LOWER
    for w, times in counted.items():
        short += times * (len(w) <= 3)
        first = w[0]
        capital += times * (65 <= first <= 90)
        bare = len(w) == len(w.translate(None, letters)) and w.isascii()
        no_letters += times * bare
        shout += times * (w.isupper() and len(w) > 1)
    share = lambda x, of: math.sqrt(max(0.0, x / of)) if of else 0.0
    log = lambda x: math.log1p(x)
    return [
        log(chars), log(n), log((chars - blanks) / n), log(max(map(len, counted))), share(upper, upper + lower), share(digits, chars), share(symbols, chars), share(marks, chars), share(stops, chars),
        share(chars - upper - lower - digits - blanks - symbols - marks - stops - wide, chars), share(wide, chars), share(blanks, chars), share(shout, n),
        share(no_letters, n), share(short, n), share(len(counted), n), share(max(counted.values()), n), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(n - 1 - pairs, n),
        log(len(lines)), share(len(lines) - len(set(lines)), len(lines)), log(chars / max(1, len(lines))), log(n / (1 + hist[ord(".")])), float(65 <= data.lstrip()[0] <= 90 or data.lstrip()[0] > 127), share(capital, n),
    ]


def features(docs: DataFrame, keep: tuple[Column, ...] = (), text: str = "text") -> DataFrame:
    """`keep` columns and `x`, the statistics of each text."""
    kept = docs.select(*keep)
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes] + ["x array<double>"])
    names = kept.columns

    def run(batches):
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("__sx_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    return docs.select(*keep, F.col(text).alias("__sx_text")).mapInArrow(run, schema)


class Kernel:
    """Random Fourier features of standardised statistics; the last one is constant."""

    def __init__(self, mean, deviation, count: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.array(mean, float), 1 / np.maximum(np.array(deviation, float), 1e-9)
        self.scale[np.array(deviation) < 1e-9] = 0.0
        self.w = rng.normal(0, 1 / width, (len(mean), count))
        self.b = rng.uniform(0, 2 * math.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.hstack([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """The sum over rows (x, n, total) of n z z' with, as last column, total z: each task's, then of tasks in two steps.

    A row stands for n labels that sum to `total`. What is summed has one size, whatever the number of rows.
    """
    d = len(kernel.b) + 1
    bands = 16  # of lines of the matrix
    size = -(-d // bands)

    def partial(batches):
        total = np.zeros((d, d + 1))
        for batch in batches:
            x, n, y = _rows(batch.column("x")), batch.column("n").to_numpy().astype(float), batch.column("total").to_numpy().astype(float)
            for at in range(0, len(x), 4096):
                z = kernel(x[at : at + 4096])
                total[:, :d] += z.T @ (z * n[at : at + 4096, None])
                total[:, d] += z.T @ y[at : at + 4096]
        part = TaskContext.get().partitionId()
        bytes_ = [total[b * size : (b + 1) * size].tobytes() for b in range(bands)]
        yield pa.RecordBatch.from_arrays([pa.array(range(bands), pa.int32()), pa.array([part % 64] * bands, pa.int32()), pa.array(bytes_, pa.binary())], ["band", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["sums"].iloc[0]) // 8)
        for b in pdf["sums"]:
            total += np.frombuffer(b)
        return pd.DataFrame({"band": pdf["band"].iloc[:1], "part": [0], "sums": [total.tobytes()]})

    schema = "band int, part int, sums binary"
    sums = rows.select("x", "n", "total").mapInArrow(partial, schema)
    sums = sums.groupBy("band", "part").applyInPandas(add, schema).groupBy("band").applyInPandas(add, schema)
    got = sorted(sums.collect(), key=lambda r: r["band"])  # 16 rows, 2 MB
    return np.vstack([np.frombuffer(r["sums"]).reshape(-1, d + 1) for r in got]) if got else np.zeros((d, d + 1))


def ridge(equations: np.ndarray, strength: float = RIDGE) -> np.ndarray:
    """Weights of the features; the constant, which is the last, isn't shrunk."""
    d = len(equations)
    shrink = np.full(d, strength)
    shrink[-1] = 1e-9
    return np.linalg.solve(equations[:, :d] + np.diag(shrink), equations[:, d])


def isotonic(score: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, share) of the non-decreasing shares nearest to total / n in squares: neighbours that fall are pooled.

    Between the middles of pools shares go straight, so that equal shares stay few and order stays.
    """
    pools: list[list[float]] = []  # sum of labels, labels, sum of scores
    for s, k, t in sorted(zip(score.tolist(), n.tolist(), total.tolist(), strict=True)):
        pools.append([t, k, s * k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Model:
    def __init__(self, kernel: Kernel, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.kernel, self.weights, self.knots = kernel, weights, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.kernel(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # A hundredth of the raw score keeps the order where the calibrated one is level.
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 * (raw + 1) / 3, 0, 1)


def fit(rows: DataFrame) -> Model | None:
    """A model from rows (x, n, total, calibrate): n labels that sum to `total`; None without any. All rows take part."""
    size = len(STATISTICS)
    own = rows.where(~F.col("calibrate"))
    moments = own.agg(F.count("*").alias("rows"), *(f(F.get("x", F.lit(i))).alias(f"{name}{i}") for i in range(size) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not moments["rows"]:
        return None
    kernel = Kernel([moments[f"m{i}"] for i in range(size)], [moments[f"s{i}"] for i in range(size)])
    weights = ridge(normal_equations(own, kernel))
    model = Model(kernel, weights, (np.array([0.0]), np.array([0.0])))

    def binned(batches):
        for batch in batches:
            raw = model.raw(_rows(batch.column("x"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 1) / 3 * BINS).astype(np.int32)), batch.column("n"), batch.column("total")], ["bin", "n", "total"])

    def bins(some: DataFrame) -> list:
        return some.select("x", "n", "total").mapInArrow(binned, "bin int, n long, total long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()

    got = bins(rows.where("calibrate")) or bins(own)  # BINS + 1 rows at most
    score, n, total = (np.array([r[c] for r in got], float) for c in ("bin", "n", "total"))
    model.knots = isotonic(score / BINS * 3 - 1, n, total)
    return model


def crc(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row of `docs`; labels are learned where `learn`, a condition on the label's id, holds.

    All such labels take part; a fifth of their ids, by hash, calibrates. An id with several labels counts as their mean, and null labels and ids don't.
    Null and empty texts have statistics of zeros. Rows are scored each, whatever their id, null included; columns of `docs`
    but id and text are ignored. Without labels every score is 0.5; an empty table gives an empty one.
    """
    x = written(features(docs, (F.col(id).alias("doc_id"),), text), "statistics")
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & learn)
    known = known.groupBy(F.col(id).alias("_id")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("total"))
    rows = x.join(known, x["doc_id"] == known["_id"]).select("x", "n", "total", (F.pmod(F.xxhash64("_id"), F.lit(5)) == 0).alias("calibrate"))
    rows = written(rows, "labelled")
    model = fit(rows)
    forget(rows)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score = (model.score(_rows(batch.column("x"))) if model else np.full(n, 0.5)) if n else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return x.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id]}, score double, predicted int")


def op13_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learned from `labels` whose crc32(doc_id) mod 4 is not 2. Awkward rows: see classify."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs, labels, F.pmod(crc("doc_id"), F.lit(4)) != 2)
    return out.select("doc_id", F.coalesce(F.pmod(crc("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
