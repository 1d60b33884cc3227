"""Quality classifier: naive Bayes features under a linear support vector machine.

Features say which n-grams a text has: its words, pairs of words, and runs of one to four word shapes (case, ending, digits, equality
with the word before). Each present feature has the value of its log-count ratio between the classes, and a linear model with
hinge loss is fitted on these by dual coordinate descent. Scores are the margins put through a logistic curve that is fitted to
rows which the model has not seen. The fit uses a bounded sample of the labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import frugal, give_back

#: The fit takes about this many labelled rows at most, chosen by a hash of their ids; with fewer, all.
MOST_FITTED = 12_000
#: Features: words are hashed to the lower part of the space, then come pairs of words and shape n-grams.
WORD_BITS, PAIR_BITS, SHAPE_BITS = 17, 17, 16
PAIRS, SHAPES = 1 << WORD_BITS, (1 << WORD_BITS) + (1 << PAIR_BITS)
SIZE = SHAPES + (1 << SHAPE_BITS)
#: Of the fitted rows, one in so many is kept for the curve.
KEPT = 5
ORDER = 4
COST, EPOCHS, SMOOTHING = 0.1, 12, 1.0
#: Words that a task remembers, and rows that it scores together.
MEMORY, ROWS = 50_000, 500
MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> int:
    """A small number for a word's case, ending and digits."""
    letters = [c for c in word if c.isalpha()]
    case = 0 if not letters else 1 if word.islower() else 2 if word.isupper() else 3 if letters[0].isupper() and not any(c.isupper() for c in letters[1:]) else 4
    last = word[-1]
    tail = 0 if last.isalnum() else 1 if last in ".?;:" else 2 if last == "," else 3 if last == "!" else 4
    return 1 + (case * 5 + tail) * 2 + any(c.isdigit() for c in word)


class Features:
    """Turns texts into sorted feature numbers."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def word(self, word: bytes) -> tuple[int, int]:
        import xxhash

        if len(self.known) >= MEMORY:
            self.known.clear()
        made = (xxhash.xxh64_intdigest(word), shape(word.decode("utf-8", "replace")))
        if len(word) <= 64:
            self.known[word] = made
        return made

    def of(self, text: str | None) -> np.ndarray:
        known = self.known.get
        pairs = [known(w) or self.word(w) for w in (text or "").encode("utf-8", "replace").split()]
        if not pairs:
            return np.zeros(0, np.int64)
        hashed = np.array([h for h, _ in pairs], np.uint64)
        codes = np.array([s for _, s in pairs], np.uint64) * np.uint64(2)
        codes[1:] += (hashed[1:] == hashed[:-1]).astype(np.uint64)
        pairs = (hashed[1:] ^ hashed[:-1] * MIX) * MIX
        found = [(hashed * MIX >> np.uint64(64 - WORD_BITS)).astype(np.int64), (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + PAIRS]
        grams = codes + np.uint64(1)
        for n in range(ORDER):
            if n:
                grams = grams[:-1] * np.uint64(128) + codes[n:]
            mixed = (grams + np.uint64(n + 1)) * MIX
            found.append((((mixed ^ (mixed >> np.uint64(29))) * MIX) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + SHAPES)
            if len(grams) < 2:
                break
        return np.unique(np.concatenate(found))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each feature: log of its share among the good rows' features over that among the bad rows'."""
    counts = np.full((2, SIZE), SMOOTHING)
    for row, label in zip(rows, labels, strict=True):
        counts[int(label > 0), row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights of a linear hinge-loss model (L2-regularised, no bias) over rows of unit length, by dual coordinate descent."""
    weights, alphas = np.zeros(SIZE), np.zeros(len(rows))
    values = [scaled(row, ratios) for row in rows]
    share = np.array([(labels < 0).mean(), (labels > 0).mean()])
    costs = COST * len(rows) ** 0.5 * np.where(labels > 0, share[0], share[1]) * 2
    random = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            row, value, label = rows[i], values[i], labels[i]
            square = float(value @ value)
            if not square:
                continue
            slope = label * float(weights[row] @ value) - 1
            alpha = min(max(alphas[i] - slope / square, 0.0), costs[i])
            if alpha != alphas[i]:
                weights[row] += (alpha - alphas[i]) * label * value
                alphas[i] = alpha
    return weights


def scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    value = ratios[row]
    return value / max(float(np.sqrt(value @ value)), 1e-9) if len(value) else value


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margin to chance of label 1, with smoothed targets."""
    good, bad = (labels > 0).sum(), (labels < 0).sum()
    aims = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g0, g1 = float((p - aims) @ margins), float((p - aims).sum())
        a, b, c = float(w @ (margins * margins)) + 1e-6, float(w @ margins), float(w.sum()) + 1e-6
        det = a * c - b * b
        slope, offset = slope - (c * g0 - b * g1) / det, offset - (a * g1 - b * g0) / det
    return slope, offset


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per feature with a weight; feature -1 holds the curve's slope and offset. No rows if all labels are of one kind."""
    if (frame["label"] > 0).nunique() < 2:
        return pd.DataFrame({c: [] for c in ("feature", "ratio", "weight", "unseen")})
    frame = frame.sort_values(["doc_id", "label"], kind="stable")
    rows = [np.frombuffer(x, np.int32) for x in frame["row"]]
    labels = np.where(frame["label"].to_numpy() > 0, 1.0, -1.0)
    seen = np.arange(len(rows)) % KEPT != 0
    if len(set(labels[seen])) < 2 or len(set(labels[~seen])) < 2:
        seen[:] = True
    learned, unseen = np.flatnonzero(seen), np.flatnonzero(~seen) if not seen.all() else np.arange(len(rows))
    ratios = log_count_ratios([rows[i] for i in learned], labels[learned])
    weights = descend([rows[i] for i in learned], labels[learned], ratios)
    margins = np.array([float(weights[rows[i]] @ scaled(rows[i], ratios)) for i in unseen])
    slope, offset = logistic(margins, labels[unseen])
    used = np.flatnonzero((weights != 0) | (ratios != ratios[0]))
    return pd.DataFrame({"feature": [-1, *used], "ratio": [slope, *ratios[used]], "weight": [offset, *weights[used]], "unseen": float(np.median(ratios))})


def _fit_once(frame: pd.DataFrame) -> pd.DataFrame:
    """The fit, and its memory given back."""
    fitted = _fit(frame)
    give_back()
    return fitted


class Model:
    """The fitted arrays, of fixed size, as the scoring tasks get them."""

    def __init__(self, fitted: pd.DataFrame):
        self.ratios, self.weights = np.zeros(SIZE), np.zeros(SIZE)
        self.slope, self.offset = 0.0, 0.0
        if len(fitted):
            self.ratios[:] = fitted["unseen"].iloc[0]
            curve = fitted[fitted["feature"] < 0].iloc[0]
            self.slope, self.offset = float(curve["ratio"]), float(curve["weight"])
            rest = fitted[fitted["feature"] >= 0]
            self.ratios[rest["feature"]] = rest["ratio"]
            self.weights[rest["feature"]] = rest["weight"]

    def score(self, row: np.ndarray) -> float:
        margin = float(self.weights[row] @ scaled(row, self.ratios))
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


@frugal
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            made = pa.array([features.of(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["doc_id", "label", "row"])


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_FITTED) -> Model:
    """Fit on the labelled documents: (doc_id, text) and (doc_id, label 0 or 1). Null labels and texts of null ids are left out.

    Labels that repeat an id count each, also where they differ. With more than ``most`` labels, a share of them chosen by a hash of doc_id is used, so the fit's memory is bounded. Unless
    labels of both kinds belong to documents, every score is 0.5.
    """
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    n = labels.count()
    if n > most:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    taken = documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "label", "text")
    rows = taken.mapInArrow(_rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("row", T.BinaryType())]))
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_fit_once, "feature int, ratio double, weight double, unseen double")
    return Model(fitted.toPandas())


@frugal
def _scores(batches: Iterator[pa.RecordBatch], position: int, model) -> Iterator[pa.RecordBatch]:
    features = Features()
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            made = pa.array([model.value.score(features.of(t)) for t in batch.column(position).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "score"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` plus ``score``, 0 to 1, higher for better. Null and empty texts have no features and get the curve's value
    at margin 0. Rows are kept one for one; a column already named score is replaced."""
    kept = documents.drop("score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(partial(_scores, position=kept.columns.index("text"), model=shared), schema)
