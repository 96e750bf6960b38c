"""Quality classifier: a linear support vector model over naive Bayes features.

A text's features are indicators of its n-grams, hashed to ``SLOTS`` slots:
one to four bytes, one and two words (ASCII lower case), and the equality
pattern of four words (which of them repeat an earlier one). Each indicator is
scaled by the log-count ratio of its slot between the two classes, counted over
all labelled texts that may be learned from, and a text's vector is brought to
length one. A hinge-loss model is fitted to a bounded sample by dual coordinate
descent; a sigmoid fitted to margins of rows left out turns its margin into a
probability.

Counts are summed by Spark over every labelled text; the model is a table of
``SLOTS`` weights, whatever the size of the corpus, so a broadcast of it is
bounded. The fit takes ``SAMPLE_ROWS`` rows, those with the smallest hashes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rlframe.llm.shared import arrow_batch, staged, text_bytes

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Bound of the fit: rows in order of their hash, and their features in all.
SAMPLE_ROWS = 8_000
SAMPLE_FEATURES = 60_000_000
#: Share of text rows that are read at once, in bytes of a text.
BLOCK = 1 << 20
#: Slots of one row of the table of counts.
CHUNK = 4096
FOLDS = 3

_MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _slots(grams: np.ndarray, family: int) -> np.ndarray:
    """Slots of n-grams given as 64-bit keys; families do not share keys."""
    x = (grams + np.uint64(family << 56)) * _MIX_A
    x ^= x >> np.uint64(29)
    x *= _MIX_B
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Indicators:
    """Distinct slots of one text at a time."""

    def __init__(self):
        self.seen = np.zeros(SLOTS, bool)

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct slots; empty for a text without a byte."""
        if not text:
            return np.zeros(0, np.int64)
        seen = self.seen
        for at in range(0, len(text), BLOCK):
            block = np.frombuffer(text, np.uint8, min(BLOCK + 3, len(text) - at), at).astype(np.uint64)
            key = np.zeros(len(block), np.uint64)
            for n in range(1, min(4, len(block)) + 1):
                key = key[:len(block) - n + 1] * np.uint64(256) + block[n - 1:]
                seen[_slots(key, n)] = True
        words = text.lower().split()
        if words:
            key = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
            seen[_slots(key, 5)] = True
            seen[_slots(key[:-1] << np.uint64(24) ^ key[1:] * _MIX_A >> np.uint64(8), 6)] = True
            if len(words) > 3:
                a, b, c, d = (key[i:len(key) - 3 + i] for i in range(4))
                equal = (a == b, a == c, a == d, b == c, b == d, c == d)
                seen[_slots(sum(x.astype(np.uint64) << np.uint64(i) for i, x in enumerate(equal)), 7)] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        return out


def log_count_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log ratio of each slot's share in the two classes, one added to counts."""
    p, q = good + 1.0, bad + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


@dataclass
class Rows:
    """Sparse rows: slots of all rows in one array, and each row's bounds."""

    slots: np.ndarray
    at: np.ndarray
    good: np.ndarray

    def scaled(self, ratio: np.ndarray) -> np.ndarray:
        values = ratio[self.slots]
        length = np.sqrt(np.maximum(_row_sums(values * values, self.at), 1e-300))
        return values / np.repeat(length, np.diff(self.at))

    def margins(self, ratio: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        return _row_sums(self.scaled(ratio) * weights[self.slots], self.at) + bias


def _row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, at[full])
    return out


def dual_coordinate_descent(rows: Rows, values: np.ndarray, use: np.ndarray, cost: float = 10.0,
                            epochs: int = 40, tolerance: float = 0.01) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model over rows ``use``.

    Each step solves one row's dual variable exactly, within 0 and ``cost``;
    the bias is the weight of a constant feature. Ends when no projected
    gradient of an epoch exceeds ``tolerance``."""
    w, bias = np.zeros(SLOTS), 0.0
    dual = np.zeros(len(rows.at) - 1)
    sign = np.where(rows.good, 1.0, -1.0)
    square = _row_sums(values * values, rows.at) + 1.0
    order = np.random.default_rng(17)
    for _ in range(epochs):
        worst = 0.0
        for k in order.permutation(use).tolist():
            lo, hi = rows.at[k], rows.at[k + 1]
            s, v = rows.slots[lo:hi], values[lo:hi]
            slope = sign[k] * (w[s] @ v + bias) - 1
            now = dual[k]
            worst = max(worst, abs(min(slope, 0.0) if now == 0 else max(slope, 0.0) if now == cost else slope))
            new = min(max(now - slope / square[k], 0.0), cost)
            if new != now:
                step = (new - now) * sign[k]
                w[s] += step * v  # slots of a row are distinct
                bias += step
                dual[k] = new
        if worst < tolerance:
            break
    return w, bias, dual


def sigmoid_fit(margins: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by damped
    Newton steps on targets that are drawn in by one pseudo count a class."""
    n1, n0 = int(good.sum()), int((~good).sum())
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    c = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(c):
        z = x @ c
        return float(np.sum(np.logaddexp(0, z) - target * z))

    best = loss(c)
    for _ in range(steps):
        p = _logistic(x @ c)
        slope = x.T @ (p - target)
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        move, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-9 and loss(c - size * move) > best:
            size /= 2
        c, was = c - size * move, best
        best = min(best, loss(c))
        if was - best < 1e-10 * max(1.0, was):
            break
    return float(c[0]), float(c[1])


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    """Everything a task needs to score texts: tables of ``SLOTS`` numbers."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, slots: np.ndarray) -> float:
        r = self.ratio[slots]
        length = np.sqrt(r @ r)
        margin = self.bias + (r @ self.weights[slots] / length if length > 0 else 0.0)
        return float(_logistic(self.slope * margin + self.shift))


def fit(rows: Rows, good: np.ndarray, bad: np.ndarray) -> Model:
    """The model of the sample's rows; ``good`` and ``bad`` are the slots' counts
    over all labelled texts. Without rows of both classes the score is the
    share of label 1, one added to each class."""
    n1, n0 = int(rows.good.sum()), int((~rows.good).sum())
    ratio = log_count_ratio(good, bad)
    if not n1 or not n0:
        return Model(ratio, np.zeros(SLOTS), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    # margins of rows that neither the counts nor the model have seen
    part = np.zeros(len(rows.good), np.int64)
    for kind in (rows.good, ~rows.good):
        part[kind] = np.arange(kind.sum()) % FOLDS
    margins = np.zeros(len(part))
    for k in range(FOLDS):
        out = np.flatnonzero(part == k)
        own = {True: np.zeros(SLOTS), False: np.zeros(SLOTS)}
        for i in out:
            own[bool(rows.good[i])][rows.slots[rows.at[i]:rows.at[i + 1]]] += 1
        r = log_count_ratio(np.maximum(good - own[True], 0), np.maximum(bad - own[False], 0))
        w, bias, _ = dual_coordinate_descent(rows, rows.scaled(r), np.flatnonzero(part != k))
        margins[out] = rows.margins(r, w, bias)[out]
    slope, shift = sigmoid_fit(margins, rows.good)
    w, bias, _ = dual_coordinate_descent(rows, rows.scaled(ratio), np.arange(len(part)))
    return Model(ratio, w, bias, slope, shift)


def held_out() -> Column:
    """Rows whose labels are never learned from; a row without doc_id hashes ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, text, good) of the documents that may be learned from.

    A doc_id with several labels takes the more frequent one, 0 if tied; null
    labels do not count, and a null doc_id has no label. Rows of one doc_id
    are joined to one row of labels, however often either repeats."""
    votes = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id") \
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("_votes")) \
        .hint("merge")  # labels grow with the documents: no size at which they are broadcast
    mine = docs.select("doc_id", text_bytes().alias("text")).filter(~held_out())
    return mine.join(votes, "doc_id").select(
        F.xxhash64("doc_id", "text").alias("h"), "text", (F.col("_votes") > 0).alias("good"))


def slot_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each class have each slot, over all ``texts``.

    A task adds up its texts and hands on a few dense pieces of ``CHUNK``
    slots; pieces of one place are summed by Spark, one task for each place."""
    def count(batches):
        total = np.zeros((2, SLOTS), np.int64)
        indicators = Indicators()
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("good").to_pylist()):
                total[int(good), indicators.of(text.as_py())] += 1
        places = [k for k in range(0, SLOTS, CHUNK) if total[:, k:k + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(
            [total[:, k:k + CHUNK].tobytes() for k in places], pa.binary())], names=["place", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, counts in zip(batch.column("place").to_pylist(), batch.column("counts")):
                total[place] = total.get(place, 0) + np.frombuffer(counts.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [x.tobytes() for x in total.values()], pa.binary())], names=["place", "counts"])

    schema = "place int, counts binary"
    out = np.zeros((2, SLOTS))
    pieces = texts.mapInArrow(count, schema).repartition(SLOTS // CHUNK, "place").mapInArrow(add, schema)
    for place, counts in pieces.collect():  # SLOTS numbers a class
        out[:, place:place + CHUNK] = np.frombuffer(counts, np.int64).reshape(2, CHUNK)
    return out[1], out[0]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Count over all labelled texts, then fit to the bounded sample in one task."""
    texts = staged(labelled_texts(docs, labels), "labelled-texts")
    good, bad = slot_counts(texts)
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, texts.count()))
    sample = texts.filter(F.col("h") < int(-(2 ** 63) + share * (2 ** 64 - 1)) if share < 1 else F.lit(True)) \
        .dropDuplicates(["h"]).repartition(1).sortWithinPartitions("h")

    def learn(batches):
        indicators, slots, labels_, total = Indicators(), [], [], 0
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("good").to_pylist()):
                if len(slots) < SAMPLE_ROWS and total < SAMPLE_FEATURES:
                    slots.append(indicators.of(text.as_py()).astype(np.int32))
                    labels_.append(label)
                    total += len(slots[-1])
        at = np.concatenate([[0], np.cumsum([len(s) for s in slots], dtype=np.int64)]).astype(np.int64)
        rows = Rows(np.concatenate([*slots, np.zeros(0, np.int32)]), at, np.array(labels_, bool))
        m = fit(rows, good, bad)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), *(
            pa.array([x]) for x in (m.bias, m.slope, m.shift))], names=["weights", "bias", "slope", "shift"])

    got = sample.mapInArrow(learn, "weights binary, bias double, slope double, shift double").collect()
    ratio = log_count_ratio(good, bad)
    if not got:  # no labelled text at all
        return Model(ratio, np.zeros(SLOTS), 0.0, 0.0, 0.0)
    return Model(ratio, np.frombuffer(got[0].weights), got[0].bias, got[0].slope, got[0].shift)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted.

    Trains first. Only the text enters a score: null and empty texts score by
    the model's bias, equal texts alike. One row out per row in, repeats and
    null doc_ids too (these hash as ''); other columns are not read. Without
    labels of both classes the score is one number for all; an empty table
    gives no rows. Texts are taken whole, of any length; a task holds one
    text's words and ``SLOTS`` marks."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches):
        indicators = Indicators()
        for batch in batches:
            scores = [model.value.score(indicators.of(t.as_py())) for t in batch.column("_text")]
            yield arrow_batch(SCHEMA, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=scores)

    source = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_bytes().alias("_text"))
    out = source.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
