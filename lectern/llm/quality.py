"""Quality by Bradley-Terry pairwise ranking.

Of a labelled pair, the document of class 1 is preferred. The chance of that is the logistic
function of the difference of the two scores, and scores are linear in features of the whole text,
so fitting takes a logistic loss on feature differences (no intercept: only the order matters). All
labelled documents that may be learnt from take part: tasks measure whole texts where they are read and pass on their features alone, each document of
the larger class is paired with several of the other in turn, and each of Newton's steps adds up what
tasks tell of their pairs. The score's threshold is the quantile of all these documents that cuts off as
large a part of them as class 0 has; scores reach users through a logistic function that is ``CUT`` there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import pick, ranked, ship, stored

CUT = 0.3
#: Pairs of each document of the larger class at least; more where that would make fewer than PAIRS.
LEAST_PAIRED = 2
#: Rank error of the middles: one part in so many; tables with fewer labels have exact ones.
ACCURACY = 100_000
PAIRS, RIDGE, STEPS = 30_000, 1e-3, 12
#: Words that a Python worker remembers before it starts anew.
REMEMBERED = 400_000
_COUNTED = ("chars", "upper", "letters", "digits", "odd", "odd_end", "stop", "bare_odd", "long")
FEATURES = ("words", "upper", "digits", "odd", "odd_end", "bare_odd", "stops", "word_length", "repeats", "distinct", "long", "first_case")


class Memory(dict):
    """From a token to its number, with what is counted of each."""

    def __init__(self):
        super().__init__()
        self.counts: list[tuple[int, ...]] = []
        self.table = np.zeros((0, len(_COUNTED)))

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self.counts)
        odd = sum(not c.isalnum() and c not in ".,;:'’-" for c in w)
        letters = sum(map(str.isalpha, w))
        self.counts.append((len(w), sum(map(str.isupper, w)), letters, sum(map(str.isdigit, w)), odd, int(not w[-1].isalnum() and w[-1] not in ".,;:)\"'»”"), int(w[-1] in ".!?"), int(odd == len(w)), int(len(w) > 25)))
        return i

    def of(self, idx: np.ndarray) -> np.ndarray:
        if len(self.table) < len(self.counts):
            self.table = np.concatenate([self.table, np.array(self.counts[len(self.table) :], float)])
        return self.table[idx]


def measure(texts: list[str | None], memory: Memory) -> np.ndarray:
    """The features of each text; zeros without words."""
    idx, n = [], []
    for x in texts:
        tokens = x.split() if x else []
        idx.append(np.fromiter(map(memory.__getitem__, tokens), np.int64, len(tokens)))
        n.append(len(tokens))
    idx, n = np.concatenate(idx), np.array(n)
    out = np.zeros((len(texts), len(FEATURES)))
    some = n > 0
    if not some.any():
        return out
    doc = np.repeat(np.arange(len(n)), n)
    starts = (np.cumsum(n) - n)[some]
    sums = np.add.reduceat(memory.of(idx), starts, axis=0)
    k, c = n[some].astype(float), dict(zip(_COUNTED, sums.T, strict=True))
    same = np.zeros(len(idx))
    same[1:] = (idx[1:] == idx[:-1]) & (doc[1:] == doc[:-1])
    key = np.unique(doc * (int(idx.max()) + 1) + idx)
    distinct = np.bincount(key // (int(idx.max()) + 1), minlength=len(n))[some]
    letters, chars = np.maximum(c["letters"], 1), np.maximum(c["chars"], 1)
    # Long texts repeat more of their words: compare with what the square root of the length would allow.
    out[some] = np.stack([np.log1p(k), c["upper"] / letters, c["digits"] / chars, c["odd"] / chars, c["odd_end"] / k, c["bare_odd"] / k, c["stop"] / k, chars / k, np.add.reduceat(same, starts) / k, distinct / k, c["long"] / k, np.minimum(1, c["upper"] / k)], axis=1)
    return out


@dataclass
class Model:
    """Features are put in ranges of about 1, and extended by their excess over the middle."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float = 0.0
    width: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.middle, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.at) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def expand(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - middle) / scale, -8, 8)
    return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)


def _sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of pairs with differences ``d`` what a step adds up: a row for the slope of the loss, and one for each row of its curvature."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
    return np.vstack([d.T @ p, (d * (p * (1 - p))[:, None]).T @ d])


def _stepped(w: np.ndarray, sums: np.ndarray, pairs: int) -> np.ndarray:
    """Newton's method on the mean loss."""
    grad = RIDGE * w - sums[0] / pairs
    curve = sums[1:] / pairs + (RIDGE + 1e-6) * np.eye(len(w))
    step = np.linalg.solve(curve, grad)
    return w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))


def fit(x: np.ndarray, y: np.ndarray, share: float, seed: int = 0) -> Model:
    """A model from features and classes; ``share`` is class 0's part of all labels. Constant if a class is missing."""
    width = x.shape[1]
    middle, scale = np.zeros(width), np.ones(width)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(middle, scale, np.zeros(3 * width), 0.0 if len(bad) else -10.0)
    middle = np.median(x[good], axis=0)
    scale = np.maximum(x[good].std(axis=0), 1e-3)
    z = expand(x, middle, scale)
    rng = np.random.default_rng(seed)
    pairs = min(PAIRS, 20 * len(y))
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        w = _stepped(w, _sums(d, w), pairs)
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    weight = np.where(y[order] == 0, share / len(bad), (1 - share) / len(good))
    k = int(np.searchsorted(np.cumsum(weight), share))
    k = min(k, len(order) - 2)
    # Between the two middles of what lies on either side of the quantile, not on a document of the sample.
    low, high = raw[order[k]], raw[order[k + 1]]
    spread = np.median(raw[good]) - np.median(raw[bad])
    return Model(middle, scale, w, float((low + high) / 2), float(max(spread / 12, 1e-6)))


def featured(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, given (whether there is a text) and x, the features of the whole text."""
    ship(docs.sparkSession)

    def run(arrived):
        memory = Memory()
        for b in arrived:
            text, out = b.column("text").to_pylist(), []
            for first in range(0, len(text), 1000):
                if len(memory) > REMEMBERED:
                    memory = Memory()
                out.extend(measure(text[first : first + 1000], memory))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text").is_valid(), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "given", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, given boolean, x array<double>")


def _scores(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of ``featured`` rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # some dozens of numbers

    def run(arrived):
        for b in arrived:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(_matrix(b.column("x"))) if b.num_rows else np.zeros(0))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1).

    Null and empty texts have all features 0 and a score by them; repeated rows are scored each; a
    null doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    return _scores(featured(docs), model)


def scored_by_labels(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> DataFrame:
    """``scored`` by the model ``trained`` on the same ``docs``: texts are read and measured once, their features stored, and no text is shuffled."""
    rows = stored(featured(docs), "features")
    return _scores(rows, _fitted(rows, labels, learn, label))


def measured(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> DataFrame:
    """(doc_id, y, x: the features of the whole text) of all labelled documents for whose doc_id ``learn`` holds.

    Labels other than 0 and 1, null ids and null texts are left out.
    """
    return _labelled(featured(docs), labels, learn, label)


def _labelled(rows: DataFrame, labels: DataFrame, learn: Column, label: str) -> DataFrame:
    """``measured``, from ``featured`` rows."""
    known = pick(labels, "doc_id", label).select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    return rows.where("given").join(known, "doc_id").select("doc_id", "y", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def _paired(rows: DataFrame, bad: int, good: int) -> tuple[DataFrame, int]:
    """Pairs (g, b: features of a document of class 1 and of one of class 0), and their number; each document is in one at least."""
    # Class 0 has the first places.
    at = ranked(rows, "place", F.col("y"), F.xxhash64("doc_id"), F.col("doc_id"))
    own = [at.where(f"y = {y}").select((F.col("place") - y * bad).alias("i"), F.col("x").alias("bg"[y])) for y in (0, 1)]
    few, many = sorted((bad, good))
    each = min(few, max(LEAST_PAIRED, -(-min(PAIRS, 20 * (bad + good)) // many)))
    large, small = own if bad > good else own[::-1]
    partners = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda j: (F.col("i") * each + j) % few)
    return large.withColumn("k", F.explode(partners)).drop("i").join(small.withColumnRenamed("i", "k"), "k").select("g", "b"), many * each


def trained(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """A model of ``label`` from all labelled documents for whose doc_id ``learn`` holds; constant if a class is missing."""
    return _fitted(featured(docs), labels, learn, label)


def _fitted(features: DataFrame, labels: DataFrame, learn: Column, label: str) -> Model:
    """The model of ``trained`` from ``featured`` rows. To the driver come sums and single rows: some 10 KB of each task of a step."""
    rows = stored(_labelled(features, labels, learn, label), "measured")
    width = len(FEATURES)
    number = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = number.get(0, 0), number.get(1, 0)
    if not bad or not good:
        return Model(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0 if bad else -10.0)
    of = [F.col("x")[i] for i in range(width)]
    told = rows.where("y = 1").agg(*(F.percentile_approx(c, 0.5, ACCURACY) for c in of), *(F.stddev_pop(c) for c in of)).first()
    middle, scale = np.array(told[:width], float), np.maximum(np.array(told[width:], float), 1e-3)
    pairs, n = _paired(rows, bad, good)
    pairs = stored(pairs, "pairs")

    def sums(w: np.ndarray) -> np.ndarray:
        def run(arrived):
            total = np.zeros((len(w) + 1, len(w)))
            for b in arrived:
                if b.num_rows:
                    total += _sums(expand(_matrix(b.column("g")), middle, scale) - expand(_matrix(b.column("b")), middle, scale), w)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        parts = sorted(pairs.mapInArrow(run, "part int, sums binary").collect())
        return sum(np.frombuffer(r["sums"]).reshape(len(w) + 1, len(w)) for r in parts)

    w = np.zeros(3 * width)
    for _ in range(STEPS):
        w = _stepped(w, sums(w), n)
    model = Model(middle, scale, w)

    def run(arrived):
        for b in arrived:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(model.raw(_matrix(b.column("x"))))], ["y", "raw"])

    raw = ranked(rows.mapInArrow(run, "y int, raw double"), "place", F.col("raw"), F.col("y"))
    # Between the two middles of what lies on either side of the quantile, not on a document.
    k = min(bad - 1, bad + good - 2)
    low, high = sorted(r["raw"] for r in raw.where(F.col("place").isin(k, k + 1)).select("raw").collect())
    of_class = raw.groupBy("y").agg(F.percentile_approx("raw", 0.5, ACCURACY).alias("m")).collect()
    spread = sum(r["m"] * (1 if r["y"] else -1) for r in of_class)
    return Model(middle, scale, w, float((low + high) / 2), float(max(spread / 12, 1e-6)))
