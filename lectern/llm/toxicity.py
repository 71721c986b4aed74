"""Toxic spans by a linear-chain conditional random field of two states.

Labels are of documents, so tokens are labelled first: in toxic documents those whose word or word
beginning is more frequent in toxic documents than chance explains, where repeats between the same
neighbours count once, as copies of a toxic document prove nothing about its words. The field is then fitted to the
labelled tokens of sentences by maximum likelihood (word, beginnings of 4 and 5 letters, bias and
transitions). Forward-backward marginals of all tokens of a whole text give its score (one minus the
chance that its three likeliest tokens are all harmless) and the offsets of offending tokens.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from lectern.llm.common import pick, ship
from lectern.llm.labelled import BYTES, PER_CLASS, sample

#: Chains that are carried on one by one where no more are as long.
FEW = 8
#: Words that a Python worker remembers before it starts anew.
REMEMBERED = 400_000
#: Toxic documents of the sample that a word or beginning must be in, and how much more frequent it must be there.
#: Its likelihood ratio must also be one that chance gives to less than ``CHANCE`` of all candidates together.
LEAST_DOCS, LEAST_ODDS, CHANCE = 3, 8.0, 0.1
#: Unlabelled chains of each class that are kept to choose from while fitting.
SPARE = 20_000
ROUNDS, RATE, RIDGE = 80, 0.3, 1e-4
_STRIP = " \t\r\n.,;:!?\"'()[]{}<>*_-+=/\\|#$%&@~^`«»„“”‘’…¡¿"


def bare(token: str) -> str:
    return token.lower().strip(_STRIP)


def features(token: str) -> list[str]:
    w = bare(token)
    return [f for f, ok in ((w, w), ("4" + w[:4], len(w) > 4), ("5" + w[:5], len(w) > 5)) if ok]


@dataclass
class Model:
    """Weights of features for the toxic state; start and transitions as log-odds and scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # from 0 to 0, 0 to 1, 1 to 0, 1 to 1

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))


class Memory(dict):
    """From a token to its number in ``emission`` and ``ends``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.emission, self.ends = model, [], []

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self.emission)
        self.emission.append(self.model.emission(token))
        self.ends.append(token[-1] in ".!?")
        return i


def chains(ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of chains: sentences within documents (tokens of each)."""
    last = ends.copy()
    last[np.cumsum(docs)[docs > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]]).astype(np.int64)
    return start, stop - start


def marginals(e: np.ndarray, start: np.ndarray, n: np.ndarray, trans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the toxic state for each token given its whole chain, and its forward and backward parts.

    All chains go one token at a time together; the last few, which are much longer, each on its own.
    """
    a = np.exp(np.asarray(trans, float))
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    forward, backward = np.empty(len(e)), np.zeros(len(e))
    # Tokens that more than FEW chains have.
    together = int(n[FEW]) if len(n) > FEW else 0
    active = np.searchsorted(-n, -np.arange(together), "left")  # chains with more than t tokens
    r = np.zeros(0)
    for t, k in enumerate(active.tolist()):
        at = start[:k] + t
        if t == 0:
            r = e[at]
        else:
            x = np.exp(np.minimum(r[:k], 500))
            r = e[at] + np.log((a[1] + a[3] * x) / (a[0] + a[2] * x))
        forward[at] = r
    a0, a1, a2, a3 = a.tolist()
    b = np.zeros(len(n))
    for i in range(int(np.searchsorted(-n, -together, "left"))):
        first, own = int(start[i]), e[start[i] : start[i] + n[i]].tolist()
        out = [forward[first + together - 1]] if together else [own[0]]
        for v in own[together or 1 :]:
            x = math.exp(min(out[-1], 500))
            out.append(v + math.log((a1 + a3 * x) / (a0 + a2 * x)))
        forward[first + max(together - 1, 0) : first + n[i]] = out
        back = [0.0]
        for v in own[: max(together, 1) - 1 : -1]:
            x = math.exp(min(v + back[-1], 500))
            back.append(math.log((a2 + a3 * x) / (a0 + a1 * x)))
        backward[first + max(together, 1) - 1 : first + n[i]] = back[::-1]
        b[i] = back[-1]
    for t in range(together - 2, -1, -1):
        k = int(active[t + 1])
        at = start[:k] + t
        x = np.exp(np.minimum(e[at + 1] + b[:k], 500))
        b[:k] = np.log((a[2] + a[3] * x) / (a[0] + a[1] * x))
        backward[at] = b[:k]
    return forward + backward, forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _ratio(k: int, other: int, clean: int, toxic: int) -> float:
    """Twice the log-likelihood ratio of documents with a feature falling on the classes as they do, or by the classes' sizes."""
    n, share = k + other, toxic / (clean + toxic)
    return 2 * (k * np.log(k / (n * share)) + (other * np.log(other / (n * (1 - share))) if other else 0))


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from texts labelled as wholes; one that calls nothing toxic if a class is missing."""
    total = (toxic.count(0), toxic.count(1))
    if not total[0] or not total[1]:
        return Model()
    # Of the clean documents only what is in enough toxic ones is counted.
    in_toxic: Counter = Counter()
    for x, y in zip(texts, toxic, strict=True):
        if y:
            in_toxic.update({f for w in set(x.split()) for f in features(w)})
    in_toxic = Counter({f: k for f, k in in_toxic.items() if k >= LEAST_DOCS})
    in_clean: Counter = Counter()
    for x, y in zip(texts, toxic, strict=True):
        if not y:
            in_clean.update({f for w in set(x.split()) for f in features(w) if f in in_toxic})
    likely = {f for f, k in in_toxic.items() if (k + 0.1) / total[1] >= LEAST_ODDS * (in_clean[f] + 0.1) / total[0]}
    del in_toxic, in_clean
    places: tuple[set, set] = (set(), set())
    for x, y in zip(texts, toxic, strict=True):
        tokens = ["", *x.split(), ""]
        places[y].update((f, hash((bare(a), bare(b)))) for a, w, b in zip(tokens, tokens[1:], tokens[2:], strict=False) for f in features(w) if f in likely)
    at = tuple(Counter(p[0] for p in places[y]) for y in (0, 1))
    del places
    found = {f: (k, at[0][f]) for f, k in at[1].items() if k >= LEAST_DOCS}
    least = 2 * np.log(max(1, len(found)) / CHANCE)
    number = {f: i for i, f in enumerate(sorted(f for f, (k, other) in found.items() if (k + 0.1) / total[1] >= LEAST_ODDS * (other + 0.1) / total[0] and _ratio(k, other, *total) >= least))}
    # Chains with a labelled token, and a random sample from each class of those that have none.
    seen, labels, spare, passed, rng = [], [], ([], []), [0, 0], random.Random(0)
    for x, y in zip(texts, toxic, strict=True):
        tokens = x.split()
        if not tokens:
            continue
        start, n = chains(np.array([t[-1] in ".!?" for t in tokens]), np.array([len(tokens)]))
        for s, k in zip(start.tolist(), n.tolist(), strict=True):
            own = [[number[f] for f in features(t) if f in number] for t in tokens[s : s + k]]
            marked = [bool(y and f) for f in own]
            if any(marked):
                seen.append(own), labels.append(marked)
            elif len(spare[y]) < SPARE:
                spare[y].append(own)
                passed[y] += 1
            else:
                passed[y] += 1
                if (at_ := rng.randrange(passed[y])) < SPARE:
                    spare[y][at_] = own
    for y in (0, 1):
        hard = [c for c in spare[y] if any(c)]
        more = hard + [c for c in spare[y] if not any(c)][: max(1000, len(seen))]
        seen += more
        labels += [[False] * len(c) for c in more]
    n = np.array([len(c) for c in seen], np.int64)
    start = np.cumsum(n) - n
    y = np.array([v for c in labels for v in c], float)
    token = np.array([i for i, fs in enumerate(f for c in seen for f in c) for _ in fs], np.int64)
    feature = np.array([f for c in seen for fs in c for f in fs], np.int64)
    inner = np.ones(len(y), bool)
    inner[start + n - 1] = False
    here = np.flatnonzero(inner)
    p = np.zeros(len(number) + 5)
    p[len(number)] = -4.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    seen_pairs = np.bincount((2 * y[here] + y[here + 1]).astype(int), minlength=4).astype(float)
    for k in range(1, ROUNDS + 1):
        w, bias, trans = p[: len(number)], p[len(number)], p[len(number) + 1 :]
        e = bias + np.bincount(token, w[feature], len(y))
        odds_now, forward, backward = marginals(e, start, n, trans)
        off = sigmoid(odds_now) - y
        f1, b1 = forward[here], e[here + 1] + backward[here + 1]
        joint = np.stack([np.zeros_like(f1) + trans[0], b1 + trans[1], f1 + trans[2], f1 + b1 + trans[3]])
        joint = np.exp(joint - joint.max(axis=0))
        pairs = (joint / joint.sum(axis=0)).sum(axis=1)
        grad = np.concatenate([np.bincount(feature, off[token], len(number)), [off.sum()], pairs - seen_pairs]) / len(n) + RIDGE * p
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model({f: float(p[i]) for f, i in number.items()}, float(p[len(number)]), tuple(p[len(number) + 1 :].tolist()))


def tag(texts: list[str | None], memory: Memory) -> list[tuple[float, list[int]]]:
    """(score, numbers of offending tokens) of each text."""
    idx, docs = [], []
    for x in texts:
        tokens = x.split() if x else []
        idx.append(np.fromiter(map(memory.__getitem__, tokens), np.int64, len(tokens)))
        docs.append(len(tokens))
    idx, docs = np.concatenate(idx), np.array(docs)
    out = [(0.0, [])] * len(texts)
    if not len(idx):
        return out
    start, n = chains(np.array(memory.ends)[idx], docs)
    odds = marginals(np.array(memory.emission)[idx], start, n, memory.model.trans)[0]
    edges = np.concatenate([[0], np.cumsum(docs)])
    for i in np.flatnonzero(docs).tolist():
        own = odds[edges[i] : edges[i + 1]]
        top = np.partition(own, -3)[-3:] if len(own) > 3 else own
        out[i] = float(1 - np.prod(1 - sigmoid(top))), np.flatnonzero(own >= 0).tolist() if top.max() >= 0 else []
    return out


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), spans (start and end of offending tokens, in characters).

    Null and empty texts score 0; repeated rows are scored each; a null doc_id stays null; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # a few thousand weights: bounded by the sample

    def run(arrived):
        memory = Memory(sent.value)
        for b in arrived:
            text = b.column("text").to_pylist()
            scores, spans = [], []
            for first in range(0, len(text), 1000):
                if len(memory) > REMEMBERED:
                    memory = Memory(sent.value)
                part = text[first : first + 1000]
                for x, (score, bad) in zip(part, tag(part, memory), strict=True):
                    at = [m.span() for m in re.finditer(r"\S+", x)] if bad else []
                    scores.append(score)
                    spans.append([{"start": at[k][0], "end": at[k][1]} for k in bad])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")


def trained(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS, most_bytes: int = BYTES) -> Model:
    """A model of ``label`` from a bounded sample of labelled documents for whose doc_id ``learn`` holds."""
    got, _ = sample(docs, labels, label, learn, per_class, most_bytes)
    return fit(got["text"].to_pylist(), got["y"].to_pylist())


def clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``; nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(arrived):
        memory = Memory(sent.value)
        for b in arrived:
            if len(memory) > REMEMBERED:
                memory = Memory(sent.value)
            text = b.column(at).to_pylist()
            keep = [score < limit for first in range(0, len(text), 1000) for score, _ in tag(text[first : first + 1000], memory)]
            yield b.filter(pa.array(keep, pa.bool_()))

    # By place, as names may clash.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
