"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactuals.

In every sentence of the labelled rows that names identities, one term at a time is swapped for each other one of its list;
the squared change of the log-odds is part of the loss. So the mention of a group as such cannot make a text toxic, which is
what neutral mentions need. A sentence that names several groups has a swap for each of them; the swaps of a row weigh 1 in
all, so that one long text does not decide what the model learns of a group.
The words of the model are chosen by counts over a bounded sample of labelled rows, and so are the weights; what reaches
the driver is bounded by ``MAX_ROWS`` and ``MAX_FEATURES``. Scoring is one pass over the whole texts without a shuffle.

Null texts count as empty and get the score of the intercept; without labelled rows every score is 0.5. Repeated rows are
scored each for itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.llm.labelled import MAX_ROWS, held_out, training_rows
from workgraph.llm.registry import query
from workgraph.llm.tokens import ALNUM, word_pieces

#: Identity terms by list; a term is swapped for every other of its list.
IDENTITIES = [["women", "men"], ["woman", "man"], ["girls", "boys"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
              ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["black", "white", "asian", "latino", "african", "european"],
              ["gay", "straight", "lesbian", "bisexual", "transgender"], ["immigrants", "natives", "refugees"], ["disabled", "deaf", "blind", "autistic"],
              ["frauen", "männer"], ["muslime", "christen", "juden"], ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
              ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"]]
OTHERS = {a.encode(): [b.encode() for b in terms if b != a] for terms in IDENTITIES for a in terms}
SENTENCE_END = re.compile(r"[.!?;\n]+")
#: Lengths in bytes of the word beginnings that count as features beside the word.
PREFIXES = (4, 5, 6)
MAX_FEATURES = 3_000
#: Fewest sample texts with a feature, and the least distance (in standard errors) of its log-odds from none.
MIN_TEXTS, MIN_Z = 5, 4.0
RIDGE, COUNTERFACTUAL, STEPS = 1e-4, 1.0, 400
#: Counts a task holds before it hands them on.
HELD = 200_000


def vocabulary(text: str | None) -> set[bytes]:
    """The distinct words of a text, A-Z in lower case."""
    found: set[bytes] = set()
    for words in word_pieces(text, ALNUM):
        found.update(words)
    return found


def feature_names(words: set[bytes]) -> set[bytes]:
    """``w:`` and each word, ``p:`` and its beginnings."""
    out = {b"w:" + w for w in words}
    for k in PREFIXES:
        out.update(b"p:" + w[:k] for w in words if len(w) >= k)
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """Per feature: texts with it, by label. Counted up in the tasks first."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()),
                                                pa.array([v[1] for v in held.values()], pa.int64())], ["feature", "clean", "toxic"])
            held.clear()
            return batch

        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("label").to_pylist()):
                for name in feature_names(vocabulary(t.as_py())):
                    held.setdefault(name, [0, 0])[y] += 1
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return sample.mapInArrow(read, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


class Model:
    """Weights per feature and an intercept."""

    def __init__(self, weights: dict[bytes, float], intercept: float):
        self.words = {k[2:]: v for k, v in weights.items() if k[:1] == b"w" and v}
        self.starts = {k[2:]: v for k, v in weights.items() if k[:1] == b"p" and v}
        self.lengths = sorted({len(k) for k in self.starts})
        self.intercept = intercept

    def logit(self, words: set[bytes]) -> float:
        """The intercept and the weight of every feature that the words have, each once."""
        total = self.intercept + sum(self.words[w] for w in self.words.keys() & words)
        for k in self.lengths:
            total += sum(self.starts[p] for p in self.starts.keys() & {w[:k] for w in words if len(w) >= k})
        return total

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(vocabulary(text)), -40, 40))))


def swaps(text: str | None) -> dict[tuple[frozenset[bytes], frozenset[bytes]], float]:
    """Features that go and features that come by each swap of one term in one sentence, with weights of 1 in all; empty without a term."""
    found: Counter = Counter()
    if not OTHERS.keys().isdisjoint(vocabulary(text)):
        for sentence in SENTENCE_END.split(text):
            words = vocabulary(sentence)
            for term in OTHERS.keys() & words:
                rest = words - {term}
                left = feature_names(rest)
                for other in OTHERS[term]:
                    gone, come = feature_names({term}) - left, feature_names({other}) - left
                    found[frozenset(gone - come), frozenset(come - gone)] += 1
    total = sum(found.values())
    return {pair: n / total for pair, n in found.items()}


def fit(names: list[bytes], rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], weights: np.ndarray,
        strength: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise log loss + ridge + strength * weighted mean squared change of the logit over ``pairs``."""
    k, n = len(names), len(y)

    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(r) for r in lists]).astype(np.int64), np.array([c for r in lists for c in r], np.int64)

    at, col = sparse(rows)
    a_at, a_col = sparse([p[0] for p in pairs])
    b_at, b_col = sparse([p[1] for p in pairs])
    share = (float(y.sum()) + 0.5) / (n + 1.0)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return w, b
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(at, w[col], n)
        r = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.bincount(col, r[at], k) / n + RIDGE * w
        if pairs:
            change = np.bincount(a_at, w[a_col], len(pairs)) - np.bincount(b_at, w[b_col], len(pairs))
            change *= weights / weights.sum()
            grad += 2 * strength * (np.bincount(a_col, change[a_at], k) - np.bincount(b_col, change[b_at], k))
        g = np.append(grad, r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:k], b - float(move[k])
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
          strength: float = COUNTERFACTUAL) -> Model:
    """Choose features by their counts, then fit; identity terms and their beginnings are always features."""
    sample = training_rows(docs, labels, label, rows)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("_toxic") - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (F.col("_clean") - F.col("clean") + 0.5))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    totals = sample.agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).head()
    toxic, n = totals["t"] or 0, totals["n"]
    if not 0 < toxic < n:
        return Model({}, 0.0 if not n else float(np.log((toxic + 0.5) / (n - toxic + 0.5))))
    counted = _counted(sample).filter(F.col("clean") + F.col("toxic") >= MIN_TEXTS).withColumns({"_toxic": F.lit(toxic), "_clean": F.lit(n - toxic)})
    ranked = counted.withColumn("z", F.abs(odds / error)).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(max_features)
    names = sorted({bytes(r["feature"]) for r in ranked.select("feature").collect()} | feature_names(set(OTHERS)))
    place = {name: i for i, name in enumerate(names)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, turned = [], []
            for t in batch.column("text"):
                own.append(sorted(place[f] for f in place.keys() & feature_names(vocabulary(t.as_py()))))
                turned.append([{"gone": sorted(place[f] for f in place.keys() & gone), "come": sorted(place[f] for f in place.keys() & come), "weight": n}
                               for (gone, come), n in swaps(t.as_py()).items()])
            kind = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("weight", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(turned, kind), batch.column("label").cast(pa.int32())],
                                             ["own", "turned", "y"])

    # Per row at most the features of the model and a few swaps for each pair of terms of a list.
    table = sample.mapInArrow(read, "own array<int>, turned array<struct<gone:array<int>,come:array<int>,weight:double>>, y int").toArrow()
    got = sorted(zip(table.column("own").to_pylist(), table.column("y").to_pylist()))
    weight: dict[tuple, list[float]] = {}
    for row in table.column("turned").to_pylist():
        for swap in row:
            weight.setdefault((tuple(swap["gone"]), tuple(swap["come"])), []).append(swap["weight"])
    pairs = sorted(weight)
    w, b = fit(names, [r[0] for r in got], np.array([r[1] for r in got], float), [(list(gone), list(come)) for gone, come in pairs],
               np.array([math.fsum(weight[p]) for p in pairs]), strength)
    return Model(dict(zip(names, w.tolist())), b)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    plain = docs.select(F.col(f"`{id}`").alias("doc_id"), held_out(F.col(f"`{id}`")).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()),
                                              pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(read, f"doc_id {kind}, held_out boolean, score double, predicted int")


@query("op4_toxicity")
def op4(spark, read):
    docs = read("documents").select("doc_id", "text")
    return score(docs, train(docs, read("labels")))
