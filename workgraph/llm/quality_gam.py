"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree per feature in turn, so that the model is a lookup table per feature and per chosen
pair; a score is a sum of table entries. Features come from the whole text and nothing else. The tables are fitted on a
bounded sample of labelled rows and are a few thousand numbers; scoring is one pass over the texts without a shuffle.

Null texts count as empty; empty texts have features too and get a score. Without labelled rows every score is 0.5; with
one label only, all scores are that label's smoothed share. Repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.llm.labelled import MAX_ROWS, held_out, training_rows
from workgraph.llm.quality_rules import STOP_WORDS
from workgraph.llm.registry import query

FEATURES = ["log_words", "word_length", "symbols", "exclamations", "bars", "digits", "capitals", "commas", "stop_words",
            "distinct_words", "distinct_pairs", "distinct_lines", "line_words", "non_ascii"]
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 250
RATE = 0.08
LEAVES = 3
RIDGE = 2.0
_STOPS = {x.encode() for w in STOP_WORDS for x in (w, w.capitalize())}
_DIGITS, _CAPITALS, _HIGH = b"0123456789", bytes(range(65, 91)), bytes(range(128, 256))


def features(text: str | None) -> list[float]:
    """One number per entry of ``FEATURES``; ratios are 0 where there is nothing to divide by."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    pairs = max(1, len(words) - 1)
    return [np.log1p(len(words)), sum(map(len, words)) / n, sum(map(data.count, b"#*$%&<>")) / n, data.count(b"!") / n, data.count(b"|") / n,
            (size - len(data.translate(None, _DIGITS))) / size if data else 0.0, (size - len(data.translate(None, _CAPITALS))) / size if data else 0.0,
            data.count(b",") / n, sum(map(_STOPS.__contains__, words)) / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / pairs,
            len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), (size - len(data.translate(None, _HIGH))) / size if data else 0.0]


class Gam:
    """Bin edges per feature, a table per feature, and a table per chosen pair of features."""

    def __init__(self, edges, tables, pair_edges, pairs, pair_tables, base: float):
        self.edges, self.tables, self.pair_edges, self.pairs, self.pair_tables, self.base = edges, tables, pair_edges, pairs, pair_tables, base

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, f], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def _leaf(g: float, h: float) -> float:
    return g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The values of a tree with up to ``leaves`` leaves over one binned feature; g, h: sums of gradient and curvature per bin."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cuts = np.arange(a + 1, b)
            left, right = (cg[cuts] - cg[a], ch[cuts] - ch[a]), (cg[b] - cg[cuts], ch[b] - ch[cuts])
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
            c = int(np.argmax(gain))
            if best is None or gain[c] > best[0]:
                best = (gain[c], k, int(cuts[c]))
        if best is None or best[0] <= 1e-9:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of either axis (a leaf per quadrant): its gain and its values on the grid."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            quads = [(cg[a, b], ch[a, b])]
            quads.append((cg[a, -1] - cg[a, b], ch[a, -1] - ch[a, b]))
            quads.append((cg[-1, b] - cg[a, b], ch[-1, b] - ch[a, b]))
            quads.append((cg[-1, -1] - cg[a, -1] - quads[2][0], ch[-1, -1] - ch[a, -1] - quads[2][1]))
            gain = sum(x * x / (y + RIDGE) for x, y in quads) - whole
            if gain > best:
                best = gain
                values = np.empty_like(g)
                for q, (rows, cols) in enumerate([(slice(0, a + 1), slice(0, b + 1)), (slice(0, a + 1), slice(b + 1, None)),
                                                  (slice(a + 1, None), slice(0, b + 1)), (slice(a + 1, None), slice(b + 1, None))]):
                    values[rows, cols] = _leaf(*quads[q])
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    """Boost the feature tables cyclically, pick the pairs whose cuts explain most of what is left, and boost their tables."""
    n = len(y)
    share = (float(y.sum()) + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    edges, pair_edges = ([], []) if n == 0 else (_edges(x, BINS), _edges(x, PAIR_BINS))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return Gam(edges, tables, pair_edges, [], [], base)
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    z = np.full(n, base)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), LEAVES)
            table += step
            z += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    sizes = [len(e) + 1 for e in pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in chosen]
    for _ in range(rounds // 5):
        for (i, j), table in zip(chosen, pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return Gam(edges, tables, pair_edges, chosen, pair_tables, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = MAX_ROWS) -> Gam:
    """Fit on the features of a bounded sample; what reaches the driver is ``rows`` feature vectors at most."""
    schema = "x array<double>, y int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64())),
                                              batch.column("label").cast(pa.int32())], ["x", "y"])

    sample = training_rows(docs, labels, label, rows).mapInArrow(read, schema).toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(sample.column("y").to_pylist(), float)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    plain = docs.select(F.col(f"`{id}`").alias("doc_id"), held_out(F.col(f"`{id}`")).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()),
                                              pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(read, f"doc_id {kind}, held_out boolean, score double, predicted int")


@query("op8_quality_gam")
def op8(spark, read):
    docs = read("documents").select("doc_id", "text")
    return score(docs, train(docs, read("labels")))
