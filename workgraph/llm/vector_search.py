"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which is split into balanced parts with few edges between them. A
small classifier learns from the graph how probable each part is for a vector. Every row of the table is indexed in its most
probable part; a query is routed to several most probable parts and ranks what lies there by its exact cosine. How many
parts it visits is the least number that finds ``RECALL`` of the neighbours of held-out sample vectors.

The sample is the ``SAMPLE`` rows with the smallest hashes of their ids, so its size is the only bound; the number of parts
follows the table up to ``PARTS``. A table of fewer than ``EXACT`` vectors has one part, which makes the search exact. A query
that finds fewer neighbours than asked for in its parts visits all of them.

Part by part, rows are packed into blocks of bounded size (a part of any size has as many blocks as it needs), queries too, and
a task compares one block of queries with one block of rows. Of equal vectors only the ``k + 1`` smallest ids can be among
``k`` neighbours other than the query itself, so a vector that very many rows share enters the blocks with these, and equal query
vectors are searched once.

Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows with a null id and vectors of
another length than the commonest one (of equally common ones the longest). Of rows with one id the smallest vector counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workgraph.llm.registry import query
from workgraph.session import cut, scratch

NEAREST = 5
#: Query rows: those whose id this divides.
EVERY = 50
#: Rows the model is fitted on at most, neighbours per row in its graph, and most parts.
SAMPLE, NEIGHBOURS, PARTS = 8192, 10, 256
#: Smaller tables have one part; larger ones a part for so many rows.
EXACT, ROWS_A_PART = 2048, 1024
#: Share of true neighbours that routing must find among held-out sample vectors.
RECALL = 0.95
#: Rows of a block on average.
BLOCK = 2048
#: Scores by matrix product may differ so much from the exact ones.
SLACK = 1e-9


class Model(NamedTuple):
    """``weights`` (length of a vector + 1, parts) of the classifier, and how many parts a query visits."""

    weights: np.ndarray
    visits: int


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other rows of every unit row, block by block."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        near = x[at:at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at:at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for every node of the graph: nearly equal sizes, few edges between parts.

    Nodes begin at the nearest of some spread-out rows and move to where most of their neighbours are, the surest first, as
    long as there is room.
    """
    n, room = len(x), -(-len(x) * 21 // (parts * 20))
    centres = [0]
    far = x @ x[0]
    for _ in range(parts - 1):
        centres.append(int(far.argmin()))
        far = np.maximum(far, x @ x[centres[-1]])
    centre, label = x[centres], None
    both = np.concatenate((np.stack((np.repeat(np.arange(n), graph.shape[1]), graph.ravel())), np.stack((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))), axis=1)
    for _ in range(rounds):
        pull = x @ centre.T
        if label is not None:
            np.add.at(pull, (both[0], label[both[1]]), 1.0)
        top = np.partition(pull, -2, axis=1)
        left, label = np.full(parts, room), np.empty(n, np.int64)
        for i in np.argsort(top[:, -2] - top[:, -1], kind="stable").tolist():
            best = int(pull[i].argmax())
            if not left[best]:
                best = int(np.where(left > 0, pull[i], -np.inf).argmax())
            label[i] = best
            left[best] -= 1
        sums = np.zeros_like(centre)
        np.add.at(sums, label, x)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return label


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of every part, for unit rows."""
    z = x @ weights[:-1] + weights[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, steps: int = 200) -> np.ndarray:
    """A softmax classifier of the parts in which a row and its neighbours lie, by Adam over all rows."""
    want = np.zeros((len(x), parts))
    np.add.at(want, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    want[np.arange(len(x)), label] += 1.0
    want /= want.sum(axis=1, keepdims=True)
    wide = np.hstack((x, np.ones((len(x), 1))))
    weights, m, v = (np.zeros((wide.shape[1], parts)) for _ in range(3))
    for t in range(1, steps + 1):
        grad = wide.T @ (probabilities(x, weights) - want) / len(x) + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights -= 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return weights


def fit(vectors: np.ndarray, parts: int, recall: float = RECALL, nearest: int = NEAREST) -> Model:
    """Graph, parts and classifier of the sample; every eighth row is held out to choose the number of visits."""
    x = unit(vectors.astype(np.float64))
    held = np.arange(len(x)) % 8 == 7
    if parts < 2 or held.sum() < 32:
        return Model(np.zeros((x.shape[1] + 1, 1)), 1)
    known, asked = x[~held], x[held]
    graph = neighbour_graph(known, NEIGHBOURS)
    label = balanced_parts(known, graph, parts)
    weights = train(known, graph, label, parts)
    home = probabilities(known, weights).argmax(axis=1)
    near = np.argpartition(-(asked @ known.T), nearest - 1, axis=1)[:, :nearest]
    place = np.argsort(np.argsort(-probabilities(asked, weights), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel()) + 1
    return Model(weights, int(needed[int(np.ceil(recall * len(needed))) - 1]))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def best_of_block(asked: np.ndarray, ids: np.ndarray, rows: np.ndarray, keep: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query row its place, the ids of its ``keep`` best rows, and their cosines; ties go to smaller ids.

    The matrix product only picks candidates; scores are summed component by component, so equal vectors score the same.
    """
    norms, own = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
    rough = unit(asked) @ unit(rows).T
    kth = np.partition(rough, -keep, axis=1)[:, -keep] if rough.shape[1] > keep else np.full(len(asked), -np.inf)
    for i in range(len(asked)):
        near = np.flatnonzero(rough[i] >= kth[i] - SLACK)
        score = (rows[near] * asked[i]).sum(axis=1) / (norms[near] * own[i])
        order = np.lexsort((ids[near], -score))[:keep]
        yield i, ids[near][order], score[order]


def usable(table: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, one row per id."""
    rows = table.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).filter(
        "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> coalesce(NOT isnan(x) AND abs(x) < double('infinity'), false)) AND exists(vector, x -> x != 0)")
    rows = cut(rows.groupBy("id").agg(F.min("vector").alias("vector")))
    sizes = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.filter(F.size("vector") == (sizes[0]["length"] if sizes else 0))


def routed(rows: DataFrame, model: Model, visits: int) -> DataFrame:
    """``rows`` once for each of their ``visits`` most probable parts, which is added as ``part``."""
    if model.weights.shape[1] == 1:
        return rows.withColumn("part", F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                chance = probabilities(unit(_matrix(batch.column("vector"))), model.weights)
                order = np.argsort(-chance, axis=1, kind="stable")[:, :visits].astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, parts], ["id", "vector", "parts"])

    return rows.mapInArrow(read, "id long, vector array<double>, parts array<int>").select("id", "vector", F.explode("parts").alias("part"))


def _packed(rows: DataFrame, per_part: DataFrame, ids: str, vectors: str) -> DataFrame:
    """Blocks (part, block, ids, vectors) of about BLOCK rows; ``per_part`` (part, blocks) has one row for each of at most PARTS parts."""
    dealt = rows.join(F.broadcast(per_part), "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("part", "block").agg(F.collect_list(F.struct("id", "vector")).alias("_rows"))
    return packed.select("part", "block", F.col("_rows.id").alias(ids), F.col("_rows.vector").alias(vectors))


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part").count().select("part", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))


def compared(asked: DataFrame, index: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best index rows of every query row: (query_id, vec_id, score). Both are (id, vector, part)."""
    per_part = _blocks(index)
    rows = _packed(index, per_part, "ids", "vectors")
    # Every block of queries meets every block of rows of its part, each meeting in the task of the block of rows.
    many = per_part.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    queries = _packed(asked, _blocks(asked), "qids", "qvectors").drop("block").join(F.broadcast(many), "part")
    both = queries.join(rows.hint("merge"), ["part", "block"]).select("qids", "qvectors", "ids", "vectors")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                qids, qvectors, ids, vectors = (c[at].values for c in batch.columns)
                qids, ids = qids.to_numpy(), ids.to_numpy()
                found = list(best_of_block(_matrix(qvectors), ids, _matrix(vectors), keep))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(n), qids[i]) for i, n, _ in found])), pa.array(np.concatenate([n for _, n, _ in found])),
                                                  pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    return _top(both.mapInArrow(read, "query_id long, vec_id long, score double"), keep).drop("rank")


def _top(rows: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def nearest(table: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEAREST, parts: int | None = None,
            recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows of every query row by cosine: (query_id, rank, vec_id, score), ties to the smaller id.

    ``parts`` overrides how many parts the index has.
    """
    with scratch() as held:
        return held.keep(cut(_nearest(table, id, vector, every, k, parts, recall)))


def _nearest(table: DataFrame, id: str, vector: str, every: int, k: int, parts: int | None, recall: float) -> DataFrame:
    rows = usable(table, id, vector)
    copies = Window.partitionBy("vector").orderBy("id")
    index = cut(rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).drop("_copy"))
    total = index.count()
    if parts is None:
        parts = 1 if total < EXACT else min(PARTS, total // ROWS_A_PART)
    sample = index.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("vector").combine_chunks() if parts > 1 else None
    model = fit(_matrix(sample), parts, recall, k) if sample is not None and len(sample) else Model(np.zeros((1, 1)), 1)
    index = cut(routed(index, model, 1))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    classes = cut(asked.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"))
    found = cut(compared(routed(classes, model, model.visits), index, k + 1))
    if model.weights.shape[1] > 1:
        few = classes.join(found.groupBy("query_id").count().filter(F.col("count") > min(k, total - 1)).select(F.col("query_id").alias("id")), "id", "left_anti")
        few = cut(few.select("id", "vector"))
        if not few.isEmpty():
            again = compared(routed(few, model, model.weights.shape[1]), index, k + 1)
            found = found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    named = asked.join(classes.select("vector", F.col("id").alias("_class")), "vector").select(F.col("id").alias("query_id"), "_class")
    hits = named.join(found.withColumnRenamed("query_id", "_class"), "_class").filter("query_id != vec_id")
    return _top(hits.select("query_id", "vec_id", "score"), k).select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= {NEAREST}"""


@query("op13_learned_partitions", SQL)
def op13(spark, read):
    return nearest(read("embeddings"))
