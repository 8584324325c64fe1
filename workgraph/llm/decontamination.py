"""Benchmark decontamination: a broadcast set of test n-grams, scanned over the windows of every text and verified.

The benchmark's windows are distinct word runs of at most ``n`` words. They travel in broadcasts of at most
``BLOCK_WINDOWS`` windows each: a larger benchmark is split by item into several blocks, each scanned in its own pass, so a
broadcast never grows with the data. Nothing of the documents is shuffled in a pass.

Null and empty texts have no words; an item without words has no window; repeated items and documents count each for
themselves (a repeated item id once per document); null item ids are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.llm.registry import query
from workgraph.llm.tokens import ALNUM, window_hashes, word_pieces

N = 10
#: Windows in one broadcast: about 400 bytes each in a worker, so a block stays near 40 MB.
BLOCK_WINDOWS = 100_000


class Grams:
    """The windows of a block of benchmark items, by width: sorted hashes, the windows themselves, and their items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        by_width: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            width = min(n, len(ids))
            for i in range(len(ids) - width + 1 if width else 0):
                by_width.setdefault(width, {}).setdefault(tuple(ids[i:i + width]), set()).add(item)
        self.grams = by_width
        self.hashes = {w: np.unique(window_hashes(np.array([x for g in grams for x in g], np.int64), w)[::w])
                       for w, grams in by_width.items()}
        self.widest = max(by_width, default=0)

    def scan(self, pieces: Iterator[list[bytes]]) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, the hit word positions (sorted starts and ends of runs), and the items found."""
        get = self.vocabulary.get
        total, found, runs = 0, set(), []
        tail: list[int] = []
        for words in pieces:
            ids = tail + [get(w, 0) for w in words]
            begin = total - len(tail)
            total += len(words)
            arr = np.array(ids, np.int64)
            fresh = len(tail)
            for width, hashes in self.hashes.items():
                if len(arr) < width:
                    continue
                known = np.concatenate(([0], np.cumsum(arr == 0)))
                starts = np.flatnonzero(known[width:] == known[:-width])
                starts = starts[starts + width > fresh]
                if not len(starts):
                    continue
                values = window_hashes(arr, width)[starts]
                place = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
                for s in starts[hashes[place] == values].tolist():
                    hit = self.grams[width].get(tuple(ids[s:s + width]))
                    if hit:
                        found |= hit
                        runs.append((begin + s, begin + s + width))
            tail = ids[-(self.widest - 1):] if self.widest > 1 else []
        merged: list[list[int]] = []
        for s, e in sorted(runs):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        return total, np.array(merged, np.int64).reshape(-1, 2), found


def _blocks(benchmark: DataFrame, n: int, item: str, text: str, limit: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items with their words in blocks of at most ``limit`` windows (a longer item is cut, its windows kept)."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item}`").alias("i"), F.col(f"`{text}`").alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for row in rows.toLocalIterator():
        words = [w for piece in word_pieces(row["t"], ALNUM) for w in piece]
        step = limit
        for at in range(0, max(1, len(words) - n + 1), step):
            part = words[at:at + step + n - 1]
            if not part:
                continue
            if block and size + len(part) > limit:
                yield block
                block, size = [], 0
            block.append((row["i"], part))
            size += len(part)
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, id: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: id, n_words, items (sorted array of item ids found) and runs (hit word ranges, ends exclusive).

    One broadcast and one pass over the documents per block of benchmark items; passes after the first see the earlier
    pass's items and runs beside each text and add to them.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
                        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<string>").alias("items"),
                        F.array().cast("array<array<long>>").alias("runs"))
    blocks = 0

    def one_pass(df: DataFrame, block, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Grams(block, n))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for batch in batches:
                words, items, runs = [], [], []
                for t, had, ran in zip(batch.column("text"), batch.column("items").to_pylist(), batch.column("runs").to_pylist()):
                    total, new, found = grams.scan(word_pieces(t.as_py(), ALNUM))
                    words.append(total)
                    items.append(sorted(set(had) | {str(x) for x in found}))
                    runs.append(_union(ran, new.tolist()))
                texts = pa.array([None] * batch.num_rows, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), texts, pa.array(words, pa.int64()), pa.array(items, pa.list_(pa.string())),
                                                  pa.array(runs, pa.list_(pa.list_(pa.int64())))], batch.schema.names)
        return df.mapInArrow(read, df.schema)

    ahead = None
    for block in _blocks(benchmark, n, item, item_text, block_windows):
        if ahead is not None:
            plain, blocks = one_pass(plain, ahead, False), blocks + 1
        ahead = block
    plain = one_pass(plain, ahead or [], True)
    return plain.select(F.col("id").alias(id), "n_words", "items", "runs")


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    if not a or not b:
        return a or b
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = N, share: float = 0.5, mark: str = "",
                        block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without benchmark passages: hit words are cut out of a text (with the marks between them); a document
    with over ``share`` of its words hit goes as a whole. Columns stay; texts without hits stay as they are.

    Every block is scanned on the uncut text, its runs carried beside the row; the last pass judges and cuts once.
    """
    spark = docs.sparkSession
    at, width = docs.columns.index(text), len(docs.columns)
    names = [f"c{i}" for i in range(width)]
    plain = docs.toDF(*names).withColumn("runs", F.array().cast("array<array<long>>"))

    def one_pass(df: DataFrame, block, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Grams(block, n))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for batch in batches:
                texts, runs, keep = [], [], []
                for t, ran in zip(batch.column(at), batch.column(width).to_pylist()):
                    t = t.as_py()
                    total, new, _ = grams.scan(word_pieces(t, ALNUM))
                    every = _union(ran, new.tolist())
                    hit = sum(e - s for s, e in every)
                    keep.append(not last or hit <= share * total)
                    texts.append(_without(t, every, mark) if last and hit and keep[-1] else t)
                    runs.append([] if last else every)
                columns = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns[:width])]
                columns.append(pa.array(runs, pa.list_(pa.list_(pa.int64()))))
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))
        return df.mapInArrow(read, df.schema)

    ahead = None
    for block in _blocks(benchmark, n, "item_id", "text", block_windows):
        if ahead is not None:
            plain = one_pass(plain, ahead, False)
        ahead = block
    if ahead is not None:
        plain = one_pass(plain, ahead, True)
    return plain.select(*names).toDF(*docs.columns)


def _without(text: str, runs: list[list[int]], mark: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    is_word = np.frombuffer(data.translate(ALNUM), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], is_word.astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in runs:
        out.append(data[at:begins[s]] + mark.encode())
        at = ends[e - 1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found, a digest of the items, and whether anything was hit."""
    found = scan(docs, benchmark)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


SQL = r"""
    WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    grams AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
              FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
    widths AS (SELECT DISTINCT n FROM grams),
    windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, widths)),
    hits AS (SELECT doc_id, i, w.n, item_id FROM windows w JOIN grams USING (n, g)),
    covered AS (SELECT doc_id, count(DISTINCT k) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS m, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_hit, coalesce(m, 0)::BIGINT AS n_items,
           sha256(coalesce(l, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
    FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op2_decontamination", SQL)
def op2(spark, read):
    return report(read("documents").select("doc_id", "text"), read("benchmark"))
