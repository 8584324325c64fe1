"""Audit of how the sources of a language differ in their words.

A translate table turns a text's bytes into lower-case words in one pass (letters and non-ASCII bytes stay, all else is blank),
``bytes.split`` cuts them, and a counter per document gives its term frequencies. A task adds the counters up by
(language, source) and hands on sparse rows, which Spark sums.

Terms in at least ``least`` documents of a language are kept. A group is a (language, source) that occurs; a term has in it
the smoothed share ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``. Part ``pair`` gives, for each other source of the language,
the sum of the absolute differences over all kept terms; part ``term`` the ``shown`` terms whose share exceeds the language's most.

Differences of sources are summed in blocks: the counts of a language are dealt by term into blocks of bounded size and its
sources into tiles of bounded number, and one task holds one block of two tiles, a few columns at a time, and returns one sum
per pair of sources. So neither the vocabulary nor the number of sources has to fit a task.

Null text, language or source is ''. Empty texts count for their group, which then has no terms (and, where the language keeps
terms, their smoothed shares). Without kept terms all differences are 0. A repeated row is a document of its own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.llm.columns import whole
from workgraph.llm.registry import query
from workgraph.llm.tokens import word_pieces
from workgraph.session import cut, scratch

#: A kept term is in at least so many documents of its language; so many terms are shown per group.
LEAST, SHOWN = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Letters in lower case, non-ASCII bytes as they are, the rest blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms a task adds up before it hands them on.
HELD = 300_000
#: Counts of a block and sources of a tile on average, and cells of the matrix a task holds at a time.
BLOCK, TILE, CELLS = 200_000, 256, 2_000_000


def term_counts(text: str | None) -> Counter[bytes]:
    """Terms of the whole text with their numbers, read piece by piece."""
    found: Counter[bytes] = Counter()
    for words in word_pieces(text, LETTERS):
        found.update(words)
    return found


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs) of all groups; the term '' counts the documents of a group."""
    plain = docs.select(*[whole(F.col(f"`{c}`")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        holders: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (l, s), seen in holders.items():
                terms = list(seen)
                for at in range(0, len(terms), 20_000):
                    some = terms[at:at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(some)), pa.array([s] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                                                      pa.array([counts[l, s][t] for t in some], pa.int64()), pa.array([seen[t] for t in some], pa.int64())],
                                                     ["lang", "source", "term", "count", "docs"])
            counts.clear()
            holders.clear()

        for batch in batches:
            for t, l, s in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                terms = term_counts(t.as_py())
                counts[l, s].update(terms)
                holders[l, s].update(terms.keys())
                holders[l, s][b""] += 1
            if sum(map(len, holders.values())) > HELD:
                yield from flush()
        yield from flush()

    rows = plain.mapInArrow(read, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH kept))`` in exact decimals."""
    wide = (count + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + F.lit(SMOOTH) * kept).cast("decimal(20,0)")) + F.lit(1)


def block_differences(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences of shares over the terms of one block, for sources of two tiles: (lang, a, b, value), a < b.

    Rows without a term name the sources, with the total and the number of kept terms of each.
    """
    lang, low, high = frame["lang"].iat[0], frame["low"].iat[0], frame["high"].iat[0]
    groups = frame[frame["term"].isna()].sort_values("source")
    cells = frame[frame["term"].notna()]
    names = groups["source"].to_numpy(object)
    total = (groups["total"] + SMOOTH * groups["kept"]).to_numpy(np.int64)
    tiles = groups["tile"].to_numpy()
    term, terms = pd.factorize(cells["term"])
    row = pd.Index(names).get_indexer(cells["source"])
    count = cells["count"].to_numpy(np.int64)
    order = np.argsort(term, kind="stable")
    term, row, count = term[order], row[order], count[order]
    left, right = np.flatnonzero(tiles == low), np.flatnonzero(tiles == high)
    sums = np.zeros((len(left), len(right)), np.int64)
    width = max(1, CELLS // max(1, len(names)))
    for at in range(0, len(terms), width):
        here = slice(*np.searchsorted(term, (at, at + width)))
        matrix = np.zeros((len(names), min(width, len(terms) - at)), np.int64)
        matrix[row[here], term[here] - at] = count[here]
        matrix = exact_shares(matrix, total)
        for i, x in enumerate(left):
            sums[i] += np.abs(matrix[right] - matrix[x]).sum(axis=1)
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    value = sums.ravel()
    pick = (a < b) if low == high else np.ones(len(a), bool)
    a, b, value = a[pick], b[pick], value[pick]
    return pd.DataFrame({"lang": lang, "a": names[a], "b": names[b], "value": value})


def exact_shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """:func:`share` of a matrix of counts, row totals given; beyond 64 bits by Python's integers."""
    if counts.size and int(counts.max()) + SMOOTH < (1 << 63) // SCALE:
        return (counts + SMOOTH) * SCALE // totals[:, None] + 1
    return ((counts.astype(object) + SMOOTH) * SCALE // totals.astype(object)[:, None] + 1).astype(np.int64)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """(lang, source, part, item, value, rank): differing sources and telling terms of every group."""
    with scratch() as held:
        return held.keep(cut(_audit(docs, text, lang, source, least, shown)))


def _audit(docs: DataFrame, text: str, lang: str, source: str, least: int, shown: int) -> DataFrame:
    counts = cut(counted(docs, text, lang, source))
    kept = cut(counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("lang_total"))
    cells = cut(counts.filter("term != ''").drop("docs").join(kept.hint("merge"), ["lang", "term"]))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "lang_total", "total"])
    # Blocks of about BLOCK counts and tiles of about TILE sources, whatever a language has of either.
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")) \
        .join(cells.groupBy("lang").agg(F.count(F.lit(1)).alias("cells")), "lang", "left").fillna(0, ["cells"]) \
        .select("lang", F.greatest(F.lit(1), F.ceil(F.col("sources") / TILE)).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("cells") / BLOCK)).cast("int").alias("blocks"))
    groups = cut(groups.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    known = groups.select("lang", "source", "tile", "tiles", "blocks", "total", "kept")
    named = known.withColumn("other", other).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("lang", "source", "tile", "other", "block", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("count"), "total", "kept")
    dealt = cells.join(known.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"]).withColumn("other", other) \
        .select("lang", "source", "tile", "other", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "count",
                F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("kept"))
    blocks = named.unionByName(dealt).select("lang", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "block", "tile", "source", "term",
                                             "count", "total", "kept")
    sums = blocks.groupBy("lang", "low", "high", "block").applyInPandas(block_differences, "lang string, a string, b string, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_p"), "value") \
        .select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")
    excess = share(F.col("count"), F.col("total"), F.col("kept")) - share(F.col("all"), F.col("lang_total"), F.col("kept"))
    terms = cells.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"]) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess.alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)) \
        .unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
     ln AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     cell AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
     tot AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN cell USING (lang, source) GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(cell.c, 0) AS c, 1 + {SCALE}::HUGEINT * (coalesce(cell.c, 0) + {SMOOTH}) // (tot.n + {SMOOTH} * ln.v) AS p,
                  1 + {SCALE}::HUGEINT * (k.c + {SMOOTH}) // (ln.n + {SMOOTH} * ln.v) AS q
           FROM g JOIN tot USING (lang, source) JOIN kept k USING (lang) JOIN ln USING (lang) LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = k.term),
     s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
     f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
     r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {SHOWN}"""


@query("op11_source_divergence", SQL)
def op11(spark, read):
    return audit(read("documents").select("text", "lang", "source"))
