"""N-gram Jaccard join by universe partition.

A document is the set of its distinct word shingles. Sets of equal content form one class. Sizes fall into bands so that
linked sets lie in the same band or in neighbouring ones; each band has a scheme that deals the universe of shingles into
segments. Two linked sets differ in at most D shingles, so with ``a`` exact segments and ``b`` segments that also index their
one-deletion neighbours, and a + 2b > D, they share a key: otherwise every exact segment would hold a difference and every
other one two. The cheapest split into a and b is chosen per band by the keys it writes and the false candidates it is
expected to let through. Empty segments do not count and are never keys (see :func:`keys`).

Candidates are settled in two steps, and no bucket is expanded into all its pairs. First every class of a bucket is
compared with the smallest id of the bucket only, and what links is one component. Then only pairs across components
that still share a bucket are left; a parity sketch of the sets (a lower bound of their difference, so nothing linked is
lost) rejects nearly all of them inside the join. The survivors are verified on their texts, shingle by shingle.

Null and empty texts and texts without words have no shingles and link with nothing. Rows with the same text class share
their component; where an id has several texts, each row has the component of its text and the id joins them. A null id
takes part through its class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workgraph.llm.registry import query
from workgraph.llm.tokens import LOWER, mixed, window_hashes, word_hashes
from workgraph.operators.closure import connected_components
from workgraph.session import cut, release, scratch

WIDTH = 3
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 90
#: Sets a typical set meets that resemble it at SIMILAR without linking: what the cost of a false candidate is weighed by.
NEIGHBOURS, SIMILAR = 30, 0.6
SKETCH = 16
#: The index is dealt a part of the key space at a time, so that its shuffle files never lie on disk together.
PARTS = 4
#: Sets a task remembers to combine copies of.
SEEN = 200_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, no words are none."""
    words = word_hashes(text)
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def exact_shingles(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return set(zip(*[words[i:] for i in range(min(width, len(words)))])) if words else set()


def linked(a: set, b: set, threshold: int = THRESHOLD) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= threshold * (len(a) + len(b) - both)


@lru_cache(maxsize=4)
def bands(threshold: int) -> list[int]:
    """First sizes of the bands: a set can only link within its band and the neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // threshold + 1)
    return out


def _fewer(mean: float, n: int) -> float:
    """Probability that a segment of ``mean`` shingles on average holds fewer than ``n``."""
    return sum(math.exp(-mean) * mean ** i / math.factorial(i) for i in range(n))


@lru_cache(maxsize=4096)
def scheme(band: int, threshold: int) -> tuple[int, int, int]:
    """(differences, exact segments, one-deletion segments) for pairs whose larger set lies in ``band``; no segments: only equal sets link.

    There are as many segments more than the differences ask for as are likely to hold too few shingles to be a key.
    """
    smallest, largest = bands(threshold)[max(0, band - 1)], bands(threshold)[band + 1] - 1
    apart = 2 * largest * (100 - threshold) // (100 + threshold)
    if not apart:
        return 0, 0, 0
    differences = 2 * largest * (1 - SIMILAR) / (1 + SIMILAR)
    best = None
    for two in range((apart + 2) // 2 + 1) if apart < 64 else [0]:
        one = max(0, apart + 1 - 2 * two)
        for _ in range(60):
            mean = smallest / (one + 2 * two)
            short, short_two = _fewer(mean, 1), _fewer(2 * mean, 2)
            missing = apart + 1 + math.sqrt(one * short + 4 * two * short_two) - one * (1 - short) - 2 * two * (1 - short_two)
            if missing <= 0:
                share = differences / (one + 2 * two)
                false = one * math.exp(-share) + two * math.exp(-2 * share) * (1 + 2 * share)
                cost = one + two + largest * 2 * two / (one + 2 * two) + NEIGHBOURS * false
                best = min(best, (cost, one, two)) if best else (cost, one, two)
                break
            one += max(1, int(missing / 2))
    return (apart, *best[1:]) if best else (apart, apart + 1, 0)


def _segment_keys(tokens: np.ndarray, weight: np.ndarray, one: int, two: int, deal: int, seed: int) -> tuple[list[np.ndarray], int]:
    """Keys of the segments that hold shingles, and how many differences they withstand together."""
    slots = np.uint64(one + 2 * two)
    slot = ((mixed(tokens ^ np.uint64(deal)) >> np.uint64(32)) % slots).astype(np.int64)
    segment = np.where(slot < 2 * two, slot // 2, slot - two)
    size = np.bincount(segment, minlength=one + two)
    held = np.flatnonzero(size)
    order = np.argsort(segment, kind="stable")
    total = np.zeros(one + two, np.uint64)
    total[held] = np.add.reduceat(weight[order], (np.cumsum(size) - size)[held])
    name = mixed(np.arange(one + two, dtype=np.uint64) + np.uint64(seed))
    fuzzy = (segment < two) & (size[segment] > 1)
    where = segment[fuzzy]
    return [mixed(total + name)[held], mixed(total[where] - weight[fuzzy] + name[where])], \
        int(np.count_nonzero(size[two:])) + 2 * int(np.count_nonzero(size[:two] > 1))


def keys(tokens: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The index keys of a set under the schemes of its band and the next.

    A segment without shingles is no key: any two sets may have it empty. Instead a set whose segments withstand no more
    differences than a scheme allows is dealt anew, after two further deals over twice as many exact segments each time, until
    its segments suffice. Of a linked pair both sets take every deal up to the first that suffices for either one, and there
    they share a key: not all of that one's segments can hold a difference.
    """
    if not len(tokens):
        return np.empty(0, np.uint64)
    band = int(np.searchsorted(np.array(bands(threshold)), len(tokens), side="right")) - 1
    weight, out = mixed(tokens), []
    for k in (band, band + 1):
        apart, one, two = scheme(k, threshold)
        deal, withstood = 0, 0
        while apart and withstood <= apart:
            made, withstood = _segment_keys(tokens, weight, one, two, k + 1 + (deal << 32), (k << 24) + (deal << 48))
            out += made
            deal += 1
            if deal >= 3:
                one, two = 2 * (one + 2 * two), 0
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of 64 * SKETCH counters: two sets differ in at least as many shingles as their sketches in bits."""
    bits = np.bincount((mixed(tokens + np.uint64(7)) >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _digest(tokens: np.ndarray) -> bytes | None:
    """128 bits that name the set, None for the empty one."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def profiles(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, n_shingles, digest of the set, index keys and sketch; one pass over the texts.

    Copies are combined in the tasks: of equal sets that a task has seen (it remembers up to ``SEEN``) one row has the keys.
    """
    plain = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        nothing = np.empty(0, np.int64)
        for batch in batches:
            sizes, digests, held, sketches = [], [], [], []
            for t, known in zip(batch.column("text"), batch.column("doc_id").is_valid().to_pylist()):
                tokens = shingles(t.as_py(), width)
                digest = _digest(tokens)
                sizes.append(len(tokens))
                digests.append(digest)
                first = known and digest not in seen
                held.append(keys(tokens, threshold).view(np.int64) if first else nothing)
                if first and len(seen) < SEEN:
                    seen.add(digest)
                sketches.append(sketch(tokens))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(held, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                                             ["doc_id", "n_shingles", "digest", "keys", "sketch"])

    return plain.mapInArrow(read, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose texts link, shingle by shingle."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a") \
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last:
                    last, own = a, exact_shingles(ta.as_py(), width)
                keep.append(linked(own, exact_shingles(tb.as_py(), width), threshold))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(read, "a long, b long")


def _shared(index: DataFrame, name: str) -> DataFrame:
    """Rows of ``index`` whose key several values of ``name`` have, with the smallest value as ``pivot``.

    Keys are counted with a map-side sum and joined back, so that a key of very many rows is never in one task.
    """
    found = index.groupBy("key").agg(F.min(name).alias("pivot"), F.max(name).alias("_high")).filter("pivot < _high").select("key", "pivot")
    return index.join(found.hint("merge"), "key")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id of its component)."""
    with scratch() as held:
        return held.keep(cut(_classes(docs, id, text, width, threshold)))


def _classes(docs: DataFrame, id: str, text: str, width: int, threshold: int) -> DataFrame:
    rows = cut(profiles(docs, id, text, width, threshold))
    node = F.xxhash64("digest").alias("node")
    words = [f"s{i}" for i in range(SKETCH)]
    parts = [F.expr(f"filter(keys, k -> pmod(k, {PARTS}) = {i})") for i in range(PARTS)]
    shared = [cut(_shared(rows.select(node, F.explode(part).alias("key")), "node").distinct()) for part in parts]
    shared = reduce(DataFrame.unionByName, shared)
    # The keys are most of what was written; nothing below reads them.
    keyed, rows = rows, cut(rows.drop("keys"))
    release(keyed)
    members = shared.select("node").distinct()
    info = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL").select("doc_id", node, "n_shingles", "sketch").join(members.hint("merge"), "node", "left_semi")
    info = cut(info.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
               .select("node", "rep", "n_shingles", *[F.get("sketch", F.lit(i)).alias(w) for i, w in enumerate(words)]))

    def side(letter: str) -> DataFrame:
        return info.select(F.col("node").alias(letter), *[F.col(c).alias(f"{letter}_{c}") for c in ["n_shingles", *words]])

    def close(a: str, b: str) -> Column:
        """Size and sketch allow a link."""
        small, large = F.least(f"{a}_n_shingles", f"{b}_n_shingles"), F.greatest(f"{a}_n_shingles", f"{b}_n_shingles")
        bits = reduce(add, [F.bit_count(F.col(f"{a}_{w}").bitwiseXOR(F.col(f"{b}_{w}"))) for w in words])
        return (100 * small >= threshold * large) & ((100 + threshold) * bits <= (100 - threshold) * (small + large))

    wanted = docs.select(F.col(f"`{id}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text")).join(
        info.select("rep").distinct().hint("merge"), "rep", "left_semi")
    # Written down in between, so that the texts lie in shuffle files once at a time; a node has one rep.
    own = cut(_with_digest(wanted, width).select(node, "rep", "text"))
    texts = cut(own.join(info.select("node", "rep"), ["node", "rep"]).dropDuplicates(["node", "rep"]).select("node", "text"))
    release(own)

    star = shared.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").filter(close("a", "b")).select("a", "b")
    links = cut(_verified(star, texts, width, threshold))
    joined = _components(info, links)

    spread = cut(_shared(shared.select("key", "node").join(joined, "node"), "component").select("key", "node", "component"))
    left = spread.select("key", F.col("node").alias("a"), F.col("component").alias("_ca")).join(side("a"), "a")
    right = spread.select("key", F.col("node").alias("b"), F.col("component").alias("_cb")).join(side("b"), "b")
    rest = left.join(right, (left["key"] == right["key"]) & (F.col("_ca") < F.col("_cb")) & close("a", "b")).select("a", "b").distinct()
    more = cut(_verified(rest, texts, width, threshold))
    joined = _components(info, links.unionByName(more))
    # Components are named by ids already; the classes outside any shared bucket are components of their own.
    reps = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("_rep"))
    named = reps.select("digest", "_rep", node).join(joined, "node", "left").select("digest", F.coalesce("component", "_rep").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_digest(rows: DataFrame, width: int) -> DataFrame:
    """(rep, text, digest) of rows with words: the digest of their set as in :func:`profiles`."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(shingles(t.as_py(), width)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["rep", "text", "digest"])

    return rows.mapInArrow(read, "rep long, text string, digest binary").filter("digest IS NOT NULL")


def _components(info: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) over undirected links; a component is named by the smallest id among its classes."""
    one = F.lit(0).alias("t")
    named = info.select("node", "rep")
    ends = links.join(named.select(F.col("node").alias("a"), F.col("rep").alias("src")), "a").join(named.select(F.col("node").alias("b"), F.col("rep").alias("dst")), "b")
    found = connected_components(named.select(one, F.col("rep").alias("node")), ends.select(one, "src", "dst"), tenant="t", src="src", dst="dst")
    return named.join(found.select(F.col("node").alias("rep"), "component"), "rep").select("node", "component")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the document of the smallest id of every component; of rows that repeat a kept id the one with the smallest
    digest of its text, then of its other columns, stays. Rows with a null id all stay."""
    found = classes(docs, id, text, width, threshold)
    gone = found.filter("doc_id IS NOT NULL AND doc_id != component_id").select("doc_id").distinct()
    names = docs.columns
    row = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    known = row.filter("_id IS NOT NULL").join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left_anti")
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col("_row").getField(c) for c in names if c != text]))
    again = Window.partitionBy("_id").orderBy(F.sha2(F.col("_row").getField(text).cast("string"), 256), F.sha2(others, 256))
    first = known.withColumn("_k", F.row_number().over(again)).filter("_k = 1")
    return first.select("_row.*").unionByName(row.filter("_id IS NULL").select("_row.*"))


@query("op5_jaccard_join")
def op5(spark, read):
    return classes(read("documents").select("doc_id", "text"))
