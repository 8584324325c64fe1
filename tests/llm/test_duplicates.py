"""Jaccard join, suffix-array dedup and the pipeline: against brute force, and over odd inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from workgraph.llm import jaccard_join, suffix_dedup
from workgraph.llm.registry import QUERIES, settings
from workgraph.llm.tokens import word_hashes

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def _settings(spark):
    settings(spark)


def plain_sets(rows, width=3):
    out = []
    for _, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        out.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def plain_components(rows, threshold=90, width=3):
    sets = plain_sets(rows, width)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def families(seed, groups=14, size=12):
    """Groups of texts with edits around the threshold, of sizes on both sides of the band limits."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(groups):
        n = rng.choice([3, 4, 9, 10, 11, 12, 13, 20, 21, 22, 40, 90, 200])
        origin = [rng.choice(pool) for _ in range(n)]
        for _ in range(size):
            words = list(origin)
            for _ in range(rng.choice([0, 0, 1, 1, 2, max(1, n // 60), n // 25])):
                p = rng.randrange(len(words))
                words[p:p + rng.randint(0, 1)] = [rng.choice(pool)] * rng.randint(0, 1)
            rows.append((len(rows) * 3 % 1009, " ".join(words)))
    return rows


def test_components_match_brute_force(spark):
    rows = families(1) + families(2) [:0]
    rows += [(2000, rows[0][1].upper()), (2001, None), (2002, ""), (2003, " \t\n"), (2004, "one"), (2005, "ONE"), (2006, "one two"), (2005, "ONE"),
             (None, rows[5][1]), (None, "alone and without id"), (2007, " "), (2008, "É one"), (2009, "é one")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "key": F.lit(2), "rep": F.lit(3)})
    got = sorted((tuple(r) for r in jaccard_join.classes(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted(plain_components(rows), key=str)


def test_every_linked_pair_shares_a_key():
    """The pigeonhole itself, over many pairs that just link, and for schemes with and without one-deletion segments."""
    rng = np.random.default_rng(5)
    seen = set()
    for n in [9, 10, 11, 18, 19, 20, 37, 60, 100, 333, 1000]:
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = (len(a) * 2 * 10) // 190
            drop = int(rng.integers(0, most + 1))
            add = int(rng.integers(0, most - drop + 1))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, add).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(jaccard_join.keys(a), jaccard_join.keys(b))), (len(a), len(b), both)
                bits = sum(int(x).bit_count() for x in (jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint64))
                assert bits <= len(np.setxor1d(a, b))
                seen.add(n)
    assert len(seen) >= 9
    kinds = {tuple(bool(x) for x in jaccard_join.scheme(k, 90)[1:]) for k in range(60)}
    assert {(False, False), (True, False), (True, True)} <= kinds  # segments likely to run empty are made up for by exact ones


def test_one_deletion_segments_find_single_differences(monkeypatch):
    monkeypatch.setattr(jaccard_join, "scheme", lambda band, threshold: (4, 1, 2))
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        b = np.delete(a, rng.permutation(len(a))[:rng.integers(0, 5)])
        if len(np.setxor1d(a, b)) <= 4 and len(b) >= 37:
            assert len(np.intersect1d(jaccard_join.keys(a), jaccard_join.keys(b)))


def test_linked_pairs_share_a_key_where_segments_run_empty():
    """At 0.8 there are few shingles a segment: sets of any size that just link, and how many keys that takes."""
    rng = np.random.default_rng(8)
    for n in [3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 19, 24, 30, 47, 75, 118, 200, 411, 1300]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = len(a) * 2 * 20 // 180
            drop = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, most - drop + 1))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert not len(np.setxor1d(a, b)) or len(np.intersect1d(jaccard_join.keys(a, 80), jaccard_join.keys(b, 80))), (len(a), len(b), both)
        assert len(jaccard_join.keys(a, 80)) <= 3 * n + 8


def test_buckets_of_the_given_table_are_small():
    """Texts that meet in a bucket without being similar: fewer pairs than documents at 2,500, 5,000 and 10,000 documents.

    What is left are texts that share a very common line and hold nothing else in a segment.
    """
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    sets, seen, buckets = {}, set(), {}
    for i, t in enumerate(texts):
        s = jaccard_join.shingles(t, 5)
        if len(s) and s.tobytes() not in seen:
            seen.add(s.tobytes())
            sets[i] = s
            for k in jaccard_join.keys(s, 80).tolist():
                buckets.setdefault(k, []).append(i)
    shared = [b for b in buckets.values() if len(b) > 1]
    for n in (2_500, 5_000, 10_000):
        pairs = {(b[x], b[y]) for b in shared for y in range(len(b)) if b[y] < n for x in range(y)}
        assert sum(10 * len(np.intersect1d(sets[a], sets[b])) < 3 * len(sets[a]) for a, b in pairs) < n / 2
        assert max(sum(i < n for i in b) for b in shared) < 25


def test_one_of_each_group_stays(spark):
    rows = families(3, groups=6)
    rows += [(1500, None), (1501, ""), (1502, "only once here"), (1502, "only once here"), (None, "no id"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, DOCS).withColumns({"_row": F.lit(1), "_id": F.lit("x"), "component_id": F.lit(2)})
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns
    want = sorted({c for d, _, c in plain_components(rows) if d is not None})
    assert sorted(r["doc_id"] for r in out.filter("doc_id IS NOT NULL").collect()) == want
    assert out.filter("doc_id IS NULL").count() == 2
    assert jaccard_join.classes(df.limit(0)).count() == 0 and jaccard_join.keep_one(df.limit(0)).count() == 0


def test_word_hashes_read_long_texts_whole():
    words = [f"é{i % 977}" for i in range(600_000)]
    whole = word_hashes(" ".join(words))
    assert len(whole) == 600_000 and len(np.unique(whole)) == 977
    assert (whole[:977] == whole[977 * 500:977 * 501]).all()


def plain_dedup(rows, length=50):
    data = [((t or "").encode(), d) for d, t in rows]
    first = {}
    for b, d in data:
        if d is not None:
            for q in range(len(b) - length + 1):
                first[b[q:q + length]] = min(d, first.get(b[q:q + length], d))
    out = []
    for b, d in data:
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            if d is not None and first[b[q:q + length]] < d:
                gone[q:q + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(rng.choice([30, 40, 49, 50, 51, 80, 300])) for _ in range(9)]
    rows = []
    for i in range(50):
        rows.append((rng.randrange(10_000), text(rng.randint(0, 60)).join(rng.choice(shared) for _ in range(rng.randint(0, 5))) + text(rng.randint(0, 90))))
    return rows + [(20_000 + i, "a" * n) for i, n in enumerate([49, 50, 51, 200, 120])] + [(30_000, None), (30_001, ""), (30_002, rows[3][1]), (30_003, rows[3][1]),
                                                                                          (None, rows[3][1]), (None, None)]


def test_removed_bytes_match_brute_force(spark):
    rows = passages(1)
    df = spark.createDataFrame(rows, DOCS).withColumns({"anchor": F.lit(1), "begin": F.lit(2), "_text_id": F.lit(3)})
    assert sorted((tuple(r) for r in suffix_dedup.dedup(df).collect()), key=str) == sorted(plain_dedup(rows), key=str)
    again = rows + [rows[1], rows[-4]]
    assert sorted((tuple(r) for r in suffix_dedup.dedup(spark.createDataFrame(again, DOCS)).collect()), key=str) == sorted(plain_dedup(again), key=str)
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_small_shards_and_pieces_change_nothing(spark, monkeypatch):
    rows = passages(2)
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(suffix_dedup, "SHARD", 500)
    spark_rows = sorted((tuple(r) for r in suffix_dedup.dedup(df).collect()), key=str)
    assert spark_rows == sorted(plain_dedup(rows), key=str)
    data = "".join(random.Random(4).choice("abc") for _ in range(5000)).encode()
    whole = suffix_dedup.anchor_runs(data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    parts = suffix_dedup.anchor_runs(data)
    owner = lambda runs: {w: h for h, a, b, _ in zip(*[x.tolist() for x in runs]) for w in range(a, b + 1)}
    assert owner(whole) == owner(parts) and sorted(owner(whole)) == list(range(5000 - 49))


@pytest.mark.parametrize("data", [b"banana", b"a" * 300, b"abcabcabd" * 40, bytes(random.Random(1).choices(range(3), k=2000)), b"x"])
def test_suffix_array_and_prefixes(data):
    codes = np.frombuffer(data, np.uint8)
    order = suffix_dedup.suffix_array(codes, 50)
    keys = [data[i:i + 50] for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(data)))
    words = suffix_dedup.words_at(codes)
    got = suffix_dedup.common_prefixes(words, order[:-1], order[1:]).tolist()
    for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), got):
        x, y = data[a:a + 50], data[b:b + 50]
        want = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert n >= want if want == min(len(x), len(y)) < 50 else n == want


def test_pipeline_of_the_data_and_of_odd_rows(spark):
    out = QUERIES["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    rows = out.collect()
    assert 0 < len(rows) == len({r["doc_id"] for r in rows}) and all(r["copies"] > 0 and r["n_chars"] == len(r["text"]) for r in rows)
    good = "The quick brown fox is in the garden and the lazy dog of the house sleeps with it for a long day."
    docs = spark.createDataFrame([(1, good, None, None, None, "x"), (None, good + " Again.", "en", "s", 3, None), (2, None, "en", "s", 0, "y"), (3, "", "en", "s", 0, "y"),
                                  (1, good, None, None, None, "x"), (4, good + " token = \"0123456789abcdef0123456789abcdef\" in it", "de", "t", 5, "z")],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for table in (docs, docs.limit(0)):
        left = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, "/root/testdata/sf0.001")
            assert left.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, left, "/root/testdata/sf0.001")
        assert last.columns == [*docs.columns, "copies"]
        texts = sorted(r["text"] for r in left.collect())
        assert texts == (sorted([good, good + " Again.", good + " [secret]\" in it"]) if table is docs else [])


def test_stages_against_brute_force(spark):
    """Each stage on its own input: what goes and what stays, worked out in plain Python."""
    from test_native_rules import plain_measures, plain_spans
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = [{r["doc_id"]: r["text"] for r in stage(spark, docs, sf).collect()} for _, stage in corpus_pipeline.STAGES[:-1]]
    bad = {d for d, t in texts.items() if (m := plain_measures(t))[0] < 10 or 5 * m[4] > m[0] or m[2] > 0.1 * m[0]}
    assert not bad & out[0].keys() and all(out[0][d] == texts[d] for d in out[0])
    assert set(out[1]) == {c for _, _, c in plain_components(list(texts.items()), 80, 5)}
    from test_scans import plain_hits
    for d, t in texts.items():
        total, hit, _ = plain_hits(t, items)
        assert (d in out[2]) == (2 * hit <= total)
        if d in out[2]:
            assert (out[2][d] == t) == (hit == 0) and plain_hits(out[2][d], [])[0] == total - hit
    for d, t in texts.items():
        assert ("[secret]" in out[3][d]) == bool(plain_spans(t)[1])


def test_near_duplicate_stage_takes_five_words_and_80(spark):
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n, places in [(100, [30, 70]), (200, [20, 60, 110, 160]), (500, range(25, 500, 50))]:
        origin = words(n)
        copy = [f"changed{i}" if i in places else w for i, w in enumerate(origin)]
        rows += [(len(rows), " ".join(origin)), (len(rows) + 1, " ".join(copy))]
    long = words(500)
    rows += [(6, " ".join(long)), (7, " ".join(long + words(100))), (8, " ".join(long + words(140)))]
    rows += [(100 + i, t) for i, (_, t) in enumerate(families(7, groups=8))]
    sets = plain_sets(rows, 5)
    nodes = list(range(len(rows)))
    for _ in rows:  # the smallest place of every component, by rounds until nothing changes
        new = [min(nodes[j] for j in range(len(rows)) if j == i or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == nodes:
            break
        nodes = new
    df = spark.createDataFrame(rows, DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == sorted({rows[n][0] for n in nodes})
    assert [d for d in kept if d < 100] == [0, 2, 4, 6, 8]


def test_near_duplicate_stage_over_the_data_and_the_stages_after_it(spark):
    """As in ``test_stages_against_brute_force``, with the near-duplicate stage at five words and 80."""
    from test_native_rules import plain_spans
    from test_scans import plain_hits
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    near, clean, safe = [{r["doc_id"]: r["text"] for r in stage(spark, docs, sf).collect()} for _, stage in corpus_pipeline.STAGES[1:-1]]
    ids, sets = list(texts), plain_sets(list(texts.items()), 5)
    links = [[j for j in range(len(ids)) if j == i or sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(ids))]
    least = list(ids)
    for _ in ids:
        least = [min(least[j] for j in links[i]) for i in range(len(ids))]
    assert set(near) == set(least)
    for d, t in texts.items():
        total, hit, _ = plain_hits(t, items)
        assert (d in clean) == (2 * hit <= total)
        if d in clean:
            assert (clean[d] == t) == (hit == 0) and plain_hits(clean[d], [])[0] == total - hit
        assert ("[secret]" in safe[d]) == bool(plain_spans(t)[1])


def test_index_keys_are_deleted_before_texts_are_written(frame, monkeypatch):
    """The index keys are most of a run's disk: they go once the shared ones are known, and texts are written after that."""
    import os

    written, plain = [], jaccard_join.cut

    def watched(df):
        out = plain(df)
        written.append((set(out.columns), out._cut_path, [c for c, path, _ in written if os.path.exists(path.removeprefix("file:"))]))
        return out

    monkeypatch.setattr(jaccard_join, "cut", watched)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:59], "other"])), (2, " ".join([*words[:59], "other"])), (3, " ".join(reversed(words)))]
    assert sorted(map(tuple, jaccard_join.classes(frame(rows, DOCS)).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (2, 1), (3, 3)]
    beside = [held for columns, _, held in written if "text" in columns]
    assert beside and not any("keys" in columns for held in beside for columns in held)
