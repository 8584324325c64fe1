"""Source audit, spelling variants and vector search: against brute force, and over odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from workgraph.llm import source_audit, spelling, vector_search
from workgraph.llm.registry import settings


@pytest.fixture(scope="module", autouse=True)
def _settings(spark):
    settings(spark)


def plain_audit(rows, least, shown):
    rows = [tuple(v or "" for v in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, _, _ in rows]
    out = []
    for lang in {l for _, l, _ in rows}:
        mine = [(s, c) for (_, l, s), c in zip(rows, terms) if l == lang]
        docs = Counter(w for _, c in mine for w in c)
        kept = {w for w, n in docs.items() if n >= least}
        counts = {s: Counter() for s, _ in mine}
        whole = Counter()
        for s, c in mine:
            for w in kept & c.keys():
                counts[s][w] += c[w]
                whole[w] += c[w]
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            pairs = sorted(((-sum(abs(ps[s][w] - ps[o][w]) for w in kept), o.encode(), o) for o in counts if o != s))
            tops = sorted((q[w] - ps[s][w], w.encode(), w) for w in kept if counts[s][w] and ps[s][w] > q[w])[:shown]
            out += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", tops)) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit_rows(seed, n=160):
    rng = random.Random(seed)
    pool = [rng.choice(["wort", "Ünï", "é", "x", "日本", "word", "Z"]) + rng.choice(["", "a", "ß", "y"]) for _ in range(40)]
    rows = [("".join(rng.choice(pool) + rng.choice([" ", "\n", "-", "1", "\u007f", "'"]) for _ in range(int(rng.expovariate(0.05)))), rng.choice(["de", "de", "fr", None, ""]),
             rng.choice(["s1", "s1", "s2", "s3", "é", None])) for _ in range(n)]
    return rows + [(None, "de", "empty"), ("", "xx", "a"), (" 12 ", "xx", "b"), ("one", "yy", "alone")] + rows[:3]


def test_source_audit_matches_brute_force(spark, monkeypatch):
    rows = audit_rows(1)
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "tile": F.lit(2), "count": F.lit("x")})
    got = lambda d, **k: sorted(tuple(r) for r in source_audit.audit(d, **k).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got(df) == plain_audit(rows, 30, 50)
    want = plain_audit(rows, 4, 7)
    assert got(df, least=4, shown=7) == want and any(r[2] == "term" for r in want)
    assert got(df.limit(0)) == []
    # Small blocks, tiles and task memories change nothing.
    monkeypatch.setattr(source_audit, "BLOCK", 25)
    monkeypatch.setattr(source_audit, "TILE", 2)
    monkeypatch.setattr(source_audit, "HELD", 50)
    assert got(df, least=4, shown=7) == want


def test_shares_are_exact():
    counts = np.array([[0, 3, 10**9 - 5], [10**9, 10**12, 7]])
    totals = np.array([12345678901, 10**13])
    for part in (counts, counts[:1], counts[:1, :2]):
        want = [[1 + 10**9 * (int(c) + 5) // int(t) for c in row] for row, t in zip(part, totals)]
        assert source_audit.exact_shares(part, totals[:len(part)]).tolist() == want
    text = "a" * (1 << 20) + " Bé" * 400_000
    assert source_audit.term_counts(text) == Counter({b"a" * (1 << 20): 1, "bé".encode(): 400_000})


def plain_words(rows, letters, least):
    found = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= least}


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows, letters=5, least=3):
    found = plain_words(rows, letters, least)
    near = {w: [v for v in found if plain_near(w, v)] for w in found}
    form = {}
    for w, n in found.items():
        best = min(near[w], key=lambda v: (-found[v], v), default=None)
        if best is not None and found[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in found.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), found.get(form.get(w)), root))
    return sorted(out)


def misspelt(seed, n=300):
    rng = random.Random(seed)
    pool = ["letters", "leters", "lettters", "banana", "bananas", "bannana", "aaaaa", "aaaaaa", "aaaaaaa", "élève", "elève", "ÉLÈVE", "straße", "strasse", "x÷y×zz", "house", "mouse", "moose",
            "Housé", "hous", "ÿÿÿÿÿ", "ÿÿÿÿÿÿ", "abcde", "abcdef", "bcdef", "bacde"]
    weights = [rng.random() ** 4 + 0.01 for _ in pool]
    rows = []
    for i in range(n):
        words = rng.choices(pool, weights, k=rng.randint(0, 40))
        for j in range(len(words)):
            if rng.random() < 0.3:
                p = rng.randrange(len(words[j]))
                words[j] = words[j][:p] + rng.choice(["", "a", "é", "t"]) + words[j][p + rng.randint(0, 1):]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "-", "0", "Ā", "日"]).join(words)))
    return rows + [(None, "letters houses"), (5, None), (6, ""), (7, "1 2 3"), *rows[:2]]


def test_spelling_variants_match_brute_force(spark, monkeypatch):
    rows = misspelt(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "root": F.lit("x")})
    got = lambda d: sorted(tuple(r) for r in spelling.variants(d).select("word", "n", "n_near", "form", "form_n", "root").collect())
    want = plain_variants(rows)
    assert got(df) == want and any(w[5] not in (w[0], w[3]) for w in want) and len(want) > 100
    monkeypatch.setattr(spelling, "HELD", 20)
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert got(df) == want
    assert got(df.limit(0)) == []


def test_neighbours_are_the_near_pairs_once(spark):
    rng = random.Random(3)
    found = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))): i for i in range(250)}
    pairs = [tuple(r) for r in spelling.neighbours(spark.createDataFrame(list(found.items()), "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b, found[b]) for a in found for b in found if plain_near(a, b)}


def test_chains_of_forms_end_at_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w36"), ("b", "c")]
    got = dict(tuple(r) for r in spelling._roots(spark.createDataFrame(chain, "word string, form string")).select("word", "root").collect())
    assert got == {w: "c" if w == "b" else "w37" for w, _ in chain}


def plain_nearest(rows, every, k):
    length = Counter(len(v) for _, v in rows if v)
    held = {}
    most = max((n, l) for l, n in Counter(len(v) for v in dict(rows).values() if v and any(v) and all(x is not None and math.isfinite(x) for x in v)).items())[1] if length else 0
    for i, v in rows:
        if i is not None and v and len(v) == most and any(v) and all(x is not None and math.isfinite(x) for x in v):
            held[i] = min(held.get(i, v), v)
    out = {}
    for q in held:
        if q % every == 0:
            a = np.array(held[q], float)
            score = {i: float((np.array(v) * a).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((a * a).sum()))) for i, v in held.items() if i != q}
            out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found_nearest(df, **k):
    got = {}
    for r in vector_search.nearest(df, **k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


VECTORS = "vec_id long, embedding array<float>"


def test_nearest_of_odd_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(np.float32(x)) for x in rng.normal(size=6)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[7]) for i in range(150)] + [(400, None), (450, [0.0] * 6), (451, [float("nan")] + [1.0] * 5), (452, [None] + [1.0] * 5), (453, [float("inf")] + [1.0] * 5),
                                                             (454, []), (455, [1.0]), (None, vectors[0]), (50, vectors[50]), (500, [-x for x in vectors[7]])]
    rows += [(600, [float(np.float32(x * 2)) for x in vectors[7]])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"id": F.lit(1), "part": F.lit(2), "block": F.lit(3)})
    want, got = plain_nearest(rows, 50, 5), found_nearest(df)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-14)
    few = spark.createDataFrame(rows[48:52], VECTORS)
    assert {q: len(v) for q, v in found_nearest(few).items()} == {50: 3}
    assert found_nearest(df.limit(0)) == {} and found_nearest(spark.createDataFrame([(0, [1.0, 2.0])], VECTORS)) == {}


def test_recall_of_learned_partitions(spark, monkeypatch):
    """Blocks of 100 rows and 12 parts over clustered vectors, some of them very often: recall, exact scores, order."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    x[rng.permutation(3000)[:900]] = x[11]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    df = spark.createDataFrame(rows, VECTORS)
    got, want = found_nearest(df, parts=12), plain_nearest(rows, 50, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    exact = {(q, v): s for q, found in plain_nearest(rows, 50, 3000).items() for v, s in found}
    for q, found in got.items():
        assert all(abs(s - exact[q, v]) < 1e-14 for v, s in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


def test_parts_are_balanced_and_visits_are_fewer():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 12))[rng.integers(0, 8, 1600)] + 0.1 * rng.normal(size=(1600, 12))
    known = vector_search.unit(x)
    graph = vector_search.neighbour_graph(known, 10)
    label = vector_search.balanced_parts(known, graph, 16)
    assert np.bincount(label, minlength=16).max() <= 105
    inside = (label[graph] == label[:, None]).mean()
    assert inside > 0.4  # by chance 1 in 16
    model = vector_search.fit(x, 16)
    assert model.weights.shape == (13, 16) and 1 <= model.visits <= 6
