"""The classifiers: held-out accuracy, what they may learn from, and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from workgraph.llm import labelled, quality_gam, toxicity
from workgraph.llm.registry import QUERIES, settings

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module", autouse=True)
def _settings(spark):
    settings(spark)


def area(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    for value in np.unique(score):
        same = score == value
        ranks[same] = ranks[same].mean()
    ones = (label == 1).sum()
    return (ranks[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("query, label, threshold", [("op8_quality_gam", "quality", 0.3), ("op4_toxicity", "toxic", 0.5)])
def test_held_out_rows_are_told_apart(spark, query, label, threshold):
    got = QUERIES[query](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    known = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(known) > 300
    assert area(known.score.to_numpy(), known[label].to_numpy()) > 0.97
    assert (known.predicted == known[label]).mean() > 0.95


def test_training_rows_are_bounded_and_never_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(None, "none"), (7, "again")], "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (1, 0), (1, 0), (200, 1), (2, None)], "doc_id long, quality int")
    got = labelled.training_rows(docs, labels, "quality").collect()
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    want = sorted([(f"t{i}", 0 if i == 1 else i % 2) for i in free] + ([("again", 1)] if 7 in free else []))
    assert sorted((r["text"], r["label"]) for r in got) == want
    few = labelled.training_rows(docs.filter("text != 'again'"), labels, "quality", rows=10)
    assert few.count() == 10 and few.collect() == few.collect()


def test_an_id_with_very_many_rows_does_not_break_the_bound(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"t{i}") for i in ids] + [(ids[0], "t0 again")] * 300 + [(ids[1], f"other {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = [r["text"] for r in labelled.training_rows(docs, labels, "quality").collect()]
    assert sorted(got) == sorted({t for _, t in rows})
    few = [r["text"] for r in labelled.training_rows(docs, labels, "quality", rows=len(ids)).collect()]
    owner = {t: i for i, t in rows}
    assert sorted(owner[t] for t in few) == ids
    less = labelled.training_rows(docs, labels, "quality", rows=10).collect()
    assert len(less) == 10 and len({owner[r["text"]] for r in less}) == 10


@pytest.mark.parametrize("module, label", [(quality_gam, "quality"), (toxicity, "toxic")])
def test_models_of_nothing_and_of_one_label(spark, module, label):
    docs = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, None), (3, ""), (None, "x " * 200_000)], "doc_id long, text string") \
        .withColumns({"score": F.lit("x"), "held_out": F.lit(0)})
    empty = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.train(docs, empty, label)
    got = module.score(docs, model).collect()
    assert len(got) == 5 and all(r["score"] == pytest.approx(0.5) for r in got)
    assert module.score(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], f"doc_id long, {label} int")
    assert all(r["score"] > 0.5 for r in module.score(docs, module.train(docs, one, label)).collect())


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone = quality_gam.fit(x, y, rounds=60, pairs=0)
    paired = quality_gam.fit(x, y, rounds=60, pairs=3)
    assert (alone.scores(x) > 0.5).astype(float).tolist() != y.tolist()
    assert ((paired.scores(x) > 0.5) == y).mean() > 0.97 > ((alone.scores(x) > 0.5) == y).mean()
    assert (1, 0) in paired.pairs


def test_a_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality_gam.FEATURES)))
    y = (x[:, 2] + 0.3 * x[:, 3] > 0.6).astype(float)
    model = quality_gam.fit(x, y, rounds=30)
    for row in x[:20]:
        total = model.base
        for f, (edge, table) in enumerate(zip(model.edges, model.tables)):
            total += table[sum(row[f] >= e for e in edge)]
        for (i, j), table in zip(model.pairs, model.pair_tables):
            total += table[sum(row[i] >= e for e in model.pair_edges[i]), sum(row[j] >= e for e in model.pair_edges[j])]
        assert model.logits(row[None])[0] == pytest.approx(total)


def biased(n=600, seed=2):
    """Texts where toxic ones mostly name one group, and clean ones seldom do: the word itself means nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        words = list(rng.choice(["house", "garden", "river", "letter", "music", "people", "window"], 8))
        if rng.random() < (0.98 if toxic else 0.02):
            words.append("muslim")
        if toxic and rng.random() < 0.6:
            words.append("vermin")
        rows.append((i, " ".join(words), toxic))
    return rows


def test_counterfactuals_spare_neutral_mentions(spark):
    rows = biased()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain = toxicity.train(docs, labels, strength=0.0)
    fair = toxicity.train(docs, labels, strength=50.0)
    gap = lambda m: abs(m.logit({b"muslim", b"garden"}) - m.logit({b"christian", b"garden"}))
    assert gap(plain) > 2.0 and gap(fair) < 0.3
    assert fair.score("the garden of a muslim house") < 0.5 < plain.score("the garden of a muslim house")
    assert fair.score("vermin in the garden") > 0.5


def test_swaps_go_by_sentence_and_term():
    got = toxicity.swaps("Women and men met. Ten men sang! nobody else; the end")
    names = toxicity.feature_names
    women, men = names({b"women"}), names({b"men"})
    # In the first sentence the other term stands already: only its own features go. In the second, men become women.
    want = {(frozenset(women), frozenset()): 1 / 3, (frozenset(men), frozenset()): 1 / 3, (frozenset(men), frozenset(women)): 1 / 3}
    assert got == pytest.approx(want)
    many = toxicity.swaps("a muslim neighbour")
    assert len(many) == 5 and sum(many.values()) == pytest.approx(1.0)
    assert all(gone == names({b"muslim"}) for gone, _ in many)
    long = toxicity.swaps("the women sang. " * 50_000)
    assert long == pytest.approx({(frozenset(women), frozenset(men)): 1.0})
    assert toxicity.swaps(None) == toxicity.swaps("") == toxicity.swaps("no group here") == {}


def test_neutral_mentions_in_the_given_table_before_and_after(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = docs.join(labels, "doc_id").filter(labelled.held_out(F.col("doc_id")) & (F.col("toxic") == 0)).select("text").toPandas().text
    plain, fair = toxicity.train(docs, labels, strength=0.0), toxicity.train(docs, labels)
    wrong = {name: sum(m.score(t) >= 0.5 for t in held) for name, m in [("plain", plain), ("fair", fair)]}
    spread = lambda m: max(max(z) - min(z) for z in ([m.logit({t.encode(), b"garden"}) for t in terms] for terms in toxicity.IDENTITIES))
    # Every clean held-out text with a neutral mention of each group added.
    named = [t.encode() for terms in toxicity.IDENTITIES[:9] for t in terms]
    added = {name: sum(m.logit(toxicity.vocabulary(t) | {term}) >= 0 for t in held[:200] for term in named) for name, m in [("plain", plain), ("fair", fair)]}
    print("false positives", wrong, "with a mention", added, "of", 200 * len(named), "spread", spread(plain), spread(fair))
    assert wrong["fair"] <= wrong["plain"] and added["fair"] <= added["plain"] and spread(fair) <= spread(plain)
    assert wrong["fair"] <= 0.02 * len(held)


def test_a_score_needs_words_not_counts():
    model = toxicity.Model({b"w:bad": 3.0, b"p:abcd": 2.0, b"w:none": 0.0}, -1.0)
    assert model.logit(toxicity.vocabulary("Bad BAD bad abcde abcdf")) == pytest.approx(4.0)
    assert model.logit(toxicity.vocabulary(None)) == -1.0 and model.logit(set()) == -1.0
