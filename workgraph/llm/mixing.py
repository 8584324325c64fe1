"""Mixing sources to target weights: token weights are raked to source, language and topic marginals, then documents are sampled.

Documents are counted into cells (source, language, topic) once; the iterative fitting works on the cell table alone. That
table is small next to the documents but has no fixed bound, so it stays a DataFrame: each round is written to the
checkpoint folder and read back. A document is drawn by a hash of its id, so the draw is repeatable and needs no shuffle
of the documents beyond the join with their cell.

Null sources, languages and texts form values of their own (null text: no tokens). Every document row is drawn for itself;
repeated rows with one id get the same draw. A null id has a draw too. Texts without words have no token weight, but take
part in the draw of their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workgraph.llm.columns import whole
from workgraph.llm.registry import query
from workgraph.session import cut

#: Topic by the first row of which the text contains a string; what fits none is prose.
TOPICS = [("license", ["icense", "ICENSE", "icence"]), ("credentials", ["password", "token", "AKIA"]), ("tables", [" | "]),
          ("markup", ["###", "$$$", "%%%", "&&&", "***"]), ("shouting", ["!!"])]
DIMS = ["source", "lang", "topic"]
#: A value's target share grows with its own share to this power: 1 keeps the corpus, 0 makes all values equal.
TEMPER = 0.7
#: Rounds of fitting, each over all dimensions; a round divides the distance to the targets several times.
ROUNDS = 8
#: Decimals that weights are rounded to between rounds, so that sums do not depend on the order of their rows.
PLACES = 6


def n_tokens(text: Column) -> Column:
    """White-space words of a text."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    out = F
    for name, parts in TOPICS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(whole(text), F.lit(part))
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("prose"))


def _dims(source: Column, lang: Column, text: Column) -> list[Column]:
    return [F.coalesce(source.cast("string"), F.lit("(none)")).alias("source"), F.coalesce(lang.cast("string"), F.lit("(none)")).alias("lang"),
            topic(text).alias("topic")]


def labelled(docs: DataFrame, id: str, text: str, source: str, lang: str) -> DataFrame:
    """The columns the mixing needs, under names of its own."""
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{id}`").alias("doc_id"), *_dims(F.col(f"`{source}`"), F.col(f"`{lang}`"), body), n_tokens(body).alias("n_tokens"))


def tempered(cells: DataFrame, dim: str, power: float = TEMPER) -> DataFrame:
    """Target tokens per value of a dimension: its share to ``power``, scaled to all tokens."""
    per = cells.groupBy(dim).agg(F.sum("tokens").alias("_own"))
    flat = F.when(F.col("_own") > 0, F.pow(F.col("_own").cast("double"), F.lit(power))).otherwise(F.lit(0.0))
    per = per.withColumn("_flat", F.round(flat, PLACES).cast("decimal(38,6)"))
    total = per.agg(F.sum("_own").alias("_all"), F.sum("_flat").alias("_flats"))
    return per.crossJoin(F.broadcast(total)).select(dim, F.when(F.col("_flats") > 0, F.col("_all") * (F.col("_flat").cast("double") / F.col("_flats").cast("double")))
                                                    .otherwise(F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimension columns, tokens) with ``weight``: tokens fitted to the targets, dimension after dimension.

    A round scales every cell by target / current sum of its value, for each dimension in turn. Every step is written down: the next
    one reads its cells twice, so plans over unwritten steps would double with each dimension.
    Values without a target keep their weight; cells without tokens stay empty. Targets that contradict each other (a
    language that only one source has, say) cannot all be met; the last dimension's then hold.
    """
    weighted = cells.withColumn("weight", F.col("tokens").cast("decimal(38,6)"))
    for _ in range(rounds):
        for dim, target in targets.items():
            now = weighted.groupBy(dim).agg(F.sum("weight").alias("_now"))
            factor = now.join(target, dim, "left").select(dim, F.when(F.col("target").isNull() | (F.col("_now") == 0), F.lit(1.0)).otherwise(
                F.col("target") / F.col("_now").cast("double")).alias("_factor"))
            weighted = cut(weighted.join(factor, dim).withColumn(
                "weight", F.round(F.col("weight").cast("double") * F.col("_factor"), PLACES).cast("decimal(38,6)")).drop("_factor"))
    return weighted


def draw(id: Column, seed: str = "mix") -> Column:
    """A repeatable number in [0, 1) per id: 32 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = 1.0, id: str = "doc_id", text: str = "text",
        source: str = "source", lang: str = "lang", seed: str = "mix", rounds: int = ROUNDS) -> DataFrame:
    """Per document row: source, lang, topic, n_tokens, ``expected`` copies and the drawn number of ``copies``.

    Expected copies of a document are rate * fitted weight / tokens of its cell, so that expected tokens meet the targets
    exactly: a share above one is a certain copy plus a chance of another, and nothing is clipped. ``targets`` gives a
    table (value, target tokens) per dimension; without it the corpus' own shares are tempered.
    """
    rows = cut(labelled(docs, id, text, source, lang))
    return _with_copies(rows.join(_expected(rows, targets, rate, rounds), DIMS), F.col("doc_id"), seed)


def _expected(rows: DataFrame, targets: dict[str, DataFrame] | None, rate: float, rounds: int) -> DataFrame:
    cells = cut(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    wanted = targets or {d: cut(tempered(cells, d)) for d in DIMS}
    share = F.when(F.col("tokens") > 0, F.col("weight").cast("double") / F.col("tokens")).otherwise(F.lit(1.0))
    return rake(cells, wanted, rounds).select(*DIMS, F.round(F.lit(rate) * share, PLACES).alias("expected"))


def _with_copies(rows: DataFrame, id: Column, seed: str) -> DataFrame:
    sure = F.floor("expected")
    return rows.withColumn("copies", (sure + F.when(draw(id, seed) < F.col("expected") - sure, 1).otherwise(0)).cast("long"))


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = 1.0, id: str = "doc_id", text: str = "text",
            source: str = "source", lang: str = "lang", seed: str = "mix", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``copies``, without the documents of which no copy was drawn (see :func:`mix`)."""
    expected = _expected(labelled(docs, id, text, source, lang), targets, rate, rounds)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = row.select("_row", *_dims(F.col("_row")[source], F.col("_row")[lang], F.col("_row")[text]))
    drawn = _with_copies(rows.join(expected, DIMS), F.col("_row")[id], seed).filter("copies > 0")
    return drawn.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != "copies"], "copies")


def sql(source: str = "documents", rounds: int = ROUNDS) -> str:
    """The same fitting, every round written out."""
    cases = " ".join(f"WHEN {' OR '.join(f"contains(t, '{p}')" for p in parts)} THEN '{n}'" for n, parts in TOPICS)
    per = lambda d: f"""t_{d} AS (SELECT {d}, (SELECT sum(tokens) FROM cells) * (f::DOUBLE / (SELECT sum(f) FROM f_{d})::DOUBLE) AS target FROM f_{d})"""
    flat = lambda d: f"f_{d} AS (SELECT {d}, round(pow(sum(tokens)::DOUBLE, {TEMPER}), {PLACES})::DECIMAL(30,6) AS f FROM cells GROUP BY {d})"
    steps, last = [], "w0"
    for r in range(rounds):
        for d in DIMS:
            name = f"w{r}_{d}"
            steps.append(f"""{name} AS MATERIALIZED (SELECT c.* EXCLUDE (weight), round(c.weight::DOUBLE * CASE WHEN n.now = 0 THEN 1.0 ELSE t.target / n.now::DOUBLE END, {PLACES})::DECIMAL(30,6) AS weight
                FROM {last} c JOIN (SELECT {d}, sum(weight) AS now FROM {last} GROUP BY {d}) n USING ({d}) JOIN t_{d} t USING ({d}))""")
            last = name
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t FROM {source}),
    rows AS MATERIALIZED (SELECT doc_id, source, lang, CASE {cases} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM d),
    cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL),
    {", ".join(flat(d) for d in DIMS)}, {", ".join(per(d) for d in DIMS)},
    w0 AS (SELECT *, tokens::DECIMAL(30,6) AS weight FROM cells), {", ".join(steps)},
    e AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN weight::DOUBLE / tokens ELSE 1.0 END, {PLACES}) AS expected FROM {last})
    SELECT doc_id, source, lang, topic, n_tokens, expected, (floor(expected) + CASE WHEN ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT / 4294967296.0
           < expected - floor(expected) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rows JOIN e USING (source, lang, topic)"""


@query("op3_source_mixing", sql())
def op3(spark, read):
    return mix(read("documents").select("doc_id", "text", "source", "lang"))
