"""Many patterns against many texts, through an inverted index of the literals a match must hold.

Every pattern gives up the runs of plain characters that any of its matches
contains; their three-letter pieces are looked up in the texts, and each pattern
meets only the texts that hold the rarest of its pieces. The regular expression
decides on those. Reading the runs is cautious: a group, a class or a repeated
character ends a run, and a pattern that cannot be read so has no runs at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workgraph.operators.intervals import salted_join
from workgraph.session import cut

#: Letters of a piece; a pattern whose runs are all shorter is looked up by its longest run.
SIZE = 3
#: Groups nested deeper than this leave a pattern without literals.
DEPTH = 8
GAP = "\x00"
#: How Java writes one character or class by an escape.
ESCAPES = [r"\\[pP]\{[^}]*\}", r"\\x\{[^}]*\}", r"\\k<[^>]*>", r"\\x[0-9A-Fa-f]{2}", r"\\u[0-9A-Fa-f]{4}", r"\\0[0-7]{1,3}", r"\\[1-9][0-9]*", r"(?s)\\."]


def _folded(text) -> Column:
    """A-Z in lower case, so that one index serves patterns of either case rule."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def required_runs(pattern) -> Column:
    """Runs of characters, A-Z lower-cased, that every match of ``pattern`` contains; empty if none can be told.

    Alternatives at the top, inline flags other than a leading ``(?i)``, quoted
    stretches, and classes inside classes leave a pattern without runs. A null
    pattern has none.
    """
    return F.when(pattern.isNotNull(), _bound(F.regexp_replace(pattern, r"^\(\?i\)", ""), _runs)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _runs(pattern: Column) -> Column:
    unread = F.contains(pattern, F.lit(GAP)) | pattern.rlike(r"\\[QEcN]") | pattern.rlike(r"\(\?[a-zA-Z-]")
    plain = pattern
    for escape in ESCAPES:
        plain = F.regexp_replace(plain, escape, GAP)
    return F.when(unread, _none()).otherwise(_bound(plain, _without_classes))


def _without_classes(plain: Column) -> Column:
    unread = plain.rlike(r"\[\^?\]|\[[^\]]*(\[|&&)")
    bare = F.regexp_replace(plain, r"\[[^\]]*\]", GAP)
    for _ in range(DEPTH):
        bare = F.regexp_replace(bare, r"\([^()]*\)", GAP)
    return F.when(unread, _none()).otherwise(_bound(bare, _without_repeats))


def _without_repeats(plain: Column) -> Column:
    bare = F.regexp_replace(plain, r"\+[?+]?", GAP)
    # What may be missing takes its character with it.
    bare = F.regexp_replace(bare, r"(?s).(\*|\?|\{[^}]*\})[?+]?", GAP)
    runs = F.filter(F.split(_folded(bare), r"[\x00^$.*?{}]+"), lambda r: r != "")
    return F.when(plain.rlike(r"[()|\[\]]"), _none()).otherwise(runs)


def _pieces(text: Column, size: int) -> Column:
    """All distinct stretches of ``size`` characters; for size 0 the empty one alone."""
    if size == 0:
        return F.array(F.lit(""))
    return _bound(F.split(text, ""), lambda letters: F.array_distinct(F.filter(
        F.transform(letters, lambda c, i: F.concat(c, *[F.get(letters, i + k) for k in range(1, size)])), lambda piece: piece.isNotNull() & (piece != ""))))


def _keys_of(runs: Column) -> Column:
    """What a pattern may be looked up by: pieces of its longest size, or '' where it has no run."""
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    keys = F.array(F.lit(""))
    for size in range(1, SIZE + 1):
        pieces = F.array_distinct(F.flatten(F.transform(runs, lambda r: _pieces(r, size))))
        keys = F.when(longest >= size, pieces).otherwise(keys)
    return keys


def literal_free(patterns: DataFrame) -> DataFrame:
    """The patterns without a literal: these alone are tested against every text of their key."""
    return patterns.filter(F.size(required_runs(F.col("pattern"))) == 0)


def literal_matches(texts: DataFrame, patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``texts`` (with text) joined to those of ``patterns`` (with pattern) that match, within ``keys``.

    The same rows as a join on ``keys`` filtered by ``rlike``; columns besides
    the keys must differ by name. A null text or pattern matches nothing. Texts
    are read twice: once to count pieces, combined map-side, and once for the
    piece chosen for each pattern. A piece very many texts hold is dealt over
    salts.
    """
    keys = list(keys)
    known = patterns.filter("pattern IS NOT NULL").select(*keys, "pattern").distinct()
    asked = cut(known.withColumn("_runs", required_runs(F.col("pattern"))).select(*keys, "pattern", F.explode(_keys_of(F.col("_runs"))).alias("_piece")))
    # At most SIZE + 1 numbers; texts are cut up in the sizes some pattern asks for.
    sizes = sorted(r[0] for r in asked.select(F.length("_piece")).distinct().collect())
    low = texts.filter("text IS NOT NULL").withColumn("_low", _folded(F.col("text")))
    held_by = F.concat(_none(), *[_pieces(F.col("_low"), size) for size in sizes])
    spread = low.withColumn("_piece", F.explode(held_by)).drop("_low")
    wanted = asked.select(*keys, "_piece").distinct()
    counts = spread.select(*keys, "_piece").join(wanted, [*keys, "_piece"], "left_semi").groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    # A piece no text holds has no count, and its pattern no match.
    rated = asked.join(counts, [*keys, "_piece"], "left").groupBy(*keys, "pattern").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("piece"))).alias("_best"))
    chosen = cut(rated.filter("_best.n > 0").select(*keys, "pattern", F.col("_best.piece").alias("_piece")))
    held = cut(spread.join(chosen.select(*keys, "_piece").distinct(), [*keys, "_piece"], "left_semi"))
    full = chosen.join(patterns, [*keys, "pattern"])
    return salted_join(held, full, [*keys, "_piece"]).filter(F.rlike("text", F.col("pattern"))).drop("_piece")
