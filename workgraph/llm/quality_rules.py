"""Quality rules: a threshold table compiled into one projection over the text.

Nothing is shuffled and no user function runs; a document is judged by its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workgraph.llm.columns import blanks_alike, count_chars, ratio, whole
from workgraph.llm.registry import query

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages.
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "on", "was",
              "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "nicht", "des", "im", "dem",
              "le", "la", "les", "et", "de", "un", "une", "que", "est", "dans", "pour", "du", "qui", "en",
              "el", "los", "las", "y", "una", "por", "con", "del", "se", "para", "su"]

#: rule, measure, lowest value kept, highest value kept (None: open), words a text needs before the rule applies.
RULES: list[tuple[str, str, float | None, float | None, int]] = [
    ("too_few_words", "n_words", 10, None, 0),
    ("repeated_windows", "repeat_ratio", None, 0.20, 0),
    ("word_length", "mean_word_length", 1.5, 20.0, 10),
    ("symbols", "symbol_ratio", None, 0.10, 10),
    ("exclamation", "exclamation_ratio", None, 0.25, 10),
    ("few_stop_words", "stop_ratio", 0.01, None, 50),
    ("repeated_lines", "dup_line_ratio", None, 0.50, 10),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.30, 10),
    ("bullet_lines", "bullet_line_ratio", None, 0.90, 10),
]


def _windows(w: Column, n: Column, width: int, build) -> Column:
    """``build`` of every run of ``width`` consecutive words."""
    def run(i):
        return build(*[F.get(w, i + k) for k in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), run))


def _covered(positions: Column, width: int) -> Column:
    """Words inside windows of ``width`` that start at the ascending ``positions``."""
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(positions, start, lambda a, p: F.struct(
        p.alias("last"), (a["total"] + F.least(F.lit(width), p - a["last"])).alias("total")), lambda a: a["total"])


def measures(df: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """Counts and ratios of every text beside the columns of ``df``.

    Null and empty texts have zero counts and ratios. A repeated window of ``width`` words counts
    its words once per occurrence place, the first occurrence included.
    """
    body = whole(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({"_pieces": F.split(blanks_alike(body), " "), "_lines": lines})
    out = out.withColumn("_w", F.array_remove("_pieces", ""))
    out = out.withColumn("_n", F.size("_w"))
    # Texts without an equal pair of window hashes have no equal windows; only the others compare the windows themselves.
    out = out.withColumn("_hashes", _windows(F.col("_w"), F.col("_n"), width, F.xxhash64))
    out = out.withColumn("_again", F.size("_hashes") > F.size(F.array_distinct("_hashes")))
    win = _windows(F.col("_w"), F.col("_n"), width, lambda *x: F.concat_ws(" ", *x))
    again = F.coalesce("_again", F.lit(False))
    out = out.withColumn("_sorted", F.when(again, F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))

    def same(s: Column, k: Column) -> Column:
        return F.coalesce(F.get("_sorted", k)["x"] == s["x"], F.lit(False))

    twice = F.filter("_sorted", lambda s, k: same(s, k - 1) | same(s, k + 1))
    out = out.withColumn("_repeat", F.coalesce(F.when(again, _covered(F.sort_array(F.transform(twice, lambda s: s["i"])), width)),
                                               F.lit(0).cast("long")))
    n, n_lines = F.col("_n"), F.size("_lines")
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(body) - F.size("_pieces") + 1).cast("long"),
        "n_symbols": count_chars(body, SYMBOLS).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.col("_repeat"),
        "_stops": F.size(F.filter("_w", lambda w: w.isin(STOP_WORDS + [x.capitalize() for x in STOP_WORDS]))),
        "_exclaimed": count_chars(body, "!"),
        "_ellipses": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        "_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•·]\s"))),
    })
    return out.withColumns({
        "repeat_ratio": ratio(F.col("n_repeat_words"), n),
        "mean_word_length": ratio(F.col("word_chars"), n),
        "symbol_ratio": ratio(F.col("n_symbols"), n),
        "exclamation_ratio": ratio(F.col("_exclaimed"), n),
        "stop_ratio": ratio(F.col("_stops"), n),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), n_lines),
        "ellipsis_line_ratio": ratio(F.col("_ellipses"), n_lines),
        "bullet_line_ratio": ratio(F.col("_bullets"), n_lines),
    }).drop("_pieces", "_w", "_lines", "_n", "_hashes", "_again", "_sorted", "_repeat", "_stops", "_exclaimed", "_ellipses", "_bullets")


def failed_rules(rules=None) -> Column:
    """Names of the rules a measured row breaks, in the order of the table."""
    def broken(name, measure, low, high, least):
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(measure) < low)
        if high is not None:
            bad = bad | (F.col(measure) > high)
        return F.when(bad & (F.col("n_words") >= least), F.lit(name))
    return F.array_compact(F.array(*[broken(*rule) for rule in (rules or RULES)]))


def judge(df: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """:func:`measures` with ``failed`` (rules broken), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated windows; such rows are never kept.
    """
    out = measures(df, text).withColumn("failed", failed_rules(rules))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep_good(df: DataFrame, text: str = "text", rules=None) -> DataFrame:
    """Rows of ``df`` that pass, with the columns of ``df`` (whatever their names are)."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), whole(f"`{text}`").alias("_text"))
    # A filter would be pushed down through the measures and repeat them in its condition; an array of no or one row is not.
    return judge(row, "_text", rules).select(F.inline(F.when(F.col("kept"), F.array("_row")).otherwise(F.slice(F.array("_row"), 1, 0))))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def rules_sql(rules=None) -> str:
    """The threshold table as a condition over the measures."""
    tests = []
    for _, measure, low, high, least in rules or RULES:
        bad = [f"{measure} < {low}"] * (low is not None) + [f"{measure} > {high}"] * (high is not None)
        tests.append(f"(n_words >= {least} AND ({' OR '.join(bad)}))")
    return f"NOT ({' OR '.join(tests)})"


def sql(source: str = "documents") -> str:
    stops = ", ".join(f"'{x}'" for w in STOP_WORDS for x in (w, w.capitalize()))
    per = "CASE WHEN {1} > 0 THEN {0}::DOUBLE / {1} ELSE 0 END".format
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {source}),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
    twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, x HAVING count(*) > 1),
    covered AS (SELECT doc_id, count(DISTINCT k) AS c FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({stops}))) AS stops,
             len(regexp_extract_all(t, '!')) AS bangs, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dots,
             len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•·]\s'))) AS bullets
          FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id),
    r AS (SELECT *, {per("n_repeat_words", "n_words")} AS repeat_ratio, {per("word_chars", "n_words")} AS mean_word_length,
             {per("n_symbols", "n_words")} AS symbol_ratio, {per("bangs", "n_words")} AS exclamation_ratio, {per("stops", "n_words")} AS stop_ratio,
             {per("n_dup_lines", "n_lines")} AS dup_line_ratio, {per("dots", "n_lines")} AS ellipsis_line_ratio,
             {per("bullets", "n_lines")} AS bullet_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT {", ".join(COLUMNS[:-1])}, NOT base_failed AND {rules_sql()} AS kept FROM r"""


@query("op10_quality_rules", sql())
def op10(spark, read):
    return judge(read("documents").select("doc_id", "text")).select(*COLUMNS)
