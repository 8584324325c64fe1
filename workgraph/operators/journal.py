"""Decision journals: entries parsed from lines, searched, dated and compared with the board.

``log_lines`` is (log_id, line, text) with dense 1-based lines. Every step
works on line rows and never gathers a journal, so one huge journal spreads
over many tasks; ``entries`` has one row per entry and ``entry_lines`` one per
line with the entry it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.functions import ids as X
from workgraph.operators.literals import literal_matches
from workgraph.operators.scan import carry_forward, first_per_key, neighbour, ranked, running_total, top_per_key
from workgraph.session import cut

L = "log_id"
_RULE = r"^(-{3,}|\*{3,}|_{3,})$"
_AMEND_LINE = r"(?i)^\s*(?:\*\*|__)?amend(?:ed|ment)?s?:(?:\*\*|__)?"
_AMEND_PROSE = "(?i)" + X.START + "amend(?:ed|ing|ment|ments|s)?" + X.END


def entry_lines(log_lines: DataFrame) -> DataFrame:
    """Every line with its role: (log_id, line, text, entry_no, part, in_heading).

    A heading starts an entry unless it is undated and directly follows a
    heading, when it continues that title. Lines before the first entry have
    entry 0. Trailing blanks and one trailing rule of each part are dropped,
    as are blanks after it.
    """
    rows = log_lines.withColumn("_head", F.startswith(F.col("text"), F.lit("## ")))
    rows = neighbour(rows, [L], "line", -1, {"_head": "_after_head"})
    wraps = F.col("_head") & F.coalesce("_after_head", F.lit(False)) & X.heading_date("text").isNull()
    rows = rows.withColumn("_starts", F.col("_head") & ~wraps)
    rows = cut(running_total(rows, [L], "line", F.col("_starts").cast("int"), "entry_no")
               .select(L, "line", "text", F.col("entry_no").cast("int").alias("entry_no"),
                       F.col("_head").alias("in_heading")))
    # The end of each part is its last line with text; if that is a rule, it goes too.
    body = rows.filter(~F.col("in_heading") & (F.trim("text") != ""))
    ends = body.groupBy(L, "entry_no").agg(F.max(F.struct("line", F.trim("text").rlike(_RULE).alias("rule"))).alias("e"))
    last = F.when(F.col("e.rule"), F.col("e.line") - 1).otherwise(F.col("e.line"))
    kept = rows.join(ends.select(L, "entry_no", last.alias("_last")), [L, "entry_no"], "left") \
        .filter(F.col("in_heading") | (F.col("line") <= F.col("_last"))).drop("_last")
    return kept


def parse_entries(lines: DataFrame) -> DataFrame:
    """One row per entry: number, first line, date, effective date, title, shape.

    ``lines`` comes from :func:`entry_lines`. The heading of one entry is the
    few lines of a wrapped title, joined in line order; body lines stay rows.
    """
    heads = lines.filter("in_heading AND entry_no > 0")
    own = heads.groupBy(L, "entry_no").agg(
        F.min("line").alias("line"), F.count(F.lit(1)).alias("heading_lines"),
        F.min_by("text", "line").alias("_first"),
        F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_heads"))
    title = X.heading_title("_first")
    rest = F.transform(F.expr("slice(_heads, 2, size(_heads))"), lambda h: X.heading_text(h["text"]))
    full = F.trim(F.concat_ws(" ", F.array(title), rest))
    bodies = lines.filter("NOT in_heading AND entry_no > 0").groupBy(L, "entry_no") \
        .agg(F.count(F.lit(1)).alias("body_lines"))
    rows = own.withColumn("date", X.heading_date("_first")).withColumn("title", full) \
        .withColumn("canonical", (F.col("heading_lines") == 1) & F.col("date").isNotNull() & (F.col("title") != "")
                    & (F.col("_first") == X.canonical_heading("date", "title"))) \
        .withColumn("canonical", F.coalesce("canonical", F.lit(False))).drop("_first", "_heads") \
        .join(bodies, [L, "entry_no"], "left").fillna(0, ["body_lines"])
    return effective_date(rows)


def effective_date(entries: DataFrame) -> DataFrame:
    """An undated entry takes the date of the nearest dated one above it; '' above the first."""
    rows = carry_forward(entries, [L], "entry_no", F.col("date"), "effective_date")
    return rows.withColumn("effective_date", F.coalesce("effective_date", F.lit("")))


def out_of_order(entries: DataFrame) -> DataFrame:
    """Dated entries older than the dated entry before them."""
    rows = carry_forward(entries, [L], "entry_no", F.col("date"), "previous_date", inclusive=False)
    return rows.filter(F.col("date") < F.col("previous_date"))


def log_since(entries: DataFrame, date: str) -> DataFrame:
    return entries.filter(F.col("effective_date") >= date)


def log_tail(entries: DataFrame, n: int) -> DataFrame:
    """The last n entries of each journal, all of them when n is not positive."""
    if n <= 0:
        return entries
    return top_per_key(entries, [L], [-F.col("entry_no")], n, "_place").drop("_place")


def log_search(lines: DataFrame, pattern: str, fixed: bool = False, match_case: bool = False) -> DataFrame:
    """Matching lines of entries with their line number and whether they are a heading."""
    inside = lines.filter("entry_no > 0")
    if fixed and match_case:
        return inside.filter(F.contains(F.col("text"), F.lit(pattern)))
    if fixed:
        return inside.filter(F.contains(F.lower("text"), F.lower(F.lit(pattern))))
    return inside.filter(F.col("text").rlike(pattern if match_case else "(?i)" + pattern))


def log_issue(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries naming an id however padded: (log_id, id, entry_no, in_heading, hits, place).

    ``wanted`` is (log_id, id). Tokens are reduced to one spelling and joined
    on it, so any number of ids costs one pass; a word that is not id-shaped is
    matched as written, on the lines that hold its rarest literal. Entries with
    the id in their heading come first.
    """
    shaped = wanted.filter(F.col("id").rlike(X.ID_SHAPE)).select(L, "id", X.log_id_key("id").alias("key"))
    odd = wanted.filter(~F.col("id").rlike(X.ID_SHAPE)).select(L, "id", X.log_id_regex("id").alias("pattern"))
    cols = [L, "id", "entry_no", "line", "in_heading"]
    named = id_tokens(lines, any_case=True).drop("id").join(shaped, [L, "key"]).select(*cols)
    worded = literal_matches(lines.filter("entry_no > 0"), odd, [L]).select(*cols)
    hits = named.unionByName(worded).groupBy(L, "id", "entry_no").agg(
        F.max("in_heading").alias("in_heading"), F.countDistinct("line").alias("hits"))
    return ranked(hits, [L, "id"], [F.when(F.col("in_heading"), 0).otherwise(1), F.col("entry_no")], "place")


def id_tokens(lines: DataFrame, any_case: bool = False) -> DataFrame:
    """Id-shaped tokens of entry lines: (log_id, entry_no, line, in_heading, prefix, id, key)."""
    pattern = ("(?i)" if any_case else "") + X.ID_PATTERN
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    rows = lines.filter("entry_no > 0").select(L, "entry_no", "line", "in_heading", F.explode(found).alias("id"))
    return rows.withColumn("prefix", F.substring_index("id", "-", 1)).withColumn("key", X.log_id_key("id"))


def log_amendments(lines: DataFrame, doc: str | None = None) -> DataFrame:
    """Amendment marker lines of entries, only entries naming ``doc`` in one if given."""
    marked = lines.filter((F.col("entry_no") > 0) & ~F.col("in_heading") & F.col("text").rlike(_AMEND_LINE))
    if doc:
        naming = marked.filter(F.contains(F.lower("text"), F.lit(doc.lower()))).select(L, "entry_no").distinct()
        marked = marked.join(naming, [L, "entry_no"], "left_semi")
    return marked


def loose_amendments(lines: DataFrame) -> DataFrame:
    """Per journal, entries that mention an amendment in prose without a marker line."""
    body = lines.filter((F.col("entry_no") > 0) & ~F.col("in_heading"))
    flags = body.groupBy(L, "entry_no").agg(F.max(F.col("text").rlike(_AMEND_LINE)).alias("marked"),
                                            F.max(F.col("text").rlike(_AMEND_PROSE)).alias("prose"))
    return flags.filter("prose AND NOT marked").groupBy(L).agg(F.count(F.lit(1)).alias("loose"))


def log_ids(lines: DataFrame) -> DataFrame:
    """Distinct ids per prefix with the line each first stands on."""
    return id_tokens(lines).groupBy(L, "prefix", "id").agg(F.min("line").alias("line"))


def prefix_counts(lines: DataFrame) -> DataFrame:
    return log_ids(lines).groupBy(L, "prefix").agg(F.count(F.lit(1)).alias("ids"))


def log_board_check(lines: DataFrame, entries: DataFrame, boards: DataFrame, issues: DataFrame, done_log: DataFrame,
                    since: str = "", strict: bool = False) -> DataFrame:
    """Disagreements between journals and boards: (log_id, kind, id, line, note, fatal).

    ``boards`` is (log_id, board_id, prefix). Ids that name nothing and
    finished issues nobody wrote up are fatal; shape and date problems only
    when ``strict``.
    """
    row = lambda kind, ident, line, note, fatal: [
        F.col(L), F.lit(kind).alias("kind"), ident.alias("id"), line.cast("int").alias("line"),
        note.alias("note"), F.lit(fatal).alias("fatal")]
    none = F.lit("")
    shape = entries.filter("date IS NOT NULL AND NOT canonical") \
        .select(*row("off-format", none, F.col("line"), F.col("title"), strict))
    undated = entries.filter("date IS NULL").select(*row("undated", none, F.col("line"), F.col("title"), strict))
    backwards = out_of_order(entries).select(*row(
        "out-of-order", none, F.col("line"), F.concat("date", F.lit(" follows "), "previous_date"), strict))
    ours = boards.select(L, "board_id", "prefix")
    ids = cut(log_ids(lines).join(ours, [L, "prefix"]).withColumn("key", X.log_id_key("id")))
    known = issues.select("board_id", X.log_id_key("id").alias("key")) \
        .unionByName(done_log.select("board_id", X.log_id_key("id").alias("key"))).distinct()
    nothing = ids.join(known, ["board_id", "key"], "left_anti").select(*row(
        "no such issue", F.col("id"), F.col("line"),
        F.lit("named in the log, on neither the board nor the done log"), True))
    cols = ["board_id", "id", "title", "updated_at"]
    finished = issues.filter("status = 'done'").select(*cols).unionByName(done_log.select(*cols))
    if since:
        finished = finished.filter(F.substring(F.col("updated_at").cast("string"), 1, 10) >= since)
    unlogged = finished.join(ours, "board_id").withColumn("key", X.log_id_key("id")) \
        .join(ids.select(L, "key").distinct(), [L, "key"], "left_anti") \
        .select(*row("unlogged", F.col("id"), F.lit(0), F.col("title"), True))
    return shape.unionByName(undated).unionByName(backwards).unionByName(nothing).unionByName(unlogged)
