"""Secret scans: fixed key shapes, and sliding-window entropy over other long strings.

Everything is one projection per row; nothing is shuffled and no user function runs. Positions are code points, ends
exclusive. Null and empty texts have no spans; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workgraph.llm.columns import whole
from workgraph.llm.registry import query

#: The base kinds in the order they are listed, with the fewest characters of the whole match (or of group 2).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
BASE = ["assign", "access", "hex"]

#: Candidate strings of the entropy scan, and the strings it leaves alone.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
ALLOWED = [r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0{8}",
           r"(?i)abcdefgh|12345678|qwertyui", r"^[A-Za-z_/-]+$", r"^[0-9=+/_-]+$", r"^/?([A-Za-z_-]+/)+[A-Za-z0-9_-]*$"]
#: Digests named as such just before the candidate.
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|integrity|commit)[\x20:=\"'-]{1,3}$"
#: The two of them that random strings meet as well; a strict scan asks for words between the separators instead.
LOOSE = [ALLOWED[3], ALLOWED[5]]
SEPARATORS = r"[/_-]+"
WORD = r"^([A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[A-Z]{0,6}[a-z]{2,19}([A-Z]{1,6}[a-z]{2,19}){1,12})?$"
WINDOW = 20
#: Bits per character that a window needs, by character class.
THRESHOLDS = {"entropy_hex": 2.95, "entropy_base64": 3.77}
KINDS = BASE + list(THRESHOLDS)


def _matches(df: DataFrame, body: str, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Columns ``_m_<name>`` (matches, left to right), ``_g_<name>`` (the texts between) and ``_v_<name>`` (a group of each)."""
    has = F.col(body).rlike(pattern)
    df = df.withColumn(f"_m_{name}", F.when(has, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))))
    some = F.col(f"_m_{name}").isNotNull()
    df = df.withColumn(f"_g_{name}", F.when(some, F.split(body, pattern)))
    return df.withColumn(f"_v_{name}", F.when(some, F.regexp_extract_all(body, F.lit(pattern), F.lit(group)))) if group else df


def _placed(name: str, kind: Column, value: Column | str) -> Column:
    """One struct per match: start, rank of its kind, end, kind, value."""
    found, gaps = F.col(f"_m_{name}"), F.col(f"_g_{name}")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string>>")

    def add(a: Column, i: Column) -> Column:
        start = a["pos"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(found, i))
        row = F.struct(start.alias("start"), F.lit(0).alias("rank"), end.alias("end"), kind.alias("kind"),
                       F.get(F.col(value), i).alias("value"), F.right(F.get(gaps, i), F.lit(16)).alias("before"))
        return F.struct(end.alias("pos"), F.concat(a["spans"], F.array(row)).alias("spans"))

    zero = F.struct(F.lit(0).alias("pos"), empty.alias("spans"))
    return F.when(found.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, add, lambda a: a["spans"])).otherwise(empty)


def _n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def surprising(value: Column, low: Column, window: int = WINDOW) -> Column:
    """First start and last end of the windows whose entropy reaches ``low``; ``first`` is -1 where there is none.

    The character counts of the window are carried along: one goes up, one goes down, and the sum of n log n follows.
    """
    n = F.length(value)
    width = F.lit(window)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def code(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substr(value, i + 1, F.lit(1))) - 1

    def step(a: Column, i: Column) -> Column:
        out = F.when(i >= width, code(i - width)).otherwise(F.lit(-1))
        lost = F.coalesce(F.get(a["counts"], out), F.lit(0))
        s = a["s"] - F.when(out >= 0, _n_log_n(lost) - _n_log_n(lost - 1)).otherwise(F.lit(0.0))
        after = F.transform(a["counts"], lambda c, k: F.when(k == out, c - 1).otherwise(c))
        came = F.get(after, code(i))
        s = s + _n_log_n(came + 1) - _n_log_n(came)
        counts = F.transform(after, lambda c, k: F.when(k == code(i), c + 1).otherwise(c))
        hit = (i >= width - 1) & (F.lit(math.log2(window)) - s / width >= low)
        return F.struct(counts.alias("counts"), s.alias("s"),
                        F.when(hit & (a["first"] < 0), i - width + 1).otherwise(a["first"]).alias("first"),
                        F.when(hit, i + 1).otherwise(a["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda a: F.struct(a["first"], a["last"]))


def _outside(x: Column) -> Column:
    """The parts (start, value, before) of a candidate between the base spans that touch it."""
    empty = F.array().cast("array<struct<start:int,value:string,before:string>>")

    def part(begin: Column, end: Column) -> Column:
        return F.struct(begin.alias("start"), F.substr(x["value"], begin - x["start"] + 1, F.greatest(end - begin, F.lit(0))).alias("value"),
                        F.when(begin == x["start"], x["before"]).otherwise(F.lit("")).alias("before"))

    def step(a: Column, b: Column) -> Column:
        return F.struct(F.greatest(a["pos"], F.least(b["end"], x["end"])).alias("pos"), F.concat(a["parts"], F.array(part(a["pos"], b["start"]))).alias("parts"))

    touching = F.filter("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return F.aggregate(touching, F.struct(x["start"].alias("pos"), empty.alias("parts")), step,
                       lambda a: F.concat(a["parts"], F.array(part(a["pos"], x["end"]))))


def _of_words(value: Column) -> Column:
    """Whether only words stand between the separators; the last part of a path may end in up to four digits."""
    plain = F.regexp_replace(value, F.lit(r"(/[A-Za-z]*)[0-9]{1,4}$"), F.lit("$1"))
    return F.forall(F.split(plain, SEPARATORS), lambda w: w.rlike(WORD))


def spans(df: DataFrame, text: str = "text", window: int = WINDOW, thresholds: dict[str, float] | None = None,
          allowed: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``df`` with ``base_spans`` and ``all_spans``: arrays of (start, rank, end, kind), by start, then kind as listed.

    An entropy span is added where it overlaps no base span and no allow-list pattern holds. With ``strict`` the parts of a
    candidate outside the base spans are scored where they fill a window, and of strings that look like a path or have no
    digits only those of words are left alone.
    """
    low = {**THRESHOLDS, **(thresholds or {})}
    out = df.withColumn("_body", whole(text))
    out = _matches(out, "_body", "assign", ASSIGN, 2)
    out = _matches(out, "_body", "access", ACCESS)
    out = _matches(out, "_body", "hex", HEX)
    out = _matches(out, "_body", "entropy", CANDIDATE)

    def plain(x: Column, rank: int) -> Column:
        return F.struct(x["start"], F.lit(rank).alias("rank"), x["end"], x["kind"])

    assign = F.filter(_placed("assign", F.lit("assign"), "_v_assign"), lambda x: F.length(x["value"]) >= LEAST_VALUE)
    out = out.withColumn("base_spans", F.sort_array(F.concat(
        F.transform(assign, lambda x: plain(x, 0)),
        F.transform(_placed("access", F.lit("access"), "_m_access"), lambda x: plain(x, 1)),
        F.transform(_placed("hex", F.lit("hex"), "_m_hex"), lambda x: plain(x, 2)))))
    candidates = _placed("entropy", F.lit(""), "_m_entropy")
    if strict:
        free = F.filter(F.flatten(F.transform(candidates, _outside)), lambda x: F.length(x["value"]) >= window)
    else:
        free = F.filter(candidates, lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.withColumn("_free", free)

    def suspicious(x: Column) -> Column:
        ok = ~x["before"].rlike(ALLOWED_BEFORE)
        for pattern in ALLOWED if allowed is None else allowed:
            if not (strict and pattern in LOOSE):
                ok = ok & ~x["value"].rlike(pattern)
        return ok & ~_of_words(x["value"]) if strict else ok

    out = out.withColumn("_free", F.filter("_free", suspicious))
    hexes = F.lit(r"^[0-9a-fA-F]+$")
    out = out.withColumn("_scored", F.transform("_free", lambda x: F.struct(
        x["start"].alias("start"), F.when(F.rlike(x["value"], hexes), F.lit(3)).otherwise(F.lit(4)).alias("rank"),
        surprising(x["value"], F.when(F.rlike(x["value"], hexes), F.lit(low["entropy_hex"])).otherwise(F.lit(low["entropy_base64"])), window).alias("at"))))
    kind = F.array(*[F.lit(k) for k in KINDS])
    more = F.transform(F.filter("_scored", lambda x: x["at"]["first"] >= 0), lambda x: F.struct(
        (x["start"] + x["at"]["first"]).alias("start"), x["rank"].alias("rank"), (x["start"] + x["at"]["last"]).alias("end"),
        F.get(kind, x["rank"]).alias("kind")))
    out = out.withColumn("all_spans", F.sort_array(F.concat("base_spans", more)))
    return out.drop("_body", "_free", "_scored", *[f"_{p}_{n}" for p in "mgv" for n in ("assign", "access", "hex", "entropy")])


def listed(column: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(df: DataFrame, text: str = "text") -> DataFrame:
    """:func:`spans` with counts per base kind, a digest of the base spans and all spans as one string."""
    out = spans(df, text)

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return out.withColumns({**{f"n_{k}": count(k) for k in BASE}, "base_sha256": F.sha2(listed("base_spans"), 256), "spans": listed("all_spans")})


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of its text (by a strict scan) replaced by ``mark``; overlapping spans are replaced together.
    Null stays null."""
    body = F.col(f"`{text}`")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), body.alias("_text"))
    found = spans(row, "_text", strict=True)
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def splice(a: Column, x: Column) -> Column:
        gap = F.substr(F.col("_text"), a["pos"] + 1, F.greatest(x["start"] - a["pos"], F.lit(0)))
        joined = (x["start"] < a["pos"]) & (a["pos"] > 0)
        return F.struct(F.greatest(a["pos"], x["end"]).alias("pos"),
                        F.when(joined, a["out"]).otherwise(F.concat(a["out"], gap, F.lit(mark))).alias("out"))

    clean = F.aggregate("all_spans", zero, splice, lambda a: F.concat(a["out"], F.substr(F.col("_text"), a["pos"] + 1, F.length("_text"))))
    found = found.withColumn("_clean", F.when(F.size("all_spans") > 0, clean).otherwise(F.col("_text")))
    return found.select(*[(F.col("_clean") if c == text else F.col("_row")[c]).alias(c) for c in df.columns])


COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def sql(source: str = "documents") -> str:
    """The same rows by positions summed up from the texts between the matches."""
    def found(name: str, pattern: str, rank: int, least: str = "TRUE") -> str:
        lit = pattern.replace("'", "''")
        return f"""{name} AS (SELECT doc_id, {rank} AS rank, '{KINDS[rank]}' AS kind, s AS start, s + length(v) AS stop, v, before FROM (
            SELECT doc_id, m[i] AS v, g[i] AS before, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
            FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(t, '{lit}') AS m, string_split_regex(t, '{lit}') AS g FROM d))) WHERE {least})"""
    group = ASSIGN.replace("'", "''")
    quiet = " AND ".join(f"NOT regexp_matches(v, '{p}')" for p in ALLOWED)
    before = ALLOWED_BEFORE.replace("'", "''")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
    {found("assign", ASSIGN, 0, f"length(regexp_extract(v, '{group}', 2)) >= {LEAST_VALUE}")},
    {found("access", ACCESS, 1)}, {found("hex", HEX, 2)}, {found("candidate", CANDIDATE, 3)},
    base AS (SELECT doc_id, rank, kind, start, stop FROM assign UNION ALL SELECT doc_id, rank, kind, start, stop FROM access
             UNION ALL SELECT doc_id, rank, kind, start, stop FROM hex),
    free AS (SELECT c.doc_id, c.start, v, regexp_matches(v, '^[0-9a-fA-F]+$') AS is_hex FROM candidate c WHERE {quiet}
             AND NOT regexp_matches(right(before, 16), '{before}')
             AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop)),
    windows AS (SELECT doc_id, start, is_hex, k, substr(v, k + 1, {WINDOW}) AS x
                FROM (SELECT *, unnest(range(0, length(v) - {WINDOW} + 1)) AS k FROM free)),
    counted AS (SELECT doc_id, start, is_hex, k, c, count(*) AS n
                FROM (SELECT doc_id, start, is_hex, k, unnest(string_split(x, '')) AS c FROM windows) GROUP BY ALL),
    judged AS (SELECT doc_id, start, is_hex, k, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h FROM counted GROUP BY ALL),
    extra AS (SELECT doc_id, CASE WHEN is_hex THEN 3 ELSE 4 END AS rank, CASE WHEN is_hex THEN '{KINDS[3]}' ELSE '{KINDS[4]}' END AS kind,
              start + min(k) AS start, start + max(k) + {WINDOW} AS stop
              FROM judged WHERE h >= CASE WHEN is_hex THEN {THRESHOLDS["entropy_hex"]} ELSE {THRESHOLDS["entropy_base64"]} END
              GROUP BY doc_id, judged.start, is_hex),
    lines AS (SELECT *, kind || ':' || start || ':' || stop AS line FROM (SELECT * FROM base UNION ALL SELECT * FROM extra)),
    per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
            string_agg(line, ',' ORDER BY start, rank) FILTER (rank < 3) AS b, string_agg(line, ',' ORDER BY start, rank) AS s FROM lines GROUP BY doc_id)
    SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
           sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN per USING (doc_id)"""


@query("op6_secret_scan", sql())
def op6(spark, read):
    return report(read("documents").select("doc_id", "text")).select(*COLUMNS)
