"""Evaluation queries: documents as model outputs, benchmark items as cases, document lines as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from workgraph.functions import text as T
from workgraph.operators import evaluation as O
from workgraph.plans.registry import query

_KIND = "CASE {0} % 5 WHEN 0 THEN 'behavior' WHEN 1 THEN 'refactor' WHEN 2 THEN 'rename' WHEN 3 THEN 'test' ELSE 'config' END"


def _cases(t):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    return t.benchmark.select(
        F.col("item_id").alias("case_id"), F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit(".go")).alias("path"),
        F.col("text").alias("hunk"), F.lit("func load_doc").alias("enclosing_function"),
        F.expr(_KIND.format("(item_id + floor(item_id / 7))")).alias("expected_kind"), F.slice(words, 1, 3).alias("expected_symbols"),
        F.lit(3).alias("added_lines"), F.lit(1).alias("removed_lines"), F.col("text").alias("facts"))


def _outputs(t):
    return t.eval_outputs.withColumn("inferred_why", F.lit("")).withColumn("impact", F.lit(""))


_SCORE = r"""cs AS (SELECT item_id AS case_id, 'b' || item_id || '.go' || chr(10) || text || chr(10) || 'func load_doc' AS hay,
    """ + _KIND.format("(item_id + CAST(floor(item_id / 7) AS BIGINT))") + r""" AS want, regexp_extract_all(text, '[A-Za-z]+')[1:3] AS syms FROM benchmark),
jn AS (SELECT o.*, c.hay, c.want, c.syms, list_distinct(list_transform(list_filter(regexp_extract_all(o.what, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(\)?)?'),
      lambda x: regexp_matches(x, '[_.]|^.+[A-Z]|\(\)?$')), lambda x: regexp_replace(regexp_replace(x, '\)$', ''), '\($', ''))) AS cand,
    regexp_extract(o.what, '\+(\d+)\s*/\s*[-−](\d+)', 1) AS g1, regexp_extract(o.what, '\+(\d+)\s*/\s*[-−](\d+)', 2) AS g2 FROM eval_outputs o JOIN cs c USING (case_id)),
sc0 AS (SELECT *, len(list_filter(cand, lambda x: NOT contains(hay, x))) AS bad, len(list_filter(syms, lambda x: contains(what, x))) AS found FROM jn),
sc AS (SELECT output_id, case_id, model, variant, json_valid, latency_ms, completion_tokens, json_valid AND kind = want AS kind_match,
    CASE WHEN json_valid THEN len(cand) ELSE 0 END AS candidates, CASE WHEN json_valid THEN bad ELSE 0 END AS hallucinated,
    json_valid AND g1 <> '' AS counts_mentioned, json_valid AND g1 = '3' AND g2 = '1' AS counts_correct,
    CASE WHEN NOT json_valid THEN 0 ELSE 0.30 * CASE WHEN kind = want THEN 1 ELSE 0 END + 0.35 * CASE WHEN len(cand) > 0 THEN 1 - bad / len(cand) ELSE 1 END
      + 0.25 * CASE WHEN len(syms) > 0 THEN found / len(syms) ELSE 1 END + 0.10 * CASE WHEN g1 = '' OR (g1 = '3' AND g2 = '1') THEN 1 ELSE 0 END END AS score FROM sc0)"""


@query("score_cases", "WITH " + _SCORE + """ SELECT output_id, kind_match, candidates, hallucinated, counts_mentioned, counts_correct, round(CAST(score AS DOUBLE), 6) AS score FROM sc""")
def score_cases(t):
    return O.score_cases(_cases(t), _outputs(t)).select(
        "output_id", "kind_match", F.size("candidates").cast("long").alias("candidates"), F.size("hallucinated").cast("long").alias("hallucinated"),
        "counts_mentioned", "counts_correct", F.round("score", 6).alias("score"))


@query("summarize_models", "WITH " + _SCORE + """ SELECT model, variant, count(*) AS cases, round(CAST(avg(score) AS DOUBLE), 6) AS mean_score,
    round(avg(CASE WHEN kind_match THEN 1.0 ELSE 0 END), 6) AS kind_accuracy, round(coalesce(sum(hallucinated) / nullif(sum(candidates), 0), 0), 6) AS hallucination_rate,
    round(avg(CASE WHEN json_valid THEN 1.0 ELSE 0 END), 6) AS json_rate, round(avg(latency_ms), 6) AS mean_latency_ms,
    round(sum(completion_tokens) / sum(latency_ms) * 1000, 6) AS tokens_per_second FROM sc GROUP BY 1, 2""")
def summarize_models(t):
    out = O.summarize_models(O.score_cases(_cases(t), _outputs(t)), ["model", "variant"])
    return out.select("model", "variant", "cases", *[F.round(c, 6).alias(c) for c in [
        "mean_score", "kind_accuracy", "hallucination_rate", "json_rate", "mean_latency_ms", "tokens_per_second"]])


def _raw_outputs(t):
    kind = F.expr("CASE doc_id % 6 WHEN 5 THEN 'poem' WHEN 0 THEN 'behavior' WHEN 1 THEN 'refactor' WHEN 2 THEN 'rename' WHEN 3 THEN 'test' ELSE 'config' END")
    doc = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(kind.alias("kind"), F.col("text").alias("behavior")))) \
        .otherwise(F.to_json(F.struct(kind.alias("kind"), F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise("").alias("what"))))
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), doc, F.lit("\n```\n"))).otherwise(doc)
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Sure: "), doc)).otherwise(fenced).alias("output"))


@query("valid_output", """SELECT doc_id, doc_id % 7 <> 0 AND doc_id % 6 <> 5 AND (doc_id % 4 = 0 OR doc_id % 9 <> 0) AS json_valid,
    CASE WHEN doc_id % 7 <> 0 AND (doc_id % 4 = 0 OR doc_id % 9 <> 0) THEN text ELSE '' END AS what FROM documents""")
def valid_output(t):
    return O.valid_output(_raw_outputs(t)).select("doc_id", "json_valid", "what")


@query("clean_json", """SELECT doc_id, '{"a": "' || lang || '"}' AS out FROM documents""")
def clean_json(t):
    doc = F.concat(F.lit('{"a": "'), "lang", F.lit('"}'))
    raw = F.expr("CASE doc_id % 3 WHEN 0 THEN '```json\\n' WHEN 1 THEN '  ```\\n' ELSE '\\n' END")
    tail = F.expr("CASE doc_id % 3 WHEN 2 THEN '  ' ELSE '\\n```\\n' END")
    return t.documents.select("doc_id", T.clean_json(F.concat(raw, doc, tail)).alias("out"))


@query("valid_finding", """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'not JSON' WHEN event_type = 'signup' THEN 'title is missing or has the wrong type'
    WHEN event_type = 'error' THEN 'severity is not an allowed word' WHEN value / 100 > 1 THEN 'confidence is not within 0..1'
    WHEN event_id % 5 = 0 THEN 'evidence is incomplete' END AS reason FROM events""")
def valid_finding(t):
    word = F.expr("CASE event_type WHEN 'error' THEN 'fatal' WHEN 'view' THEN 'low' ELSE 'high' END")
    title = F.when(F.col("event_type") != "signup", F.col("event_type"))
    line = F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("int"))
    doc = F.to_json(F.struct(word.alias("severity"), title.alias("title"), F.lit("because").alias("explanation"),
                             F.array(F.struct(F.lit("a.go").alias("path"), line.alias("line"), F.col("props").alias("excerpt"))).alias("evidence"),
                             (F.col("value") / 100).alias("confidence")))
    rows = t.events.select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat(doc, F.lit("}"))).otherwise(doc).alias("finding"))
    return O.valid_finding(rows).select("event_id", "reason")


def _evidence(t):
    """Every line quoted whole, cited up to three lines off; a finding is a run of four lines."""
    return t.doc_lines.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.floor((F.col("line") - 1) / 4).cast("string")).alias("finding_id"),
        F.col("line").alias("ev_no"), (F.col("doc_id") % 3).cast("int").alias("repo_id"),
        F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string")).alias("path"),
        (F.col("line") + (F.col("doc_id") % 7 - 3)).cast("int").alias("line"), F.col("text").alias("excerpt"))


_EV = """ev AS (SELECT doc_id || '-' || CAST(floor((line - 1) / 4) AS BIGINT) AS finding_id, line AS ev_no, doc_id, line + doc_id % 7 - 3 AS cited, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS want FROM doc_lines),
hit AS (SELECT e.finding_id, e.ev_no, l.line, row_number() OVER (PARTITION BY e.finding_id, e.ev_no ORDER BY abs(l.line - e.cited), CASE WHEN l.line > e.cited THEN 0 ELSE 1 END) AS rn
    FROM ev e JOIN doc_lines l ON l.doc_id = e.doc_id AND abs(l.line - e.cited) <= 2 WHERE e.want <> '' AND contains(regexp_replace(l.text, '^\\s+|\\s+$', '', 'g'), e.want)),
loc AS (SELECT e.*, h.line AS found_line FROM ev e LEFT JOIN hit h ON h.finding_id = e.finding_id AND h.ev_no = e.ev_no AND h.rn = 1)"""


def _file_lines(t):
    """Documents as files; three repositories have files of the same names."""
    return t.doc_lines.select((F.col("doc_id") % 3).cast("int").alias("repo_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string")).alias("path"), "line", "text")


@query("locate_evidence", "WITH " + _EV + " SELECT finding_id, ev_no, found_line FROM loc")
def locate_evidence(t):
    return O.locate_evidence(_evidence(t), _file_lines(t)).select("finding_id", "ev_no", "found_line")


@query("verify_evidence", "WITH " + _EV + """ SELECT finding_id, count(found_line) > 0 AS verified, CASE WHEN count(found_line) > 0
    THEN 'verified ' || count(found_line) || '/' || count(*) || ' evidence line(s)' ELSE 'rejected: ' || string_agg('d' || CAST(floor(doc_id / 3) AS BIGINT) || ':' || cited ||
      CASE WHEN want = '' THEN ': empty excerpt' ELSE ': excerpt not found within +/-2 lines' END, '; ' ORDER BY ev_no) END AS verification FROM loc GROUP BY 1""")
def verify_evidence(t):
    evidence = _evidence(t)
    return O.verify_evidence(evidence.select("finding_id").distinct(), evidence, _file_lines(t))


def _findings(t):
    return t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("verified"))


_CAP = """fn AS (SELECT user_id AS run_id, event_id AS seq, event_type <> 'error' AS verified FROM events),
cp AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS number FROM fn WHERE verified)"""


@query("cap_findings", "WITH " + _CAP + " SELECT run_id, seq, number, run_id || '-' || number AS number_id FROM cp WHERE number <= 20")
def cap_findings(t):
    return O.cap_findings(_findings(t), 20).select("run_id", "seq", F.col("number").cast("long").alias("number"), "number_id")


@query("run_counts", "WITH " + _CAP + """, ls AS (SELECT run_id, count(*) AS emitted, max(seq) AS last FROM cp WHERE number <= 20 GROUP BY 1)
SELECT f.run_id, max(ls.emitted) AS emitted, count(CASE WHEN NOT f.verified AND (ls.emitted < 20 OR f.seq <= ls.last) THEN 1 END) AS rejected FROM fn f JOIN ls USING (run_id) GROUP BY 1""")
def run_counts(t):
    return O.run_counts(_findings(t), 20)


@query("blind_judging_set", """SELECT o.case_id, row_number() OVER (PARTITION BY o.case_id ORDER BY sha1('42|' || o.case_id || '|' || o.model || ' @ ' || o.variant || '|' || o.output_id), o.output_id) AS slot,
    o.what AS text, o.kind, o.model || ' @ ' || o.variant AS label, b.text AS facts FROM eval_outputs o JOIN benchmark b ON b.item_id = o.case_id""")
def blind_judging_set(t):
    return O.blind_judging_set(_cases(t).select("case_id", "path", "facts"), _outputs(t)).select("case_id", "slot", "text", "kind", "label", "facts")


@query("looks_like_symbol", r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\(\)?)?'),
    lambda x: regexp_matches(x, '[_.]|^.+[A-Z]|\(\)?$'))) AS symbols FROM documents""")
def looks_like_symbol(t):
    tokens = F.regexp_extract_all("text", F.lit(T.SYMBOL_TOKEN), 0)
    return t.documents.select("doc_id", F.size(F.filter(tokens, lambda x: T.looks_like_symbol(x))).cast("long").alias("symbols"))
