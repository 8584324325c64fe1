"""Line-oriented markdown: blocks, tasks, links and HTML.

``lines`` is (doc_id, line, text) with dense lines. State that crosses lines
(code fences, block numbers) is carried by blocked scans; a block lies inside
one document cell, so its own lines may be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workgraph.functions import text as T
from workgraph.functions.ids import col
from workgraph.operators.scan import neighbour, running_total

D = ["doc_id"]
_HEAD = r"^(#{1,3})\s+(.*)"
_TASK = r"^\s*[-*]\s+\[([ xX])\]\s+(.*)"
_ITEM = r"^\s*[-*]\s+(.*)"
_NUMBERED = r"^\s*\d+[.)]\s+(.*)"
_LINK = r"\[([^\]]+)\]\((https?://[^\s)]+)\)"
_BARE = r"https?://[^\s<>\"]+"
_BARE_ESCAPED = r"https?://(?:(?!&lt;|&gt;|&quot;)[^\s])+"
_TAIL = r"[.,;:!?'\])]+$"


def line_kinds(lines: DataFrame) -> DataFrame:
    """Each line's kind and content, outside and inside code fences."""
    fence = F.startswith(F.trim("text"), F.lit("```"))
    rows = running_total(lines, D, "line", fence.cast("int"), "_fences", inclusive=False)
    inside = F.col("_fences") % 2 == 1
    get = lambda pattern, i: F.regexp_extract("text", pattern, i)
    kind = F.when(fence & inside, "close").when(fence, "code").when(inside, "line") \
        .when(F.col("text").rlike(_HEAD), F.concat(F.lit("h"), F.length(get(_HEAD, 1)).cast("string"))) \
        .when(F.col("text").rlike(_TASK), "task").when(F.col("text").rlike(_ITEM), "ul") \
        .when(F.col("text").rlike(_NUMBERED), "ol").when(F.trim("text") == "", "blank").otherwise("p")
    body = F.when(F.col("kind") == "line", F.col("text")).when(F.col("kind").isin("h1", "h2", "h3"), get(_HEAD, 2)) \
        .when(F.col("kind") == "task", get(_TASK, 2)).when(F.col("kind") == "ul", get(_ITEM, 1)) \
        .when(F.col("kind") == "ol", get(_NUMBERED, 1)).when(F.col("kind") == "p", F.trim("text")).otherwise(F.lit(""))
    done = F.when(F.col("kind") == "task", F.lower(get(_TASK, 1)) == "x")
    return rows.withColumn("kind", kind).withColumn("body", body).withColumn("done", done).drop("_fences")


def md_blocks(lines: DataFrame) -> DataFrame:
    """Blocks in order: (doc_id, block_no, kind, done, text, start_line, opens_list, closes_list).

    Neighbouring plain lines are one paragraph; a fence pair is one code block.
    ``opens_list`` and ``closes_list`` mark where a list item starts or ends its list.
    """
    rows = line_kinds(lines)
    list_kind = F.when(F.col("kind").isin("task", "ul"), "ul").when(F.col("kind") == "ol", "ol")
    rows = rows.withColumn("_list", list_kind)
    rows = neighbour(rows, D, "line", -1, {"kind": "_before", "_list": "_list_before"})
    rows = neighbour(rows, D, "line", 1, {"_list": "_list_after"})
    starts = F.col("kind").isin("h1", "h2", "h3", "task", "ul", "ol", "code") | \
        ((F.col("kind") == "p") & (F.coalesce("_before", F.lit("")) != "p"))
    rows = running_total(rows, D, "line", starts.cast("int"), "block_no").filter(~F.col("kind").isin("blank", "close"))
    grouped = rows.groupBy(*D, "block_no").agg(
        F.min("line").alias("start_line"), F.min_by("kind", "line").alias("kind"), F.max("done").alias("done"),
        F.max("_list").alias("_list"), F.max("_list_before").alias("_lb"), F.max("_list_after").alias("_la"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "code", F.struct("line", "body")))).alias("_l"))
    joint = F.when(F.col("kind") == "code", F.lit("\n")).otherwise(F.lit(" "))
    text = F.array_join(F.transform("_l", lambda l: l["body"]), "\n")
    text = F.when(joint == " ", F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(text)
    differs = lambda c: F.col("_list").isNotNull() & (F.coalesce(c, F.lit("")) != F.col("_list"))
    return grouped.select(*D, "block_no", "kind", "done", text.alias("text"), "start_line",
                          differs("_lb").alias("opens_list"), differs("_la").alias("closes_list"))


def md_tasks(blocks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'task'").select(*D, "block_no", "done", "text")


def task_progress(blocks: DataFrame) -> DataFrame:
    """Tasks, finished tasks and their share per document."""
    return md_tasks(blocks).groupBy(*D).agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("done"), 1)).alias("finished")) \
        .withColumn("ratio", F.col("finished") / F.col("tasks"))


def trim_url(url) -> Column:
    """A URL without trailing punctuation; a closing bracket stays when it closes one inside."""
    url = col(url)
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def shed(state, _):
        text = state["u"]
        last = F.right(text, F.lit(1))
        keep = ~last.rlike(r"[.,;:!?'\])]") | F.endswith(text, F.lit("&amp;")) | \
            ((last == ")") & (count(text, "(") >= count(text, ")")))
        stop = state["stop"] | keep
        return F.struct(F.when(stop, text).otherwise(F.left(text, F.length(text) - 1)).alias("u"), stop.alias("stop"))

    # Only as many steps as there is punctuation at the end.
    steps = F.sequence(F.lit(0), F.length(F.regexp_extract(url, _TAIL, 0)))
    return F.aggregate(steps, F.struct(url.alias("u"), F.lit(False).alias("stop")), shed)["u"]


def extract_links(texts: DataFrame, text: str = "text") -> DataFrame:
    """Links of each text: its columns plus (kind, n, label, url); kind is named or bare.

    Bare addresses are looked for in what named links leave over.
    """
    rest = F.regexp_replace(text, _LINK, "\u0000")
    named = texts.select("*", F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(_LINK), 1).alias("label"),
                                                        F.regexp_extract_all(text, F.lit(_LINK), 2).alias("url"))).alias("n", "_l")) \
        .select(*texts.columns, F.lit("named").alias("kind"), "n", "_l.label", "_l.url")
    bare = texts.select("*", F.posexplode(F.regexp_extract_all(rest, F.lit(_BARE), 0)).alias("n", "_u")) \
        .select(*texts.columns, F.lit("bare").alias("kind"), "n", trim_url("_u").alias("label"), trim_url("_u").alias("url"))
    return named.unionByName(bare)


def _anchor(href: Column, label: Column) -> Column:
    return F.concat(F.lit('<a href="'), href, F.lit('" target="_blank" rel="noopener noreferrer">'), label, F.lit("</a>"))


def _restore(text: Column, mark: str, rendered: Column) -> Column:
    """Put rendered pieces back where their marks stand."""
    gaps = F.split(text, mark, -1)
    pieces = F.concat(rendered, F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, pieces, lambda gap, piece: F.concat(gap, F.coalesce(piece, F.lit("")))), "")


def _spans(text, emphasis: bool) -> Column:
    """Escaped text with links, and with code and emphasis when asked; finished pieces are set aside meanwhile."""
    safe = T.html_escape(text)
    codes = F.regexp_extract_all(safe, F.lit(r"`([^`]+)`"), 1) if emphasis else F.array().cast("array<string>")
    step = F.regexp_replace(safe, r"`[^`]+`", "\u0001") if emphasis else safe
    links = F.transform(F.arrays_zip(F.regexp_extract_all(step, F.lit(_LINK), 1).alias("t"),
                                     F.regexp_extract_all(step, F.lit(_LINK), 2).alias("h")), lambda l: _anchor(l["h"], l["t"]))
    step2 = F.regexp_replace(step, _LINK, "\u0002")
    bare = F.transform(F.regexp_extract_all(step2, F.lit(_BARE_ESCAPED), 0), lambda u: F.concat(
        _anchor(trim_url(u), trim_url(u)), F.substring(u, F.length(trim_url(u)) + 1, F.length(u))))
    out = F.regexp_replace(step2, _BARE_ESCAPED, "\u0003")
    if emphasis:
        out = F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"\*([^*]+)\*", "<em>$1</em>")
    out = _restore(_restore(out, "\u0003", bare), "\u0002", links)
    return _restore(out, "\u0001", F.transform(codes, lambda c: F.concat(F.lit("<code>"), c, F.lit("</code>")))) if emphasis else out


def linkify(text) -> Column:
    """Escaped text with its links as anchors."""
    return _spans(text, emphasis=False)


def md_html(blocks: DataFrame) -> DataFrame:
    """HTML of every block in order: (doc_id, block_no, html); concatenated they are the document."""
    inner = _spans(F.col("text"), emphasis=True)
    box = F.when(F.col("done"), F.lit('<li class="task done"><input type="checkbox" disabled checked>')) \
        .otherwise(F.lit('<li class="task"><input type="checkbox" disabled>'))
    tag = lambda name: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    kind = F.when(F.col("kind") == "ol", F.lit("ol")).otherwise(F.lit("ul"))
    item = F.when(F.col("kind") == "task", F.concat(box, inner, F.lit("</li>"))).otherwise(tag("li"))
    item = F.concat(F.when(F.col("opens_list"), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(F.lit("")), item,
                    F.when(F.col("closes_list"), F.concat(F.lit("</"), kind, F.lit(">"))).otherwise(F.lit("")))
    html = F.when(F.col("kind") == "code", F.concat(F.lit("<pre>"), T.html_escape("text"), F.lit("</pre>"))) \
        .when(F.col("kind") == "h1", tag("h1")).when(F.col("kind") == "h2", tag("h2")).when(F.col("kind") == "h3", tag("h3")) \
        .when(F.col("kind") == "p", tag("p")).otherwise(item)
    return blocks.select(*D, "block_no", html.alias("html"))
