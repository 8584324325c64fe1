"""Decontamination, license scans and HTML extraction: against plain Python, and over odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from workgraph.llm import decontamination, html_text, license_scan
from workgraph.llm.registry import settings
from workgraph.llm.tokens import ALNUM, word_hashes


@pytest.fixture(scope="module", autouse=True)
def _settings(spark):
    settings(spark)


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, n=10):
    words = plain_words(text)
    hit, found = set(), set()
    for item, own in items:
        own = plain_words(own)
        width = min(n, len(own))
        windows = {tuple(own[i:i + width]) for i in range(len(own) - width + 1)} if width else set()
        for i in range(len(words) - width + 1):
            if tuple(words[i:i + width]) in windows:
                hit |= set(range(i, i + width))
                found.add(str(item))
    return len(words), len(hit), found


def made(seed=1):
    rng = random.Random(seed)
    pool = [f"wörd{i}" for i in range(12)] + ["The", "of"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 9, 10, 11, 30]))) for i in range(12)] + [(12, None), (13, "..."), (3, text(14)), (None, "lost of words")]
    docs = [(i, text(rng.randint(0, 60)) + "; " + (rng.choice(items)[1] or "") + "! " + text(rng.randint(0, 30))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "?!"), (0, items[5][1]), (None, items[7][1])]
    return docs, items


def test_windows_match_plain_search_in_any_number_of_blocks(spark):
    docs, items = made()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(1))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit(2)})
    known = [x for x in items if x[0] is not None]
    for limit in (decontamination.BLOCK_WINDOWS, 17):
        got = decontamination.scan(df, bench, block_windows=limit).collect()
        assert len(got) == len(docs)
        want = sorted(((d, *plain_hits(t, known)) for d, t in docs), key=str)
        assert sorted(((r["doc_id"], r["n_words"], sum(b - a for a, b in r["runs"]), set(r["items"])) for r in got), key=str) == want
    digest = {r["doc_id"]: r for r in decontamination.report(df.filter("doc_id > 0"), bench).collect()}
    for d, t in docs[1:60]:
        total, hit, found = plain_hits(t, known)
        assert digest[d]["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (digest[d]["n_hit"], digest[d]["n_items"], digest[d]["contaminated"]) == (hit, len(found), hit > 0)


def test_long_texts_are_read_in_pieces(spark):
    item = " ".join(f"x{i}" for i in range(25))
    text = "filler words " * 90_000 + item + " more " * 120_000 + item[:60]
    total, runs, found = decontamination.Grams([(1, item.encode().split())], 10).scan(iter([text.encode().split()[i:i + 997] for i in range(0, 400_000, 997)]))
    assert found == {1} and runs.tolist()[0] == [180_000, 180_025]
    row = decontamination.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).head()
    assert row["n_words"] == len(plain_words(text)) and row["runs"][0] == [180_000, 180_025]


def test_removal_cuts_passages_and_drops_mostly_hit_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "Before, this stays. " + item.upper() + " And after that it goes on and on.", "x"), (2, item, "x"), (3, "nothing here", "x"), (4, None, "x"), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontamination.remove_contaminated(df, bench).collect()}
    assert out == {1: "Before, this stays.  And after that it goes on and on.", 3: "nothing here", 4: None, 5: ""}
    assert decontamination.remove_contaminated(df, bench.limit(0)).count() == 5
    assert decontamination.remove_contaminated(df.limit(0), bench).count() == 0
    assert decontamination.scan(df, bench.limit(0)).filter("size(runs) > 0").count() == 0


def test_removal_does_not_depend_on_the_number_of_blocks(spark):
    docs, items = made(2)
    first, second, third = ([f"{c}{i}" for i in range(12)] for c in "pqr")
    lap = first[6:] + second[:6]
    items += [(20, " ".join(first)), (21, " ".join(second)), (22, " ".join(third)), (23, " ".join(lap)), (24, " ".join(["left"] * 5 + ["right"] * 5))]
    docs += [(70, " ".join(first + ["own"] * 16 + second)), (71, " ".join(first + second + ["own"] * 40)),
             (72, " ".join(["left"] * 5 + first + ["right"] * 5 + ["own"] * 20))]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(1).sortWithinPartitions("item_id")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1))
    known = [x for x in items if x[0] is not None]
    out = [sorted(((r["doc_id"], r["text"]) for r in decontamination.remove_contaminated(df, bench, **more).collect()), key=str) for more in ({}, {"block_windows": 17})]
    assert out[0] == out[1]
    kept = dict(out[1])
    assert 70 not in kept and len(plain_words(kept[71])) == 40 and plain_words(kept[72]) == ["left"] * 5 + ["right"] * 5 + ["own"] * 20
    for d, t in docs:
        total, hit, _ = plain_hits(t, known)
        assert ((d, t) in out[1] if not hit else 2 * hit > total or any(e == d and len(plain_words(u)) == total - hit for e, u in out[1]))


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_alignment_of_changed_templates_is_the_best_one():
    rng = random.Random(3)
    index = license_scan.Index(license_scan.TEMPLATES)
    for _ in range(60):
        name = rng.choice(["MIT", "ISC", "GPL-3.0", "MPL-2.0"])
        words = license_scan.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(words))
            words[p:p + rng.randint(0, 1)] = [f"zz{rng.randrange(99)}"] * rng.randint(0, 1)
        before = [f"pre{rng.randrange(50)}" for _ in range(rng.randint(0, 40))]
        text = " ".join(before + words + ["after"] * rng.randint(0, 30))
        found = [m for m in license_scan.scan_text(text, index) if m[0] == name]
        own = index.words[index.names.index(name)]
        assert len(found) == 1 and found[0][2] == lcs(word_hashes(text, ALNUM).tolist(), own.tolist())
        assert found[0][1] == found[0][2] / len(own) and found[0][3] >= len(before)


def test_license_scan_of_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(1, line), (1, line), (2, None), (3, ""), (None, "x " * 50_000 + line + " y" * 50_000), (4, "the MIT the MIT the"), (5, line + " and " + line), (6, line[:12])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(0))
    got = sorted(((r["doc_id"], [(m["template"], m["begin"], m["end"], m["coverage"]) for m in r["matches"]]) for r in license_scan.scan(df).collect()), key=str)
    hit = lambda a: ("MIT-line", a, a + 5, 1.0)
    assert got == sorted([(1, [hit(0)]), (1, [hit(0)]), (2, []), (3, []), (None, [hit(50_000)]), (4, []), (5, [hit(0), hit(6)]), (6, [])], key=str)
    assert license_scan.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.Index({"x": "a " * (license_scan.MAX_TEMPLATE_WORDS + 1)})


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy!</div><article><h1>Head &amp;  line</h1>
<p>One <b>two</b>\n three&nbsp;four.<br>five<aside>side</aside><div class="share-buttons">share</div><p>six &lt;b&gt; <i>s</i>even
<ul><li>x<li>y</ul><form><p>mail</p></form><section id="comments"><p>Nice post</p></section><p>last &am</article><footer>&copy; F</footer></body></html>"""


@pytest.mark.parametrize("page, want", [
    (ARTICLE, "Head & line\nOne two three four.\nfive\nsix <b> seven\nx\ny\nlast &am"),
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b</p>c", "a\nb\nc"), ("<article><p>cut of<di", "cut of"), ("<script>x", ""), ("a < b &lt; c", "a < b < c"),
    ("<main><p>m</p></main><article><p>other and longer</p></article>", "m"),
    ("<div><a href=x>Home</a></div><p>Body text of the page.</p><p>More.</p><div><a>Next page</a></div>", "Body text of the page.\nMore."),
    ("<p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><p>yes</p>", "yes"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_extraction_keeps_rows_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph number {i}</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", long)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(df).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "1", "2", "None"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r for r in got if r["page_id"] is None)["text"].count("\n") == 19_999
    assert html_text.extract(df.limit(0)).count() == 0


BOX = '<div class="newsletter"><p>Sign up!</p><p>Your mail</p><p>Send it now, it is free and it comes each week with more of the same</p></div>'
LINKS = "<ul><li><a>Ref 1</a></li><li><a>Ref 2</a></li><li><a>Ref 3</a></li></ul>"


@pytest.mark.parametrize("page, want", [
    (f"<div><p>First part.</p>{BOX}<p>Second part, longer.</p></div>", "First part.\nSecond part, longer."),
    (f"<p>First part.</p>{BOX}<p>Second part, longer.</p>{BOX}", "First part.\nSecond part, longer."),
    (f"<div><p>First part.</p>{LINKS}<p>Second part, longer.</p></div>", "First part.\nRef 1\nRef 2\nRef 3\nSecond part, longer."),
    (f"<p>First part.</p>{LINKS}<p>Second part, longer.</p>", "First part.\nRef 1\nRef 2\nRef 3\nSecond part, longer."),
    (f"<div><h1><a>Linked title</a></h1><p>First part.</p><p>Second part.</p>{LINKS}</div>", "Linked title\nFirst part.\nSecond part.\nRef 1\nRef 2\nRef 3"),
    (f"<div><div><p>First part.</p></div><div><p>More of it.</p></div>{LINKS}<div><p>Last.</p></div></div>", "First part.\nMore of it.\nRef 1\nRef 2\nRef 3\nLast."),
    (f"<div>My site</div><div>{LINKS}</div><div><p>The text of the page.</p><p>More.</p></div><div>{LINKS}</div><div>Imprint</div>", "The text of the page.\nMore."),
])
def test_boxes_and_links_in_mid_article_break_nothing(page, want):
    assert html_text.main_text(page) == want
    assert html_text.main_text(f"<html><body>{page}</body></html>") == want




@pytest.mark.parametrize("page, want", [
    *[(f"<div class='{c}'><{e}><h1>Title</h1><p>Text.</p></{e}></div>", "Title\nText.")
      for c in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-comments", "site sidebar", "widget") for e in ("article", "main")],
    *[(f"<div class='{c}'><p>Text.</p><p>More.</p></div>", "Text.\nMore.") for c in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-comments")],
    ("<article><div class='article-header'><h1>Title</h1></div><p>Text.</p><section id='related-work'><p>Others.</p></section>"
     "<section id=notice-period><p>Three months.</p></section></article>", "Title\nText.\nOthers.\nThree months."),
    *[(f"<article><p>Text.</p><div class='{c}'><p>Not this.</p></div><p id='{c}'>Nor this.</p></article>", "Text.")
      for c in ("ad", "ad-300x250", "share-buttons", "siteFooter", "left-sidebar", "sidebar-left", "comments-area", "comment-17", "related-posts", "big cookie_notice")],
    ("<article><p>Short.</p><div class=comments><article><p>A long comment on it.</p></article></div></article>", "Short."),
    ("<article><p>Short.</p></article><div class=comments><article><p>A long comment on it.</p></article></div>", "Short."),
    ("<aside><article><p>No.</p></article></aside><div hidden><main>No.</main></div><p>Text.</p>", "Text."),
])
def test_class_names_set_apart_by_role_only(page, want):
    assert html_text.main_text(page) == want
