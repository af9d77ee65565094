import html
import json

import pytest
from pyspark.sql import functions as F

from sitecorpus.functions import markup
from sitecorpus.operators import extract, metadata, render, tokens
from sitecorpus.operators.extract import Options


def test_references(spark):
    texts = ["&copy 2024", "a &lt b &amp;lt; c", "&#169 x &#xA9y", "&#x41;&#66;", "&rarr;&hearts;", "&eacute", "no & ref", "&unknown; &", "&&&", "AT&T"]
    rows = spark.createDataFrame([(t,) for t in [*texts, "?a=1&copy=2", "&copying"]], "t string").select("t", markup.decoded("t").alias("d"), F.expr(markup.decoded_sql("t", loose=False)).alias("s"))
    got = {r.t: (r.d, r.s) for r in rows.collect()}
    assert {t: got[t][0] for t in texts} == {t: html.unescape(t) for t in texts}
    assert got["?a=1&copy=2"] == ("?a=1&copy=2",) * 2 and got["&copying"] == ("&copying",) * 2
    assert got["&copy 2024"][1] == "&copy 2024" and got["&#x41;&#66;"][1] == "AB"


SAMPLE = (
    '<html lang="en-GB"><head><title>Tea Notes</title><meta name="description" content="On leaves">'
    '<meta name="author" content="Ann Leaf"></head><body><header>Shop</header><main><h1>Green Tea</h1>'
    "<p>Pick the young leaves early, before noon.</p>"
    '<p>Then dry them; see <a href="/dry">how to</a>.</p></main><footer><p>Open daily</p></footer></body></html>'
)
SCHEMA = "page_id long, url string, html string"


def frame(spark, *bodies, url="https://example.com/dir/article"):
    return spark.createDataFrame([(i, url, b) for i, b in enumerate(bodies)], SCHEMA)


def contents(df):
    return [r.content for r in df.select("page_id", "content").orderBy("page_id").collect()]


def test_sample_page_in_all_formats(spark):
    df = frame(spark, SAMPLE)
    row = render.rendered_pages(df).first()
    assert row.content == (
        "## Green Tea\n\nPick the young leaves early, before noon.\n\n"
        "Then dry them; see [how to](https://example.com/dry).")
    assert (row.title, row.description, row.author, row.word_count) == ("Tea Notes", "On leaves", "Ann Leaf", 16)
    assert (row.domain, row.language, row.site, row.image) == ("example.com", "en-GB", None, None)
    html = contents(render.rendered_pages(df, "html"))[0]
    assert html.startswith("<main>") and "Green Tea" in html and "Open daily" not in html
    payload = json.loads(render.json_pages(df).first().json)
    assert list(payload) == ["content", "title", "description", "domain", "favicon", "image", "metaTags", "parseTime",
                             "published", "author", "site", "schemaOrgData", "wordCount"]
    assert payload["content"] == html and payload["title"] == "Tea Notes"
    assert payload["metaTags"][0] == {"name": "description", "property": None, "content": "On leaves"}
    assert render.page_property(df, "title").first().value == "Tea Notes"
    with pytest.raises(ValueError):
        render.page_property(df, "nothing")
    with pytest.raises(ValueError):
        render.rendered_pages(df, "pdf")


def test_tokens_of_broken_markup(spark):
    html = (
        '<p title="a > b" hidden>x &lt; y &amp;lt; &#8364;&#x1F600;&#0;&bogus; 1 < 2<script>var t = "</p><p>";</script>'
        "<!-- <b> --><style>b{}</style><IMG SRC=a.png><br/>end<template><i>no</i></template><b class='z"
    )
    got = [(r.kind, r.tag, r.text) for r in tokens.tokenize(frame(spark, html, "", None)).orderBy("page_id", "pos").collect()]
    assert got == [
        ("open", "p", ""), ("text", "", "x < y &lt; €😀�&bogus; 1 "), ("text", "", "<"), ("text", "", " 2"),
        ("void", "img", ""), ("void", "br", ""), ("text", "", "end")]
    attrs = tokens.tokenize(frame(spark, html)).where("tag = 'p'").select(
        markup.attribute("attr_list", "title").alias("t"), markup.attribute("attr_list", "hidden").alias("h"),
        markup.attribute("attr_list", "src").alias("s")).first()
    assert tuple(attrs) == ("a > b", "", None)


def test_named_references(spark):
    html = "<p title='&check;'>a &rarr; b, &alpha;&Alpha; &amp;rarr; &NotEqualTilde; &nothing; &copy; x</p>"
    got = tokens.tokenize(frame(spark, html)).orderBy("pos").select("text", markup.attribute("attr_list", "title").alias("t")).collect()
    assert got[0].t == "✓" and got[1].text == "a → b, αΑ &rarr; ≂̸ &nothing; © x"


def test_very_long_markup(spark):
    many = "<p " + " ".join(f'a{i}="{i}>"' for i in range(30000)) + ">text of the page, long enough.</p>"
    flat = "<" * 200000
    wide = "<div>" * 3000 + "deep down, there is some text to be read here." + "</div>" * 3000
    unclosed = "<!--" + "x" * 300000
    got = contents(render.rendered_pages(frame(spark, many, flat, wide, unclosed), "markdown", Options(remove_low_scoring=False)))
    assert got[0] == "text of the page, long enough."
    assert got[1] == flat and got[2] == "deep down, there is some text to be read here." and got[3] is None


def test_spans(spark):
    html = "<div></b><div><b>x<b>y</b></div></i><p>one<p>two</p></div></div><ul><li>a<li>b</ul><hr><section>"
    got = {(r.tag, r.pos): r.span_end for r in tokens.with_spans(tokens.tokenize(frame(spark, html))).where("span_end is not null").collect()}
    kinds = [(r.pos, r.tag, r.kind) for r in tokens.tokenize(frame(spark, html)).orderBy("pos").collect()]
    last = kinds[-1][0]
    at = lambda tag, n: [p for p, t, k in kinds if t == tag and k in ("open", "void")][n]
    closes = lambda tag, n: [p for p, t, k in kinds if t == tag and k == "close"][n]
    assert got[("div", at("div", 0))] == closes("div", 1) and got[("div", at("div", 1))] == closes("div", 0)
    assert got[("b", at("b", 0))] == last and got[("b", at("b", 1))] == closes("b", 1)
    assert got[("p", at("p", 0))] == at("p", 1) - 1 and got[("p", at("p", 1))] == closes("p", 0)
    assert got[("hr", at("hr", 0))] == at("hr", 0) and got[("section", last)] == last


def test_main_content_choice(spark):
    text = "Words enough to be kept, here and there."
    pages = [
        f"<body><div>{text} no</div><main>{text} m<article>{text} a</article></main></body>",
        f"<body><div>{text} no</div><main>{text} m</main></body>",
        f"<body><div>{text} no</div><div role='main'>{text} r</div></body>",
        f"<body><p>{text} out</p><div><a href='/x'>{text} {text}</a></div><section>{text} {text} s</section></body>",
        f"<body><p>{text} b</p></body>",
        f"<p>{text} n</p>",
        f"<body><article class='ad'>{text} no</article><p>{text} p</p></body>",
    ]
    got = contents(render.rendered_pages(frame(spark, *pages)))
    assert [g[-1] for g in got] == ["a", "m", "r", "s", "b", "n", "p"]
    chosen = contents(render.rendered_pages(frame(spark, *pages), "markdown", Options(content_selector="div[role=main], main")))
    assert chosen[1].endswith("m") and chosen[2].endswith("r") and chosen[4].endswith("b")
    with pytest.raises(ValueError):
        extract.selector_filter("div > p")


def test_wrappers_of_the_main_content_stay(spark):
    text = "Words enough to be kept, here and there."
    pages = [
        f"<body><form id=aspnetForm><div><nav>menu, here</nav><article>{text} a<form>ask, here</form></article></div></form></body>",
        f"<body><p>Skip, now</p><div class='page has-cookie-notice'><main>{text} m</main></div></body>",
        f"<body><div style='display:none'><div role=main>{text} r</div></div></body>",
        f"<body><form><div>{text} d</div></form></body>",
        f"<body><aside><article>{text} {text} no</article></aside><article>{text} b</article></body>",
        f"<body><p>{text} {text} p</p><aside><article>{text} no</article></aside></body>",
        f"<body><div class=promo>{text} {text} no</div><p>Short, but kept p</p></body>",
    ]
    got = contents(render.rendered_pages(frame(spark, *pages)))
    assert got[0] == f"{text} a" and got[1] == f"{text} m" and got[2] == f"{text} r" and got[3] == f"{text} d"
    assert got[4] == f"{text} b" and got[5] == f"{text} {text} p" and got[6] == "Short, but kept p"


def test_stray_closes_change_no_marks(spark):
    html = (
        "<article></ol><ul><li>one, of</li></ul></pre><pre>a\n  b</pre><div>x, of<div/>y, of</div></blockquote><p>plain, of</p>"
        "<ol><li>two, of</li></ol></article><p>outside, of</p>"
    )
    assert contents(render.rendered_pages(frame(spark, html)))[0] == (
        "- one, of\n\n```\na\n  b\n```\n\nx, of\n\ny, of\n\nplain, of\n\n1. two, of")


PARTS = (
    "<body><article><p>Kept text, of this page.</p><nav>Menu, of this page.</nav><div class='x sidebar'>Side, of this page.</div>"
    "<div id=my-newsletter>Letter, of this page.</div><p style='color:red; DISPLAY : none'>Hidden one, of this page.</p>"
    "<p hidden>Hidden two, of this page.</p><p aria-hidden=true>Hidden three, of this page.</p>"
    "<ul><li><a href=/a>only a link to see</a></li></ul><p>too short</p><h3>Short heading</h3>"
    "<img src=s.gif width=32 height=400><img src='b.jpg' alt='Big'><p>After, of this page.</p></article></body>"
)


def test_switches(spark):
    df = frame(spark, PARTS)
    off = dict(remove_exact_selectors=False, remove_partial_selectors=False, remove_hidden_elements=False,
               remove_low_scoring=False, remove_small_images=False, standardize=False)
    marks = {"Menu": "remove_exact_selectors", "Side": "remove_exact_selectors", "Letter": "remove_partial_selectors",
             "Hidden one": "remove_hidden_elements", "Hidden two": "remove_hidden_elements", "Hidden three": "remove_hidden_elements",
             "only a link": "remove_low_scoring", "too short": "remove_low_scoring", "s.gif": "remove_small_images"}
    everything = contents(render.rendered_pages(df, "markdown", Options(**off)))[0]
    assert all(m in everything for m in marks) and "b.jpg" in everything
    for switch in sorted(set(marks.values())):
        text = contents(render.rendered_pages(df, "markdown", Options(**{**off, switch: True})))[0]
        assert {m for m in marks if m not in text} == {m for m, s in marks.items() if s == switch}, switch
    plain = contents(render.rendered_pages(df))[0]
    assert plain == (
        "Kept text, of this page.\n\n### Short heading\n\n![Big](https://example.com/dir/b.jpg)\n\nAfter, of this page.")
    without = contents(render.rendered_pages(df, "markdown", Options(remove_images=True)))[0]
    assert "b.jpg" not in without and "After" in without
    report = {r.rule: r.tokens for r in extract.removal_report(df).collect()}
    assert set(report) == {"exact_selectors", "partial_selectors", "hidden_elements", "low_scoring", "small_images", "outside_main"}
    assert report["small_images"] == 1


def test_standardizing(spark):
    html = (
        "<title>The  Title</title><article><h1>The <i>Title</i></h1><h1>Other</h1><pre class=lang-rust>fn  main() {\n  x\n}\n</pre>"
        "<p>Text<a href='#fn:2'>2</a> goes on, to here<script type='math/tex'>a+b</script>.</p></article>"
    )
    df = frame(spark, html)
    assert contents(render.rendered_pages(df))[0] == (
        "## The *Title*\n\n## Other\n\n```rust\nfn  main() {\n  x\n}\n```\n\nText[^2] goes on, to here$a+b$.")
    plain = contents(render.rendered_pages(df, "markdown", Options(standardize=False)))[0]
    assert plain == (
        "# The *Title*\n\n# Other\n\n```\nfn  main() {\n  x\n}\n```\n\n"
        "Text[2](https://example.com/dir/article#fn:2) goes on, to here.")
    same = frame(spark, html.replace("<i>", "").replace("</i>", ""))
    assert contents(render.rendered_pages(same))[0].startswith("## Other")
    assert contents(render.rendered_pages(same, "html"))[0].startswith("<article><h2>Other</h2><pre>fn  main")


def test_markdown_forms(spark):
    html = (
        "<article><p>A <strong>bold</strong>, <em>thin</em> and <code>code()</code> word.<br>Next <b>line, open.</p>"
        "<ul><li>one, of<ol><li>inner, of</li></ol></li><li><p>two, of</p></li></ul><blockquote>said, so</blockquote><hr>"
        "<table><tr><td>a,</td><td>b</td></tr></table><p>See <a>no link</a>, <a href=x>open link</p></article>"
    )
    assert contents(render.rendered_pages(frame(spark, html), "markdown", Options(remove_low_scoring=False)))[0] == (
        "A **bold**, *thin* and `code()` word.\nNext line, open.".replace("**bold**", "bold")
        + "\n\n- one, of\n\n  1. inner, of\n\n- two, of\n\n> said, so\n\n---\n\na, | b |\n\nSee no link, open link")


def test_blank_pages_fail(spark):
    rows = render.rendered_pages(frame(spark, "", " \n", None, "<p></p>", SAMPLE)).orderBy("page_id").collect()
    assert [r.ok for r in rows] == [False, False, False, False, True]
    assert [r.content is None for r in rows] == [True, True, True, True, False]


def test_metadata(spark):
    html = (
        '<html><head><META PROPERTY="og:title" content="A &amp; B"><title>No</title><meta property="og:image" content="//cdn.x/i.png">'
        "<meta property='og:site_name' content='Site'><link rel='apple-touch icon' href='i.ico?v=1'><meta charset=utf-8>"
        "<!-- <meta name=author content=Nobody> --><meta name=description content=''>"
        '<script type="application/ld+json"> {"description": "From data", "author": {"name": "Ann"}, "datePublished": "2024-05-01"} </script>'
        "</head><body><h1>Head</h1></body></html>"
    )
    first, second, third = metadata.page_metadata(
        frame(spark, html, "<h1>Only <b>heading</b></h1>", "<p>x</p>", url="http://www.e.com:81/a/")).orderBy("page_id").collect()
    assert (first.title, first.description, first.author, first.date_published) == ("A & B", "From data", "Ann", "2024-05-01")
    assert (first.domain, first.site, first.image, first.favicon) == ("e.com:81", "Site", "http://cdn.x/i.png", "http://www.e.com:81/a/i.ico?v=1")
    assert [m.property or m.name for m in first.meta_tags] == ["og:title", "og:image", "og:site_name", "description"]
    assert len(first.schema_org_data) == 1
    assert (second.title, second.favicon, second.author) == ("Only heading", "http://www.e.com:81/favicon.ico", None)
    assert third.title == "Untitled" and third.language is None


def test_forms_of_schema_org_data(spark):
    data = [
        '{"author": [{"name": "Ann"}, {"name": "Ben"}], "description": {"@id": "#d"}}',
        '[{"@type": "Thing"}, {"author": "Ann", "description": "[Draft] of a page"}]',
        '{"@graph": [{"@id": "#p", "author": {"@id": "#a"}}, {"author": {"name": "Ann"}, "datePublished": "2024-05-01"}]}',
        '{"author": {"@id": "#p"}, "datePublished": 2024}',
        '{"author": "Ann"',
        "null",
    ]
    pages = [f'<script type="application/ld+json">{d}</script><p>x</p>' for d in data]
    rows = metadata.page_metadata(frame(spark, *pages)).orderBy("page_id").collect()
    assert [r.author for r in rows] == ["Ann", "Ann", "Ann", None, None, None]
    assert [r.description for r in rows] == [None, "[Draft] of a page", None, None, None, None]
    assert [r.date_published for r in rows] == [None, None, "2024-05-01", None, None, None]


def test_metadata_only_renders_no_text(spark):
    plan = render.metadata_only(frame(spark, SAMPLE))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join(filter(transform(blocks" not in plan
    assert render.metadata_only(frame(spark, SAMPLE)).select(F.sum("word_count")).first()[0] == 16


FORMULAS = {
    # KaTeX: MathML with TeX, and a drawing.
    '<span class="katex"><span class="katex-mathml"><math xmlns="m"><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup></mrow>'
    '<annotation encoding="application/x-tex">x^2 &lt; y</annotation></semantics></math></span>'
    '<span class="katex-html" aria-hidden="true"><span class="base">x2</span></span></span>': ("$x^2 < y$", "x2"),
    # MathJax 3: no TeX, so the formula's text.
    '<mjx-container><mjx-math aria-hidden="true"></mjx-math><mjx-assistive-mml><math><mi>a</mi><mo>&lt;</mo>\n<mi>b</mi></math></mjx-assistive-mml></mjx-container>': ("a< b", "a< b"),
    # MathJax 2: a drawing and a script.
    '<span class="MathJax_Preview">p q</span><span class="MathJax" data-mathml="<math><mi>p</mi></math>">p q</span><script type="math/tex">p+q</script>': ("$p+q$", "p qp q"),
    # TeX in attributes.
    '<math alttext="\\frac{1}{2}" display="block"><mfrac><mn>1</mn><mn>2</mn></mfrac></math>': ("$\\frac{1}{2}$", "12"),
    '<MATH data-latex="z_1"><mi>z</mi></MATH >': ("$z_1$", "z"),
    # Other annotations are none, and one left open hides nothing.
    '<math><mi>u</mi><annotation encoding="text/plain">not shown</annotation></math>': ("u", "u"),
    "<math><mi>v</mi> text": ("v text", "v text"),
}


def test_formulas(spark):
    rows = [(i, f"http://e.com/{i}", f"<html><body><article><p>Before the formula, {m} and after it, <math><mi>w</mi></math> too.</p></article></body></html>") for i, m in enumerate(FORMULAS)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for options, at in ((extract.Options(), 0), (extract.Options(standardize=False), 1)):
        got = {r.page_id: r.content for r in render.rendered_pages(df, "markdown", options).collect()}
        for i, (markup_, shown) in enumerate(FORMULAS.items()):
            assert got[i] == f"Before the formula, {shown[at]} and after it, w too.", markup_
    html = {r.page_id: r.content for r in render.rendered_pages(df, "html").collect()}
    assert "$x^2 < y$" in html[0] and "drawn" not in html[0] and "x2" not in html[0]


def test_many_open_formulas_take_no_quadratic_time(spark):
    html = "<html><body><article><p>" + "<math><mi>x</mi> " * 6_000 + "</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://e.com/", html)], "page_id long, url string, html string")
    assert tokens.tokenize(df).where("tag = 'math'").count() == 6_000


def test_lists_of_any_depth(spark):
    kinds = ["ol" if (i * 7) % 3 else "ul" for i in range(100)]
    down = "".join(f"<{k}><li>Level {i}, open." for i, k in enumerate(kinds))
    up = "".join(f"</li><li>Level {i}, again.</li></{k}>" for i, k in reversed(list(enumerate(kinds))))
    flat = "<ol><li>One, here.</li></ol><ul><li>Two, here.</li></ul><ol><li>Three, here.<ul><li>Four, here.</li></ul></li><li>Five, here.</li></ol>"
    rows = [(1, f"<article>{down}{up}</article>"), (2, f"<article>{flat}</article>"), (3, f"<ol><li><main><p>Inside the item, text.</p><li>Next, here.</li></main></li></ol>")]
    df = spark.createDataFrame([(i, f"http://e.com/{i}", f"<html><body>{h}</body></html>") for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.content.split("\n\n") for r in render.rendered_pages(df).collect()}
    mark = {"ol": "1. ", "ul": "- "}
    want = ["  " * i + mark[k] + f"Level {i}, open." for i, k in enumerate(kinds)]
    want += ["  " * i + mark[k] + f"Level {i}, again." for i, k in reversed(list(enumerate(kinds)))]
    assert got[1] == want
    assert got[2] == ["1. One, here.", "- Two, here.", "1. Three, here.", "  - Four, here.", "1. Five, here."]
    assert got[3][-1] == "1. Next, here."
