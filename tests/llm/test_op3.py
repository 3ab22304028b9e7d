"""HTML extraction on pages whose article is known."""

import random

from seqlens.llm.op3_html_text import extract, main_lines, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="home sidebar-right"><header><h2>Site name and a very long slogan that goes on and on</h2></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, a long notice text for all visitors of the page.</div>
<div class="ad">Buy now</div>%s<aside>Read also: something else entirely that is long</aside>
<div id="comments"><p>I do not agree with this article at all, said the reader.</p></div><form><p>Your mail</p><input></form>
<footer>&copy; 2024 Somebody</footer></body></html>"""
BODY = "<h1>Head &lt;line&gt;</h1><p><b>First   para</b>graph &eacute;&#233;&#xe9;.<br>On\n\tgoes it.<p>Short.</p><ul><li>one<li>two</ul><!-- no --><p>Last &amp; &amp;amp; end"
WANT = "Head <line> First paragraph ééé. On goes it. Short. one two Last & &amp; end"


def test_article():
    assert extract(PAGE % f"<article>{BODY}</article>") == WANT
    assert extract((PAGE % f"<main><header>{BODY}</header></main>")) == WANT


def test_unmarked():
    long = "This is a sentence of the story that is told here, and it has some length. " * 3
    body = f"<div><h1>Title</h1><p>{long}</p><p>Yes.</p><p>{long}</p></div>"
    assert extract(PAGE % body) == " ".join(f"Title {long}Yes. {long}".split())


def test_edges(spark):
    assert extract(None) == extract("") == extract("<p> </p>") == extract("<script>x") == ""
    assert extract("plain words") == "plain words"
    assert extract("<article><p>cut &am") == "cut &am"
    rows = [(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (None, None, None)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("x", 1), ("x", 1)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


def test_unmarked_with_an_aside_and_verse():
    long = "This is a sentence of the story that is told here, and it has some length. " * 3
    aside = "<aside><ul>" + "".join(f'<li><a href="/{k}">See number {k}</a></li>' for k in range(7)) + "</ul></aside>"
    verse = [f"Verse line {k}" for k in range(9)]
    body = f"<div><h1>Title</h1><p>{long}</p>{aside}<p>The lighter part, which tells how the story went on and ended.</p>"
    body += "".join(f"<p>{v}</p>" for v in verse) + f"<p>{long}</p><p>The</p><p>very</p><p>end</p><p>of</p><p>it</p></div>"
    want = f"Title {long}The lighter part, which tells how the story went on and ended. {' '.join(verse)} {long}The very end of it"
    assert extract(PAGE % body) == " ".join(want.split())
    assert extract("<body>" + "".join(f"<p>{v}</p>" for v in [*verse, "x"]) + "</body>") == " ".join([*verse, "x"])
    links = "".join(f'<div><a href="/{k}">Section number {k} of the site</a></div>' for k in range(9))
    got = extract(f"<body>{links}<p>{long}</p></body>")
    assert got.endswith(long.strip()) and "number 3" not in got


def test_slug_ids_are_no_furniture():
    body = '<h2 id="social-effects">Social effects</h2><section id="related-work"><h3 class="side notice">Related</h3><p id="reply-one">Reply.</p></section>'
    junk = '<div class="related-posts">More</div><div id="comments">Mine</div><div role="navigation">Up</div><p hidden>gone</p>'
    assert extract(PAGE % f"<article>{body}{junk}<p>End.</p></article>") == "Social effects Related Reply. End."
    long = "This is a sentence of the story that is told here, and it has some length. " * 3
    got = extract(PAGE % f'<h2 id="social-effects">Social effects</h2><p>{long}</p><div id="related-posts">More</div>')
    assert got == f"Social effects {long.strip()}"


def test_raw_elements_end_at_their_own_tag():
    long = "This is a sentence of the story that is told here, and it has some length."
    for raw in ('<script>for(i=0;i<n;i++){x()}</script>', '<script>s="<!--";</script>', '<script>if(a<b&&c>d)t="</p>"</script >', "<style>a>b{}</style>", "<SCRIPT>x<y</script>"):
        assert extract(f"{raw}<article><p>{long}</p>{raw}<p>End.</p></article>") == f"{long} End.", raw
    for open_ in ("<select><option>one<option>two", "<svg><text>no</text>", "<script>x<y", "<button>press", "<noscript><p>no", "<textarea>no<p>"):
        assert extract(f"<article><p>{long}</p><div>{open_}</div><p>End.</p></article>") == f"{long} End.", open_
    assert extract(f"<article><p>{long}</p></article><script>x") == long
    assert extract("<article><p>if i<3 it's so</p><p title=it's>yes</p></article>") == "if i<3 it's so yes"


def test_inline_furniture_leaves_the_rest_of_its_line():
    assert extract("<article><p>Hello <button>press</button> world<svg><path/></svg>.</p><p hidden>Buy<div>Text.</div></article>") == "Hello world. Text."
    assert extract("<article><p><a href=x>Open link <p>and text that is no link</article>") == "Open link and text that is no link"


def test_two_runs_and_link_lines_at_their_edges():
    long = "This is a sentence of the story that is told here, and it has some length. " * 2
    links = "".join(f'<div><a href="/{k}">Section {k}</a></div>' for k in range(6))
    got = extract(f"<body>{links}<div><p>{long}</p><p>Yes.</p></div>{links}<div><p>And so on.</p><p>{long}</p></div>{links}</body>")
    assert got == f"{long.strip()} Yes. And so on. {long.strip()}"


def test_distribution_may_overrule_the_tag():
    long = "This is a sentence of the story that is told here, and it has some length. " * 30
    assert extract(f"<body><article><p>Teaser text.</p></article><div><p>{long}</p></div></body>") == f"Teaser text. {long.strip()}"
    assert extract(f"<body><article><p>{long}</p></article><div><p>{long}</p></div></body>") == long.strip()


def brute(lines, window, surge):
    """Runs by the definition: a line is reached by each window of lines that holds it."""
    weight = [max(0, len(t) - links) for t, links, *_ in lines]
    n = len(lines)
    sums = {k: sum(weight[max(0, k) : max(0, k + window)]) for k in range(1 - window, n)}
    reach = [max(sums[k] for k in range(i - window + 1, i + 1)) for i in range(n)]
    least = surge if max(sums.values(), default=0) >= surge else 1
    out, run = [], []
    for i in range(n + 1):
        if i < n and reach[i] > 0:
            run.append(i)
            continue
        if run and max(reach[k] for k in run) >= least:
            while not weight[run[0]]:
                run.pop(0)
            while not weight[run[-1]]:
                run.pop()
            out += [lines[k][0] for k in run]
        run = []
    return out


def test_brute_force():
    rnd = random.Random(7)
    for _ in range(500):
        lines = []
        for _ in range(rnd.randint(0, 25)):
            text = "x" * rnd.choice([1, 5, 30, 80, 300])
            lines.append((text, rnd.choice([0, 0, len(text)]), False, False))
        for window, surge in ((3, 60), (1, 60), (5, 200)):
            assert main_lines(lines, window, surge) == brute(lines, window, surge)


def test_table_without_its_tags(spark):
    """The pages with the tag that marks the article taken away: the distribution alone finds it."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    same = sum(extract(r.html) == extract(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) for r in rows)
    assert same >= 0.98 * len(rows)


LONG = "This is a sentence of the story that is told here, and it has some length. " * 3


def test_what_encloses_the_article_is_no_furniture():
    body = f"<article><p>{LONG}</p><p>End.</p></article>"
    want = f"{LONG.strip()} End."
    for wrap in (
        'div class="layout with-sidebar"', 'div class="content no-sidebar"', 'div id="side-effects"', 'div class="has-sidebar"', 'section class="with-menu"', 'div class="site-header-fixed"',
        'div class="has-social-links"', 'div class="page-with-notice"', 'div class="sidebar"', 'form id="main"', 'div class="banner"',
    ):
        tag = wrap.split()[0]
        assert extract(PAGE % f"<{wrap}>{body}</{tag}>") == want, wrap
        unmarked = extract(f"<body><{wrap}><p>{LONG * 3}</p><p>End.</p></{tag}><nav>no</nav></body>")
        assert unmarked == f"{(LONG * 3).strip()} End.", wrap


def test_names_within_the_article():
    keep = '<section class="side-effects"><p>Effects.</p></section><div class="related-work">Work.</div><div class="no-comment">None.</div>'
    drop = '<div class="related-posts">More</div><div class="share-buttons">Share</div><div class="cookie-notice">C</div><div class="sidebar-left">S</div><ul class="social-links"><li>x</ul>'
    assert extract(PAGE % f"<article>{keep}{drop}<p>End.</p></article>") == "Effects. Work. None. End."


def test_comments_never_count():
    many = "".join(f'<article class="comment-body"><p>{LONG} {k}</p></article>' for k in range(40))
    assert extract(PAGE % f'<article><p>{LONG}</p></article><div id="comments">{many}</div>') == LONG.strip()
    cards = f'<div class="related"><article><p>{LONG}</p></article></div>'
    assert extract(PAGE % f"<main><p>Text of it.</p></main>{cards}") == "Text of it."


def test_time_is_linear():
    import time

    parts = {
        "stray end tags": "</b>" * 250_000, "unclosed scripts": "<script>x" * 110_000, "unclosed scripts in blocks": "<div><script>x</div>" * 50_000,
        "deep": "<b>" * 150_000 + "<div>" * 80_000 + "</i>" * 50_000, "paragraphs": "<p>" + "<b>" * 100_000 + "<li><p>" * 90_000, "names": '<div class="a b c">' * 50_000,
        "comments": "<!-- x" * 160_000, "quotes": "<a b='" * 160_000, "attributes": "<a " + "= " * 500_000,
    }
    for name, junk in parts.items():
        began = time.process_time()
        got = extract(f"<article><p>{LONG}</p></article>{junk}")
        assert time.process_time() - began < 5, name
        assert got.startswith(LONG.strip()), name


def test_clashing_names_and_pages_over_100_kb(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", PAGE % f"<article>{'<p>' + LONG + '</p>'}</article>"), (2, "v", "<article>" + f"<p>{LONG}</p>" * 1000 + "</article>"), (None, "w", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "a.b", "lines"):
        df = df.withColumn(name, F.lit("x"))
    got = {r.page_id: (r.text, r.n_chars) for r in main_text(df).collect()}
    assert got == {1: (LONG.strip(), len(LONG.strip())), 2: (" ".join([LONG.strip()] * 1000), 1000 * len(LONG) - 1), None: ("", 0)}
