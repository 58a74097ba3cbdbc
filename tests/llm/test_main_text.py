import pytest

from popstat.llm.main_text import extract_main_text, main_text

ARTICLE = "<h1>Head, line</h1><p><b>First one, of two.<br>Same block<p>Second &amp third&#33;</p><ul><li>Item</li></ul>"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain  text\n", "plain text"), ("<nav>only <a>links</a></nav>", ""),
    (f"<body><nav><a>Home</a></nav><article>{ARTICLE}</article><footer>Foot, foot, foot.</footer>",
     "Head, line First one, of two. Same block Second & third! Item"),
    ("<div id=main><p>One, two, three.</p><p>Four.</p></div><div class=sidebar><p>No, no, no, no.</p></div>", "One, two, three. Four."),
    ("<main><section><p>A, b, c.</p></section><section><p>D.</p></section></main><aside>x, y, z, w</aside>", "A, b, c. D."),
    ("<article><header><h1>T</h1></header><p>Body, text.</p><div class='comments'><p>me, too, me, too</p></div>"
     "<form><p>Name, mail</p></form><div hidden>h</div><div style='display: none'>n</div></article>", "T Body, text."),
    ("<article><p>foo<i>bar</i>&nbsp;baz</p><script>if (a<b) '</p>';</script><style>p{}</style><!-- c, --></article>", "foobar baz"),
    ("<article><p>kept, to the <a href=", "kept, to the"), ("<article><p>a < b and c > d, e</p>", "a < b and c > d, e"),
    ("<table><tr><td>cell, one<td>cell, two<tr><td>three</table>", "cell, one cell, two three"),
    ("<article><p title='a > b'>quoted, attribute</p></article>", "quoted, attribute"),
    ("<body><div class='ad'>buy, buy, buy, buy</div><article><p>Sh is.</p></article></body>", "Sh is."),
    ("</p></div><p>stray, ends</b></p>", "stray, ends"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_long_and_deep_pages():
    words = "word, " * 100_000
    assert main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert main_text("<div>" * 5_000 + "<p>deep, down" + "</div>" * 5_000) == "deep, down"


def test_rows(spark):
    rows = [(1, "u", "<article><p>é, 漢😀</p></article>", "clash"), (1, "u", None, "clash"), (None, None, "", "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(df).collect()
    assert [tuple(r) for r in got] == [(1, "u", "é, 漢😀", 5), (1, "u", "", 0), (None, None, "", 0)]
    assert extract_main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", [
    "has-sidebar", "no-sidebar", "with-banner", "share-enabled", "elementor-widget", "menu-open", "widget", "sidebar",
])
def test_wrappers_of_the_article_stay(name):
    side = "<div class='site-footer'><p>Foot, foot, foot.</p></div><div class='comments'><article><p>me, too</p></article></div>"
    body = "<p>One, two, three, four, five, six, seven.</p><p>Eight, nine.</p>"
    text = "One, two, three, four, five, six, seven. Eight, nine."
    assert main_text(f"<body><div id='page' class='{name}'><article>{body}</article>{side}</div></body>") == text
    assert main_text(f"<body><div class='{name}'><div>{body}</div></div><div class='site-footer'><p>Foot.</p></div></body>") == text


def test_siblings_of_the_best_container_stay():
    page = ("<div id=content><h1>Title</h1><div class=body><p>One, two, three, four.</p><p>Five, six.</p></div><blockquote>Said.</blockquote>"
            "<pre>x = 1</pre><p>Short.</p><table><tr><td>cell</table><ul><li>Item</ul><ul><li><a>Link one</a></ul> bare</div>")
    assert main_text(page) == "Title One, two, three, four. Five, six. Said. x = 1 Short. cell Item bare"


BODY = "<p>One, two, three, four, five, six, seven.</p><p>Eight, nine.</p>"
TEXT = "One, two, three, four, five, six, seven. Eight, nine."


@pytest.mark.parametrize("slug", ["related-work", "notices-of-intent", "ad-hoc-tests", "share-prices", "social-impact", "widget-theory"])
def test_subjects_within_an_article_stay(slug):
    assert main_text(f"<article>{BODY}<h2 id='{slug}'>Head</h2><section id='{slug}'><p>Ten.</p></section></article>") == f"{TEXT} Head Ten."
    assert main_text(f"<main>{BODY}<section class='{slug}'><p>Ten, eleven.</p></section></main>") == f"{TEXT} Ten, eleven."


@pytest.mark.parametrize("name", ["ad", "ad-slot", "share-buttons", "related-posts", "newsletter-signup", "post-share", "ad-300x250", "replies"])
def test_adverts_and_links_within_an_article_go(name):
    assert main_text(f"<article>{BODY}<div class='{name}'><p>Buy, buy, buy.</p></div></article>") == TEXT


@pytest.mark.parametrize("comment", [
    "<article class='comment'><p>me, too, me, too</p></article>", "<div class='replies'><p>me, too</p></div>",
    "<section id='comments'><p>me, too</p></section>", "<article class='user-reply odd'><p>me, too</p></article>",
])
def test_reader_comments_go(comment):
    assert main_text(f"<main>{BODY}{comment}</main>") == TEXT
    assert main_text(f"<body><article class='post comments-open'>{BODY}</article>{comment}</body>") == TEXT


def test_page_within_a_form():
    assert main_text(f"<body><form id='aspnetForm'><div class='menu'><a>Home</a></div><div>{BODY}</div></form></body>") == TEXT
    assert main_text(f"<body><form id='aspnetForm'><article>{BODY}<form><p>Name, mail</p></form></article></form></body>") == TEXT
    assert main_text(f"<body><div>{BODY}</div><form><p>Name, mail</p></form></body>") == TEXT


def test_formulas_and_a_title_in_its_own_wrapper():
    assert main_text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>, then.</p></article>") == "If x=1, then."
    page = f"<div id=page><div class=top><div><h1>Title</h1></div></div><div class=wrap><div class=body>{BODY}</div></div></div>"
    assert main_text(page) == f"Title {TEXT}"
