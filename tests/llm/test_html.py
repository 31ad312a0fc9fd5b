import json

from treatlens.llm.html_wrappers import Page, align, expression, extract_pages, folded, infer_wrappers

PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li><li>x</li></ul></nav>"
    "<div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One  two<br>three<p>Four</p>"
    "<aside>see also</aside><form>mail</form><div class='comments'><p>first!</p></div></article>"
    "<footer>&copy;</footer><script>var a='<p>no</p>';</script></body></html>"
)


def read(spark, rows):
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string"))
    return sorted(tuple(r) for r in got.collect())


def test_article_without_template_and_comments(spark):
    rows = [(1, "http://a.org/1", PAGE, "clash", "x"), (1, "http://a.org/1", PAGE, "clash", "x")]
    assert [r[2] for r in read(spark, rows)] == ["A & B\n\nOne two three\n\nFour"] * 2


def test_odd_pages(spark):
    rows = [
        (1, None, None, "", ""), (2, "http://a.org", "", "", ""), (3, "no url", "<p", "", ""),
        (4, "http://b.org", "<article><p>cut off", "", ""), (5, "http://c.org", "<!-- <p>x</p>", "", ""),
        (6, "http://d.org", "<article><p>" + "word " * 200_000 + "</article>", "", ""),
        (7, "http://e.org", "<article><p title=\"a>b\" class='x>y'>ok</p><script>never closed", "", ""),
    ]
    text = {r[0]: r[2] for r in read(spark, rows)}
    assert [text[i] for i in (1, 2, 3, 4, 5, 7)] == ["", "", "", "cut off", "", "ok"]
    assert len(text[6]) == 5 * 200_000 - 1
    assert read(spark, []) == []


def test_host_without_article_keeps_what_changes(spark):
    page = "<body><div id=top>Welcome to our site</div><div id=main-text><p>{0}</p></div><div id=links><a>{1}</a></div></body>"
    rows = [(i, f"http://f.org/{i}", page.format(f"story {i}", f"link {i}"), "", "") for i in range(5)]
    assert [r[2] for r in read(spark, rows)] == [f"story {i}" for i in range(5)]


def test_templates_of_a_host_may_differ(spark):
    rows = [(i, f"http://g.org/{i}", f"<body><article><p>piece {i}</p></article></body>", "", "") for i in range(3)]
    rows += [(i, f"http://g.org/{i}", f"<body><div class=story><p>tale {i}</p></div></body>", "", "") for i in range(3, 6)]
    assert [r[2] for r in read(spark, rows)] == [f"piece {i}" for i in range(3)] + [f"tale {i}" for i in range(3, 6)]


def test_wrapper_has_repeats_optionals_and_slots(spark):
    a = folded(Page("<body><h1>x</h1><p>1</p><p>2</p></body>").tree)
    b = folded(Page("<body><h1>y</h1><div>extra</div><p>1</p></body>").tree)
    assert expression(align(a, b)) == "( (body (h1 #) (div #)? (p #)+))"
    assert align(json.loads(json.dumps(a)), a) == a
    pages = spark.createDataFrame(
        [(1, "http://a.org/1", "<body><h1>x</h1><p>1</p></body>"), (2, "http://a.org/2", "<body><p>1</p></body>")],
        "page_id long, url string, html string",
    )
    assert [r.wrapper for r in infer_wrappers(pages).collect()] == ["( (body (h1 #)? (p #)))"]


def test_compound_classes_of_text_elements_say_nothing(spark):
    pages = [
        '<article class="post comments-open ad-free"><p class="social-policy">kept</p></article>',
        '<main class="sidebar-right article-share-enabled"><h2 class="menu-title">head</h2><p>kept</p></main>',
        '<article class="comment"><p>reader</p></article>', '<article><p>kept</p><p class="ad">no</p></article>',
    ]
    rows = [(i, f"http://m{i}.org/", f"<body>{p}</body>", "", "") for i, p in enumerate(pages)]
    assert [r[2] for r in read(spark, rows)] == ["kept", "head\n\nkept", "", "kept"]


def test_copies_of_one_page_keep_its_text(spark):
    page = "<body><div class=story><h2>Head</h2><p>tale</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page, "", "") for i in range(2)] + [(5, "http://i.org/", page, "", "")]
    assert [r[2] for r in read(spark, rows)] == ["Head\n\ntale"] * 3


def test_constant_slots_beside_changing_ones_stay(spark):
    page = "<body><div id=top><p>Welcome</p></div><div class=story><h2>Summary</h2><p>{0}</p></div></body>"
    rows = [(i, f"http://j.org/{i}", page.format(f"tale {i}"), "", "") for i in range(3)]
    assert [r[2] for r in read(spark, rows)] == [f"Summary\n\ntale {i}" for i in range(3)]


def test_one_word_of_a_compound_class_does_not_drop_an_article(spark):
    article = "<article><div class='article-header'><h1>T</h1></div><p>x</p><div class='comment-list'><p>c</p></div></article>"
    frames = [
        f"<body class='no-sidebar'>{article}</body>", f"<body class='sidebar'>{article}</body>",
        f"<body><div class='has-sidebar'>{article}</div></body>", f"<body><div class='page-header-wrap'>{article}</div></body>",
    ]
    rows = [(i, f"http://k{i}.org/", f, "", "") for i, f in enumerate(frames)]
    rows.append((9, "http://l.org/", f"<body><div class='related-posts'>{article}</div><div class=side-bar><p>s</p></div></body>", "", ""))
    assert [r[2] for r in read(spark, rows)] == ["T\n\nx"] * 4 + [""]
