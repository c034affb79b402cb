"""What a host's wrapper decides, deep and long pages, repeated rows."""

from paperloom.llm import html


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as plan")
    return [r["text"] for r in sorted(html.main_text(df).collect(), key=lambda r: r["page_id"])]


LEGAL = "All rights to these words remain with those who wrote them, wherever they may be read. " * 4


def plain(i, url="http://plain.example/"):
    return url, f"<body><div class='upper'><p>{LEGAL}</p></div><div class='lower'><p>Story number {i} of {i * 7}.</p><p>It ends with {i * i}.</p></div></body>"


def test_wrapper_finds_the_slots(spark):
    """Nothing marks the article: alone, a page's greater part is the constant
    text; the host's wrapper knows that it is the same everywhere."""
    pages = [plain(i) for i in range(6)]
    assert texts(spark, pages) == [f"Story number {i} of {i * 7}. It ends with {i * i}." for i in range(6)]
    assert LEGAL.strip() in texts(spark, pages[:1])[0]


def test_classes_only_suggest(spark):
    pages = [(f"http://a.example/{i}", f"<body><div class=nav>Home</div><article><div class='article-header'><h1>Title {i}</h1></div><div class='legal-news'><p>The court said {i}.</p><p>It will sit again.</p></div><div class=comments>Reader {i} says no.</div></article></body>") for i in range(5)]
    assert texts(spark, pages) == [f"Title {i} The court said {i}. It will sit again." for i in range(5)]


def test_constant_blocks_of_an_article_stay(spark):
    page = lambda i: (f"http://b.example/{i}", f"<body><article><h2>Summary</h2><p>Piece {i}.</p></article></body>")
    for n in (2, 10, 25):
        assert texts(spark, [page(i) for i in range(n)]) == [f"Summary Piece {i}." for i in range(n)]


def test_deep_long_and_repeated_pages(spark):
    deep = "<body>" + "<div>" * 2000 + "<nav>menu</nav><article><p>one</p><p>two</p></article>" + "</div>" * 2000 + "</body>"
    words = " ".join(f"w{i}" for i in range(60_000))
    long = f"<body><nav>menu</nav><article><p>{words}</p></article></body>"
    pages = [("http://deep.example/", deep), ("http://long.example/", long), ("http://long.example/", long), (None, None), ("", "")]
    assert texts(spark, pages) == ["one two", words, words, "", ""]
