"""Texts that pages of a host share stay in the article."""

from paperloom.llm import html


def test_html_keeps_repeated_texts(spark):
    def page(i, body):
        return f"<html><body><nav>Menu</nav><article>{body}</article><footer>Me</footer></body></html>"

    for n in (19, 20, 40):
        pages = [(i, "http://copies.example/", page(i, "<h1>Head</h1><p>Short</p>")) for i in range(n)]
        pages += [(100 + i, "http://one.example/", page(i, "<p>Short</p>")) for i in range(n)]
        pages += [(200 + i, "http://same.example/", page(i, f"<h2>Summary</h2><p>Text {i}</p>")) for i in range(n)]
        got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert got == {i: "Head Short" for i in range(n)} | {100 + i: "Short" for i in range(n)} | {200 + i: f"Summary Text {i}" for i in range(n)}
