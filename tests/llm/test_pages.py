"""The extraction query on all given pages against a walk over the standard library's HTML parser."""

from html.parser import HTMLParser

from floorlens.llm.queries import op3_html_extraction

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "td", "th", "tr", "table", "div", "section", "blockquote", "pre", "aside", "nav", "header", "footer", "form", "figure", "figcaption", "body", "html", "br", "hr", "dl", "dt", "dd"}
GONE = {"nav", "footer", "aside", "form", "button", "select", "script", "style", "template", "noscript", "iframe", "svg", "head", "title"}


class Walk(HTMLParser):
    """Blocks of the article: what stands in it and in nothing that is no text of its own; adverts have the class ``ad``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.blocks = [("", False, False)], [], []

    def end_block(self) -> None:
        if text := " ".join("".join(self.text).split()):
            self.blocks.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCKS:
            self.end_block()
        if tag in VOID:
            return
        if tag in BLOCKS and self.stack[-1][0] == "p" or tag == self.stack[-1][0] == "li":
            self.stack.pop()
        _, inside, gone = self.stack[-1]
        gone = gone or tag in GONE or tag == "header" and not inside or "ad" in (dict(attrs).get("class") or "").split()
        self.stack.append((tag, inside or tag in ("article", "main"), gone))

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS:
            self.end_block()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data) -> None:
        _, inside, gone = self.stack[-1]
        if inside and not gone:
            self.text.append(data)


def walked(page: str | None) -> str:
    walk = Walk()
    walk.feed(page or "")
    walk.close()
    walk.end_block()
    return "\n".join(walk.blocks)


def test_all_given_pages_are_those_of_the_walk(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op3_html_extraction(spark, sf).collect()}
        want = {i: (t, len(t)) for i, t in ((i, walked(h)) for i, h in pages.items())}
        assert got == want and len(got) == len(pages)
