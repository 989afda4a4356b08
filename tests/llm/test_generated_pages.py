"""Forty generated pages whose article is known by construction, read by a parser that shares no code."""

import random
from html.parser import HTMLParser

import pytest

from redactlake.llm.html_text import main_text

WORDS = "the of and to in is that it for was on are as with be by this at from or have not but which river bridge stone house garden winter letter".split()
ASIDES = [
    "<nav><ul><li><a href=/a>{0}</a><li><a href=/b>{0}</a></ul></nav>", "<div class='ad'>{0}</div>", "<aside><p>{0}</p></aside>", "<form action=/s><label>{0}</label><input name=q></form>", "<footer><p>{0}</p></footer>",
    "<div class=\"cookie-notice\"><p>{0}</p><button>ok</button></div>", "<section id=comments><p>{0}</p></section>", "<script>var x = '<p>{0}</p>';</script>", "<style>p{{}}</style>", "<!-- <p>{0}</p> -->", "<div role=navigation>{0}</div>",
]


class Article(HTMLParser):
    """Text of elements that are marked with data-own, blocks one blank apart."""

    def __init__(self):
        super().__init__()
        self.out, self.depth, self.own = [], 0, None

    def handle_starttag(self, tag, attrs):
        if dict(attrs).get("data-own"):
            self.out.append("")
            self.own = tag
        elif tag == "br" and self.own:
            self.out.append("")

    def handle_endtag(self, tag):
        if tag == self.own:
            self.own = None

    def handle_data(self, data):
        if self.own:
            self.out[-1] += data


def sentence(r, n):
    ws = [r.choice(WORDS) for _ in range(n)]
    return " ".join([ws[0].capitalize(), *ws[1:]]) + "."


def page(seed):
    r = random.Random(seed)
    aside = lambda: r.choice(ASIDES).format(" ".join(sentence(r, r.randint(2, 40)) for _ in range(r.randint(1, 3))))
    body = [f"<h1 data-own=1>{sentence(r, 6)}</h1>"]
    for _ in range(r.randint(2, 8)):
        kind = r.random()
        if kind < 0.2:
            body.append(f"<h2 data-own=1>{sentence(r, 3)}</h2>")
        text = " ".join(sentence(r, r.randint(4, 30)) for _ in range(r.randint(1, 5)))
        text = text.replace(" stone", " <b>stone</b>", 1).replace(" and ", " &amp;\n ", 1).replace(" letter", " <a href=/l>letter</a>", 1).replace(" winter", "<br>winter", 1)
        body.append(f"<p data-own=1>{text}</p>")
        if r.random() < 0.3:
            body.append(aside())
    tag = r.choice(["article", "main"])
    return f"<!doctype html><html><head><title>x</title></head><body class='page with-sidebar'>{aside()}{aside()}<{tag}>{''.join(body)}</{tag}>{aside()}</body></html>"


@pytest.mark.parametrize("seed", range(40))
def test_page(seed):
    html = page(seed)
    own = Article()
    own.feed(html)
    assert main_text(html) == " ".join(" ".join(x.split()) for x in own.out if x.strip())
