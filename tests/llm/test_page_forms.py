"""Pages with markup left out, names that only look like those of asides, and other languages."""

import pytest

from redactlake.llm import html_text
from redactlake.llm.html_text import main_text

A = "The river of the town and the bridge that was in it for all of the people who were there and have not gone to the other side of it."
LONG = f"{A} {A}"
RUSSIAN = "Река города и мост, который стоял на ней для всех людей, которые были там и не ушли на другую сторону. " * 3
ITEMS = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"{ITEMS}<a name=top><article><p>{LONG}<p>{LONG}</article>", f"{LONG} {LONG}"),
        (f"{ITEMS}<article><p><a href=/x>{A}<p>{LONG}</article>", LONG),
        (f"{ITEMS}<article><p>{LONG} <a href=/x>a link</a> of it.</p></article>", f"{LONG} a link of it."),
        (f"<div class='layout with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div class='layout with-sidebar'><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", LONG),
        (f"<div id='share-price'><h1>Shares</h1><p>{LONG}</p></div>", f"Shares {LONG}"),
        (f"<article><p>{LONG}</p><section id='related-work'><h2>Work</h2><p>{LONG}</p></section></article>", f"{LONG} Work {LONG}"),
        (f"<article><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div><ol class='commentList'><li><article><p>{LONG}</p></article></ol></article>", LONG),
        (f"<article><p>{LONG}</p><form><select><option>one<option>two</form><p>{LONG}</article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><select><option>one<option>two<p>{LONG}</article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><button>Send<p>{LONG}</article>", f"{LONG} {LONG}"),
        (f"<article><svg><path d='x'><p>{LONG}</p></article>", LONG),
        (f"<form id=all><h1>Title</h1><p>{LONG}</p></form>", f"Title {LONG}"),
        (f"<form><p>{LONG}</p></form><p>{LONG}</p>", LONG),
        (f"{ITEMS}<div>{RUSSIAN}</div><footer>Все права</footer>", RUSSIAN.strip()),
        (f"<ul><li class=ad>{A}<li>{LONG}</ul>", LONG),
        (f"<p class=notice>{A}<p>{LONG}", LONG),
        (f"<div class=cookie-banner><p>{LONG}</p></div>", ""),
        (f"<header class=article-header><h1>Site</h1></header><div class=article-header><h1>Title</h1></div><p>{LONG}</p>", f"Title {LONG}"),
    ],
)
def test_page(page, text):
    assert main_text(page) == text


def test_very_long():
    assert main_text(f"<article>{''.join(f'<p>{LONG}' for _ in range(3000))}</article>") == " ".join([LONG] * 3000)


def test_clashes(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "x", 1), (1, "u", f"<p>{LONG}</p>", "x", 1), (2, None, "", None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id, r.url, r.text) for r in got if r.page_id == 1) == [(1, "u", LONG)] * 2 and len(got) == 3
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
