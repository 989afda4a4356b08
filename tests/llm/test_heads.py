"""Pages whose head is not closed."""

import pytest

from redactlake.llm.html_text import main_text

LONG = "The river of the town and the bridge that was in it for all of the people who were there and have not gone to the other side of it. " * 2
META = "<meta charset=utf-8><title>A <p> title</title><link rel=x href='a>b'><script>var a='<div>';</script><!-- <body> --><style>p{}</style>"


@pytest.mark.parametrize("head", [f"<head>{META}", f"<html><HEAD id='header'>\n{META}\n", f"<head>{META}<meta content=\"odd>", "<head>", f"<head>{META}</head>", f"<head>{META}</head >\n"])
@pytest.mark.parametrize("body", ["<body><p>{}</p></body>", "<article><p>{}</p></article>", "<p>{}", "{}"])
def test_head(head, body):
    assert main_text(f"<!doctype html>{head}{body.format(LONG)}") == LONG.strip()


def test_head_alone():
    assert main_text(f"<head>{META}") == main_text(f"<head>{META}</head>") == ""
    assert main_text(f"<head>{META}</head><header><p>{LONG}</p></header>") == ""
