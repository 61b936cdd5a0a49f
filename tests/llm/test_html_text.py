import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest

from llm_fixtures import SF
from tallyline.llm.html_text import blocks, content, main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars int, path string"
LONG = "This is the first sentence, and it goes on for a while. Here is the second one; it is not short either."
OTHER = "Another paragraph follows the first, with words enough. It ends here, after a second sentence."


def text_of(html):
    return "\n".join(content(blocks(html)))


class Article(HTMLParser):
    """What stands in the one article element, a paragraph or heading a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.found = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag in ("p", "h1"):
            self.found.append("")
        elif tag == "br":
            self.found[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        elif tag in ("p", "h1"):
            self.found.append("")

    def handle_data(self, data):
        if self.inside:
            self.found[-1] += data


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r["page_id"]: r for r in main_text(pages).collect()}
    assert len(found) == pages.count()
    for page_id, url, html in pages.select("page_id", "url", "html").collect():
        parser = Article()
        parser.feed(html)
        wanted = "\n".join(filter(None, (" ".join(t.split()) for t in parser.found)))
        assert tuple(found[page_id]) == (page_id, url, wanted, len(wanted))


def page(body):
    return f"<html><head><title>Title, of the page.</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("junk", [
    f"<nav><p>{LONG}</p></nav>", f"<header><h1>{LONG}</h1></header>", f"<footer>{LONG}</footer>", f"<aside><p>{LONG}</p></aside>",
    f"<div class='cookie-notice'><p>{LONG}</p></div>", f'<div id="sidebar2"><p>{LONG}</p></div>', f"<form><p>{LONG}</p><input></form>",
    f"<script>var a='</p><p>{LONG}';</script>", f"<style>p{{}} {LONG}</style>", f"<!-- <p>{LONG}</p> -->",
    f"<section id=comments><article class='comment'><p>{LONG}</p></article></section>", f"<div class=adBanner>{LONG}</div>",
    f"<div role='banner'>{LONG}</div>", f"<div style='display: none'>{LONG}</div>", f"<div hidden>{LONG}</div>",
    "<div class=x7><ul>" + "<li><a href='/x'>Go there, now.</a></li>" * 9 + "</ul></div>",
    "<div class=x8>" + "<span>Home</span> <p>News</p> <p>Shop</p>" * 3 + "</div>",
    f"<template><p>{LONG}</p></template><noscript><p>{LONG}</p></noscript><iframe><p>{LONG}</p></iframe>",
    f"<button>{LONG}</button><select><option>{LONG}<option>b</select><textarea><p>{LONG}</textarea>",
])
@pytest.mark.parametrize("kind", ["<article>{}</article>", "<main><div class=text>{}</div></main>", "<div class='post-body'>{}</div>"])
def test_all_but_the_article_goes(junk, kind):
    article = kind.format(f"<h1>A title</h1><p>{LONG}</p><p>{OTHER}</p>")
    assert text_of(page(junk + article + junk)) == f"A title\n{LONG}\n{OTHER}"


def test_short_blocks_and_lists_of_an_article_stay():
    html = page(
        f"<div class=post><h2>Short</h2><p>{LONG * 3}</p><ul><li>one<li>two, <a href=x>three</a><li>four</ul><blockquote>Be.</blockquote>"
        f"<table><tr><td>a<td>b</table><h3>End</h3><p>{OTHER}</p></div>"
    )
    assert text_of(html) == "\n".join(["Short", LONG * 3, "one", "two, three", "four", "Be.", "a", "b", "End", OTHER])
    assert text_of(page("<article><p>Be.</p></article>")) == "Be."
    assert text_of(page(f"<main><header><h1>Title</h1></header><p>{LONG}</p></main>")) == f"Title\n{LONG}"


def test_markup_references_and_white_space():
    html = page(
        "<div><p>a&amp;lt;b &lt;i&gt; &copy &#233;&#xD800;&nbsp;x\n\t y<br>z</p><P CLASS=q title='a>b' data=\"</p>\">in<b>li</b>ne, <a href=x>link</a>."
        "<p>1 < 2 and 3 > 2<![CDATA[gone]]><?gone?></div>"
    )
    assert text_of(html) == "a&lt;b <i> © é� x y z\ninline, link.\n1 < 2 and 3 > 2"


@pytest.mark.parametrize("html", [
    f"<p>{LONG}", f"{LONG}", f"<article><p>{LONG}</article", f"<p>{LONG}</p><script>var x = '<p>", f"<p>{LONG}</p><!-- never closed <p>x",
    f"<head><meta x><p>{LONG}</p>", f"</div></p><div><p>{LONG}</div></b></article><i>", f"<p>{LONG}<p class=\"x", f"<title>t</title><p><b>{LONG}</p>",
])
def test_broken_markup(html):
    assert text_of(html) == LONG


@pytest.mark.parametrize("part", ["<div>", "<b>", "</i>", "<p", "<!--", "<script>", "<a href='", '<p x="', "<li>", "</p>", "&", "<"])
def test_time_grows_with_the_length_only(part):
    begin = time.perf_counter()
    text_of(part * 20_000)
    assert time.perf_counter() - begin < 10


def test_edge_rows(spark):
    rows = [
        (1, None, None), (None, "u", ""), (3, "u", "  \n"), (4, "u", page(f"<nav>{LONG}</nav>")), (5, "u", page(f"<p>{LONG}</p>")),
        (5, "u", page(f"<p>{LONG}</p>")), (6, "u", page(f"<article><p>{'word, ' * 500_000}</p></article>")), (7, "ü", "é 🎉."),
    ]
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    long_text = ("word, " * 500_000).strip()
    texts = ["", "", "", "", LONG, LONG, long_text, "é 🎉."]
    assert sorted(map(str, found.collect())) == sorted(
        str(type(found.first())(page_id=r[0], url=r[1], text=t, n_chars=len(t))) for r, t in zip(rows, texts)
    )
    assert main_text(pages.limit(0)).collect() == []


def test_references_are_decoded_once():
    html = "<p>" + "&amp;amp; &quot;x&quot;, &#38;lt; &hellip;</p>"
    assert text_of(html) == re.sub(r"\s+", " ", unescape("&amp;amp; &quot;x&quot;, &#38;lt; &hellip;"))
