"""HTML extraction: what attributes say, headings beside the text, and the densities by plain recursion."""

import math

import pytest

from shelfwright.llm.html_text import Node, densities, main_text, parse

CASES = [
    ('<p data-x="a hidden b">visible text here</p>', "visible text here"),
    ('<article title="A hidden gem"><p>Long words of the article</p></article>', "Long words of the article"),
    ("<p hidden>no</p><p>yes it is</p>", "yes it is"),
    ('<p hidden="">no</p><p HIDDEN=hidden>no</p><p>yes</p>', "yes"),
    ('<p style="color:red; display : none">no</p><p data-style="display:none">yes</p>', "yes"),
    ("<p aria-hidden=true>no</p><p aria-hidden='false'>yes</p>", "yes"),
    ('<p title="class=ad">text stays here</p><div class=ad>buy</div>', "text stays here"),
    ('<div><h1>Recipe</h1><ul><li>long item one of words</li><li>long item two of words</li></ul></div>', "Recipe\nlong item one of words\nlong item two of words"),
    ('<body><nav><a href="x">menu</a></nav><h1>Head</h1> <div><p>text of the page, long enough to count</p><p>more text</p></div></body>', "Head\ntext of the page, long enough to count\nmore text"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert main_text(page) == text


def test_densities_by_recursion(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        _, body = parse(row["html"])
        densities(body)

        def counts(x):
            """characters, tags, and those in links"""
            kids = [counts(k) for k in x.kids if isinstance(k, Node) and not k.junk]
            tags = [k.tag for k in x.kids if isinstance(k, Node) and not k.junk]
            chars = sum(len(" ".join(k.split())) for k in x.kids if isinstance(k, str)) + sum(c[0] for c in kids)
            return chars, len(kids) + sum(c[1] for c in kids), chars if x.tag == "a" else sum(c[2] for c in kids), tags.count("a") + sum(c[3] for c in kids)

        all_chars, _, all_links, _ = counts(body)
        share = all_links / all_chars if all_chars else 0

        def density(x):
            chars, tags, link_chars, link_tags = counts(x)
            if not chars:
                return 0.0
            t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
            base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
            return chars / t * math.log(max(chars / lc * t / lt, 1)) / base

        todo = [body]
        while todo:
            x = todo.pop()
            kids = [k for k in x.kids if isinstance(k, Node) and not k.junk]
            assert math.isclose(x.density, density(x), rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(x.total, sum(density(k) for k in kids), rel_tol=1e-9, abs_tol=1e-12)
            todo += kids
