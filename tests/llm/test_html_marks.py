"""Operator 9 where names mislead: wrappers and forms that hold the article, tokens of other meaning, pages without any mark."""

import re

import pytest

from quarrylens.llm import html_extraction
from quarrylens.llm.common import table

DATA = "/root/testdata/sf0.01"
PARTS = [f"This is paragraph number {i} of the article with a fair amount of words in it." for i in range(6)]
BODY, WANT = "".join(f"<p>{p}</p>" for p in PARTS), "\n\n".join(PARTS)
TALK = f"<p>{'I think so too, thank you. ' * 60}</p>"


def page(inner):
    return f"<html><body><nav><a href='/'>Home</a></nav>{inner}<footer>Copyright</footer></body></html>"


@pytest.mark.parametrize("inner", [
    f'<div class="content has-sidebar">{BODY}</div>', f'<div id="page" class="no-sidebar">{BODY}</div>', f'<div class="wrap with-nav"><article>{BODY}</article></div>', f'<form id="aspnetForm"><article>{BODY}</article></form>',
    f'<form id="aspnetForm">{BODY}<div class="cookie-banner"><p>We use cookies on this page.</p></div></form>', f'<div class="widget">{BODY}<div class="sidebar"><p>{"side text " * 20}</p></div></div>',
    f'<article>{BODY}<section class="comments">{TALK}</section></article>', f'<div>{BODY}</div><div id="comment-list">{TALK}</div>', f'<div class="site-header"><p>The name of the site</p></div><div class="main">{BODY}</div>',
    f'<div class="ad">{"Buy this now. " * 5}</div><div>{BODY}</div>', f'<div class="promo"><div class="promo">{BODY}</div></div>',
])
def test_the_article_stays(inner):
    assert html_extraction.main_text(page(inner)) == WANT


def test_small_marks_say_nothing():
    got = html_extraction.main_text(page(f'<div class="post">.</div>{BODY}'))
    assert got.endswith(WANT)
    assert html_extraction.main_text(page(f'<article><p class="ad-hoc">{PARTS[0]}</p>{BODY}</article>')) == PARTS[0] + "\n\n" + WANT
    assert html_extraction.main_text(page(f"<article>Hi.</article><div class='ad'>{'Buy this. ' * 30}</div>")) == "Hi."


def test_without_marks_the_same(spark):
    """Every mark of an article renamed: the windows alone give the same text on nearly all pages."""
    pages = [r.html or "" for r in table(spark, DATA, "pages").collect()]
    unmarked = lambda h: re.sub(r'role="(main|article)"', "", re.sub(r'(class|id)="(article|post|entry|story)[^"]*"', "", re.sub(r"<(/?)(article|main)\b", r"<\1div", h)))
    same = sum(html_extraction.main_text(h) == html_extraction.main_text(unmarked(h)) for h in pages)
    assert same >= 0.97 * len(pages)


def test_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string")
    assert html_extraction.extract_text(df).columns == ["page_id", "url", "text", "n_chars"] and html_extraction.extract_text(df).count() == 0
    assert html_extraction.main_text(None) == html_extraction.main_text("<form></form>") == html_extraction.main_text("<div class=ad></div>") == ""
