"""Pages whose wrappers, languages or markup once hid their text."""

import pytest

from sondeo.llm import html_text

LONG = "It is the first of the paragraphs and it has many words and it goes on for long enough to be decided."
POLISH = "W tym roku szkoła przygotowała dla uczniów nowe zajęcia z matematyki, które odbywają się po lekcjach i cieszą się wielkim powodzeniem."
CHINESE = "这所学校今年为学生们准备了新的数学课程，课程安排在放学以后，受到了学生和家长们的热烈欢迎。老师们也很高兴，因为越来越多的孩子喜欢上了数学。"
NAV, FOOT = "<nav><a href=x>Menu</a></nav>", "<footer>Kontakt</footer>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'{NAV}<div class="content no-sidebar"><article><p>{LONG}</p></article></div>{FOOT}', LONG),
        (f'<div class="post has-social"><p>{LONG}</p></div>', LONG),
        (f'<div class="single comments-open"><p>{LONG}</p></div>', LONG),
        (f'<div class="layout sidebar"><article><p>{LONG}</p></article></div><div class="sidebar"><p>{LONG} No.</p></div>', LONG),
        (f'<article><p class="mt-4 hidden md:block">{LONG}</p></article>', LONG),
        (f'<article><p title="the hidden cost">{LONG}</p></article>', LONG),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p></article>", LONG),
        (f"<form action=x><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></form>", f"Head {LONG} {LONG}"),
        (f"<article><p>{LONG}</p><form><p>Your name and the text of your comment to the editors of the paper.</p></form></article>", LONG),
        (f"{NAV}<div class=content><p>{POLISH}</p></div>{FOOT}", POLISH),
        (f"{NAV}<div class=content><p>{CHINESE}</p></div>{FOOT}", CHINESE),
        (f"{NAV}<div><p>Roses are red,</p><p>violets are blue.</p></div>{FOOT}", "Roses are red, violets are blue."),
        ("<p>Roses are red.</p>", "Roses are red."),
        (f"<article><div><svg><path d=1></div><p>{LONG}</p></article>", LONG),
        (f"<article><div><button>Go</div><p>{LONG}</p><button>x</button></article>", LONG),
        (f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG} More.</p></article></div>", LONG),
        (f'{NAV}<div class="cookie-notice"><p>We and our partners use cookies on this page.</p></div>{FOOT}', ""),
        ("<div class=x><a href=x>only</a> <a href=y>links</a></div>", ""),
        # Equally near neighbours that disagree: main text.
        (f"<div><p>{LONG}</p><p>Short.</p><p><a href=x>A list of links</a></p></div>", f"{LONG} Short."),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == want


def test_very_long_page():
    page = "<article>" + f"<p>{LONG}</p>" * 20_000 + "<p class=share><b>x"
    assert html_text.main_text(page) == " ".join([LONG] * 20_000)
