"""Operator 1: the line-block windows decide on pages with article elements too."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomescope.llm import html_text

STORY = ["This is paragraph number %d of the story, which stands in a plain element and is long enough to surge." % k for k in range(6)]
MENU = "<div><a href=a>Menu one</a></div><div><a href=b>Menu two</a></div>"


def test_story_beside_a_teaser_article():
    teaser = "<article><h2>Teaser</h2><p>Read this one too.</p></article>"
    got = html_text.main_text(f"<html><body>{MENU}<div>{'</div><div>'.join(STORY)}</div>{MENU}{teaser}{MENU}</body></html>")
    assert got == "\n\n".join([*STORY, "Teaser", "Read this one too."])


def test_articles_of_unequal_length():
    page = f"<html><body>{MENU}<article><p>{'</p><p>'.join(STORY)}</p></article>{MENU}<article><p>Short one.</p></article>{MENU}</body></html>"
    assert html_text.main_text(page) == "\n\n".join([*STORY, "Short one."])


def test_menu_and_scraps_outside_an_article_go():
    scraps = f"{MENU}<div>Tiny</div>{MENU}"
    assert html_text.main_text(f"<html><body>{scraps}<article><p>{'</p><p>'.join(STORY)}</p></article>{scraps}</body></html>") == "\n\n".join(STORY)


def test_class_words_only_mark():
    """A story in a container whose class sounds like an advert stays; a container with less text than the article goes."""
    story = f"<p>{'</p><p>'.join(STORY)}</p>"
    assert html_text.main_text(f'<html><body>{MENU}<div class="story promotion-review">{story}</div>{MENU}</body></html>') == "\n\n".join(STORY)
    assert html_text.main_text(f'<html><body>{MENU}<div class="promotion">{story}</div>{MENU}</body></html>') == "\n\n".join(STORY)
    table = '<table class="share-price-table"><tr><td>Price: 12</td></tr></table>'
    assert html_text.main_text(f"<body><article>{story}{table}</article></body>") == "\n\n".join([*STORY, "Price: 12"])
    for word in ("comments", "cookie-notice", "ad", "site-footer", "related-links"):
        assert html_text.main_text(f'<body><article>{story}</article><div class="{word}">{story}</div></body>') == "\n\n".join(STORY)


BAD = ["<a ", '<a "', "<a '>", "<b>", "</b>", "<svg/>", "<a \"'", "<!--", "<div class=", "<script>", '<p a"b>', "<a href=x>t", "<i '><i \">"]


@pytest.mark.parametrize("bad", BAD)
def test_malformed_pages_take_time_by_length(bad):
    times = []
    for size in (100_000, 400_000):
        page = f"<p>{STORY[0]}</p>" + bad * (size // len(bad))
        start = time.process_time()
        html_text.main_text(page)
        times.append(time.process_time() - start)
    assert times[1] < 1 + 8 * times[0]  # in proportion to the length: quadratic work takes 16 times as long


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200), st.integers(0, 1)), max_size=25), st.integers(1, 4))
def test_windows_by_brute_force(rows, window):
    lines = [("x" * n, min(n, k), root, 0) for n, k, root in rows]
    weight = [n if root else n - min(n, k) if 2 * min(n, k) <= n else 0 for n, k, root in rows]
    lift = [w + html_text.SURGE if root and w else w for w, (_, _, root) in zip(weight, rows, strict=True)]
    least = max(1, min(html_text.SURGE, max((sum(weight[i : i + window]) for i in range(len(rows))), default=0) // 4))
    want, inside = [], False
    for i, (text, *_) in enumerate(lines):
        if not weight[i]:
            inside = False
        elif sum(lift[i : i + window]) >= least:
            inside = True
        if inside:
            want.append(text)
    assert html_text.main_lines(lines, window) == want
