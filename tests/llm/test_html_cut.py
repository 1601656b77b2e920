"""Pages whose markup misleads: the cut against the tag rule and the classifier alone; names that lose no page."""

import pytest

from grainmill.llm import htmltext as H

PROSE = "<p>Some words of a real article stand here, in whole sentences, as one reads them every day.</p>"
TEXT = PROSE[3:-4]
LINKS = "".join(f'<li><a href="/{k}">Page number {k}</a>' for k in range(5))
ADVERTS = "".join(f'<p><a href="/{k}">Buy cheap shoes now</a></p>' for k in range(4))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<div class="content-with-sidebar"><article>{PROSE}</article></div>', [TEXT]),
        (f'<div class="layout sidebar-left"><article>{PROSE}</article></div>', [TEXT]),
        (f'<article class="recipe cookie">{PROSE}</article>', [TEXT]),
        (f'<div id="page-banner-wrap"><article>{PROSE}</article></div><p>x</p>', [TEXT]),
        (f'<div class="cookie"><main>{PROSE}</main></div>', [TEXT]),
        (f'<article>{PROSE}<section class="related-work">{PROSE}</section><p class="share-price">12.30</p>{PROSE}</article>', [TEXT, TEXT, "12.30", TEXT]),
        (f'<div class="related"><article>{PROSE}</article></div><main><p>Main words stand here, and there are many of them in it.</p></main>', ["Main words stand here, and there are many of them in it."]),
        (f'<article>{PROSE}</article><ol class="comment-list"><li><article class="comment">{PROSE}</article></ol>', [TEXT]),
        (f"<aside><article>{PROSE}</article></aside><article>{PROSE}</article>", [TEXT]),
        (f'<div class="ad-slot">{PROSE}</div><article>{PROSE}</article>', [TEXT]),
        (f"<article>{PROSE}<ul><li>one<li>two<li>three<li>four<li>five<li>six</ul></article>", [TEXT, "one", "two", "three", "four", "five", "six"]),
    ],
)
def test_names_lose_no_article(html, want):
    assert H.main_text(html).split("\n") == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # article text in an element named sidebar-left, a menu in another, and no article element
        (f'<div class="sidebar-left">{PROSE * 3}<p>12 Go</p>{PROSE}</div><div class="sidebar-right"><ul>{LINKS}</ul></div>', [TEXT] * 3 + ["12 Go", TEXT]),
        # adverts inside an article, without a class
        (f"<article>{PROSE * 2}<div>{ADVERTS}</div><p>Yes</p>{PROSE}</article>", [TEXT] * 2 + ["Yes", TEXT]),
    ],
)
def test_cut_beats_tags_and_text(html, want):
    page, content, alone = H.labelled(html, H.PRIOR)
    chosen = lambda by: [t for t, c in zip(page.texts, by, strict=True) if c]
    tags = [page.region[e] > 0 for e in page.element]
    assert chosen(content) == want
    assert chosen(tags) != want and chosen(alone) != want
    assert sum(a != b for a, b in zip(content, tags, strict=True)) >= 4


def test_hold_of_an_article_is_fitted(spark):
    pages = spark.createDataFrame([(k, f"<article>{PROSE * 4}</article><nav>{LINKS}</nav>") for k in range(30)], "page_id long, html string")
    weights, own = H.fit_pages(pages, "page_id", "html")
    assert own == H.OWN_HELD and len(weights) == len(H.FEATURES)
    odd = spark.createDataFrame([(k, f"<article>{PROSE if k % 2 else '<p>1 2</p>'}</article><nav>{LINKS if k % 2 else PROSE}</nav>") for k in range(30)], "page_id long, html string")
    assert H.LEAST_HELD <= H.fit_pages(odd, "page_id", "html")[1] < H.OWN_HELD
