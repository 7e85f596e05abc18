"""Which constant texts belong to the content region, on pages whose main text is known."""

import random

import pytest

from colloquy.llm import html_extract
from tests.llm.conftest import prose


def _texts(spark, pages, **options):
    rows = [(i, f"http://h{host}.example/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).orderBy("page_id").collect()]


def test_section_headings_and_standing_sentences_stay(spark):
    page = "<article><h1>Report {0}</h1><h2>Introduction</h2><p>Opening words of page {0}, its own {0}.</p><p>All figures are in thousands.</p><p>More of {0} here.</p><section><h2>Conclusion</h2><p>Closing words of {0}.</p></section><p>Follow us every day</p></article>"
    found = _texts(spark, [(0, page.format(i)) for i in range(6)])
    assert found == ["Report {0}\nIntroduction\nOpening words of page {0}, its own {0}.\nAll figures are in thousands.\nMore of {0} here.\nConclusion\nClosing words of {0}.".format(i) for i in range(6)]


def test_constant_boxes_beside_the_region_go(spark):
    page = "<article><h1>Report {0}</h1><div><p>Our paper comes out daily</p><p>Write to us</p></div><p>Own words of {0} and {0} again.</p><p>The end of {0}.</p></article>"
    assert _texts(spark, [(0, page.format(i)) for i in range(6)]) == ["Report {0}\nOwn words of {0} and {0} again.\nThe end of {0}.".format(i) for i in range(6)]


def test_a_heading_opens_the_region(spark):
    page = "<article><h2>Summary</h2><p>Own words of {0} and {0} again.</p></article>"
    assert _texts(spark, [(0, page.format(i)) for i in range(6)]) == [f"Summary\nOwn words of {i} and {i} again." for i in range(6)]


def _generated(rng, host, kind):
    """A page and its main text: menus and boxes without telling names, an article by its tag or only by what varies."""
    say = lambda n: " ".join(prose(rng, n)).capitalize() + "."
    menu = "".join(f"<li><a href='/{k}'>{host} section {k}</a></li>" for k in range(5))
    title, parts, text = say(4), [], []
    for k in range(rng.randint(2, 4)):
        own = [say(rng.randint(8, 40)) for _ in range(rng.randint(1, 3))]
        parts.append(f"<section><h2>{host} part {k}</h2>{''.join(f'<p>{p}</p>' for p in own)}</section>")
        text += [f"{host} part {k}", *own]
    tag = "article" if kind else "div"
    body = f"<{tag}><h1>{title}</h1>{''.join(parts)}<div><p>{host} stays with you</p><p>{host} says thanks</p></div></{tag}>"
    page = f"<html><body><div><ul>{menu}</ul></div><div><p>{host} welcomes all readers to these pages</p></div>{body}<div class='comments'><p>{say(6)}</p></div><div><p>{host} is printed on paper</p></div></body></html>"
    return page, "\n".join([title, *text])


@pytest.mark.parametrize("kind", [True, False])
def test_generated_pages_give_their_known_text(spark, kind):
    rng = random.Random(kind)
    pages = [(h, *_generated(rng, f"site{h}", kind)) for h in range(3) for _ in range(25)]
    found = _texts(spark, [(h, page) for h, page, _ in pages])
    right = sum(a == b for a, (_, _, b) in zip(found, pages))
    assert right == len(pages), next((a, b) for a, (_, _, b) in zip(found, pages) if a != b)
    without = _texts(spark, [(h, page) for h, page, _ in pages], min_pages=10_000)
    assert sum(a == b for a, (_, _, b) in zip(without, pages)) == 0  # it is the wrapper that finds the region
