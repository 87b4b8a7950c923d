"""Elements whose text is never shown: where they end."""

import time

import pytest

from tarnwick.llm.html_extract import blocks


def shown(page):
    return " ".join(b.text for b in blocks(page))


@pytest.mark.parametrize("page, want", [
    ("<p>one <svg-icon name='x'>two</svg-icon> three</p><p>four</p>", "one two three four"),
    ("<title-bar>one</title-bar><p>two</p>", "one two"),
    ("<select-box>one</select-box><p>two</p><select><option>no</select>", "one two"),
    ("<p>one <svg viewBox='0 0 1 1'/> two</p><p>three</p>", "one two three"),
    ("<p>one <svg data-x='a>b'/> two</p>", "one two"),
    ("<p>one <svg><path/><text>no</text></svg> two</p>", "one two"),
    ("<p>one</p><select><p>two</p>", "one two"),
    ("<p>one</p><object data=x><p>two</p>", "one two"),
    ("<p>one</p><script>no<p>no</p>", "one"),
    ("<p>one</p><style>no<p>no</p>", "one"),
    ("<p>one</p><script>a</script ><p>two</p>", "one two"),
])
def test_end_of_raw_elements(page, want):
    assert shown(page) == want


def test_many_unclosed_elements_take_linear_time():
    start = time.monotonic()
    assert shown("<object>word " * 100_000).count("word") == 100_000
    assert time.monotonic() - start < 20


def test_pages_labelled_by_hand():
    """54 layouts that the generator does not make; the figures are in the README."""
    from tarnwick.llm.html_extract import train
    from tarnwick.llm.html_pages import labelled_pages
    from tests.llm.hand_pages import PAGES

    field = train(labelled_pages())
    got = [(field.extract(page), main) for page, main in PAGES]
    assert sum(a == b for a, b in got) >= 50
    assert all(a for a, b in got if b)


def test_layouts_that_name_their_state(spark):
    """No article is lost to a wrapper's or a page's name, and no advert or comment inside or beside it is kept."""
    from tarnwick.llm.html_extract import extract_main
    from tests.llm.hand_pages import LAYOUTS

    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(LAYOUTS)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main(df).collect()}
    assert [(LAYOUTS[i][0], t) for i, t in got.items() if t != LAYOUTS[i][1]] == []
