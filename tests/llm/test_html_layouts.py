"""Short articles in all containers, controls, odd pages and the time that pages take."""

import time

import pytest

from codegov.llm import html_blocks, html_text, html_training

WORDS = "the quick brown fox jumps over the lazy dog and then it runs away through the long dark forest until morning comes again"
FRAMES = (
    ("", ""), ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", "<footer><p>&copy; 2024 Example Ltd</p></footer>"),
    ('<header><div>Site name</div></header><div class="menu"><ul><li><a href=/>One</a></li><li><a href=/>Two</a></li></ul></div>', "<aside class=sidebar><h3>Related</h3><ul><li><a href=/>A b c</a></li></ul></aside>"),
)


@pytest.mark.parametrize("tag", ["div class=content", "div id=content", 'div class="article-body"', 'div class="entry-content"', "div class=post", "article", "main"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_short_articles_without_a_heading(tag, n):
    paragraphs = [f"Paragraph number {k}: {WORDS}, {WORDS}." for k in range(n)]
    for before, after in FRAMES:
        page = f"<html><body>{before}<{tag}>{''.join(f'<p>{p}</p>' for p in paragraphs)}</{tag.split()[0]}>{after}</body></html>"
        assert html_text.main_text(html_text.trained(), page) == "\n\n".join(paragraphs)


def test_what_controls_say_is_no_text():
    page = f"<article><h1>Title of it</h1><p>{WORDS} <button type=button>Share <b>it</b></button> {WORDS}. <label>Mail</label></p><p>{WORDS} <button>left open</p></article>"
    assert html_text.main_text(html_text.trained(), page) == f"Title of it\n\n{WORDS} {WORDS}.\n\n{WORDS} left open"


def test_blocks_of_generated_pages_that_the_field_has_not_seen():
    field, hit, extra, lost = html_text.trained(), 0, 0, 0
    for found, labels in html_training.labelled_pages(300, seed=99):
        for got, want in zip(field.decode(html_text.features(found)), labels, strict=True):
            hit, extra, lost = hit + (got and want), extra + (got and not want), lost + (want and not got)
    assert hit / (hit + extra) > 0.97 and hit / (hit + lost) > 0.97


@pytest.mark.parametrize("part", ["<a ", '<a ">" ', "<div>", "<h1>", "</x>", "<script ", "</script ", "<script></script ", "<td></td>", "<button>", "<p>x", "<!--", '<a title="', "<li><div>"])
def test_pages_take_time_in_proportion(part):
    def seconds(n):
        began = time.process_time()
        html_text.main_text(html_text.trained(), part * n)
        return time.process_time() - began

    html_text.trained()
    n = 400_000 // len(part)
    assert seconds(n) < 12 * min(seconds(n // 4) for _ in range(2)) + 0.3


def test_blocks_of_broken_tags():
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text("a < b <p>c</p> <3 d") == ["a < b", "c", "<3 d"]
    assert text("<p>x</p><p title='a>b'>y</p><a href=\"q>r") == ["x", "y", "r"]
    assert text("<p>it's</p><p>z</p>") == ["it's", "z"] and text("<!-- <p>no</p> --><p>yes") == ["yes"] and text("<p>open <b") == ["open <b"]
    assert text("</div></p><ul><li>1<li>2</ul></ul>3") == ["1", "2", "3"] and text("<script>a</scriptx>b</script >c") == ["c"]
    many = html_blocks.blocks("".join(f'<div class="w{k} content">x' for k in range(3000)), frozenset({"content", "<div"}))
    assert len({id(b.around) for b in many}) == 1 and many[-1].around == {"content", "<div"}


def test_odd_pages(spark):
    long = f"<article>{f'<p>{WORDS}.</p>' * 4000}</article>"
    rows = [(1, "u", long), (2, "u", f"<article><p>{WORDS}."), (2, "u", f"<article><p>{WORDS}."), (None, None, f"<main><p>{WORDS}.</p></main></div></div>"), (3, "", "no tags"), (4, "u", "&lt;" * 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as text", "1 as n_chars")
    got = [tuple(r) for r in html_text.extract(table).collect()]
    by = lambda i: [r for r in got if r[0] == i]
    assert len(got) == len(rows) and by(1)[0][2] == "\n\n".join([f"{WORDS}."] * 4000) and by(2) == [(2, "u", f"{WORDS}.", len(WORDS) + 1)] * 2 and by(None)[0][2] == f"{WORDS}."
    assert all(r[3] == len(r[2]) for r in got)
    assert html_text.extract(table.limit(0)).count() == 0
