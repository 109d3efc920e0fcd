"""Main text of pages against an independent extractor; regions found by the cluster alone; hostile pages."""

import html as entities
import re
import time

import pytest

from scholarlake.llm import html_extraction

LONG = "This is a paragraph of the article with quite enough words in it to count as content of the page."


def plain_extractor(page):
    """The given pages' own layout: everything between the article's tags, cut at block tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote|pre|table|tr|td)\b[^>]*>", re.sub(r"<br[^>]*>", " ", body))
    out = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
    return "\n".join(b for b in out if b)


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(rows) >= 50
    for r in rows:
        assert html_extraction.main_text(r.html) == plain_extractor(r.html)
    # the same pages without the names that give the region away
    for r in rows[:80]:
        bare = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_extraction.main_text(bare) == plain_extractor(r.html)


LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Other story {k}</a></li>" for k in range(8)) + "</ul>"


def test_smoothing_decides(monkeypatch):
    page = f"<body><div>{LINKS}</div><div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>{LONG}</p></div><div><p><i>x</i> <i>y</i> legal</p></div></body>"
    want = f"Head\n{LONG}\nShort.\n{LONG}\n{LONG}"
    assert html_extraction.main_text(page) == want
    monkeypatch.setattr(html_extraction, "smooth", lambda ratios: ratios * 0)
    assert html_extraction.main_text(page) != want


def test_lists_of_links_in_an_article_fall():
    page = f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG} <a href=/a>with a link</a></p><p>{LONG}</p>{LINKS}</article>"
    got = html_extraction.main_text(page).split("\n")
    assert got[:4] == ["Head", LONG, f"{LONG} with a link", LONG] and len(got) <= 6


@pytest.mark.parametrize("page", ["<font>x<div>" * 100_000, "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p class=ad>x" * 50_000, "<article class='comment'>y" * 50_000, "<b><p>z" * 100_000], ids=range(5))
def test_unclosed_tags_take_linear_time(page):
    began = time.time()
    html_extraction.main_text(page)
    assert time.time() - began < 20


def test_extract_whole_table(spark):
    df = spark.createDataFrame([(1, "u", None, 7), (2, None, "", 7), (3, "u", f"<p>{LONG}", 7), (3, "u", f"<p>{LONG}", 7), (None, "v", "x &amp; y " * 200_000, 7)], "page_id long, url string, html string, n_chars long")
    out = sorted(html_extraction.extract(df).collect(), key=str)
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 3] == [LONG, LONG] and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert next(r.n_chars for r in out if r.page_id is None) == 6 * 200_000 - 1
    assert html_extraction.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece, end", [("<a ", ""), ("<!--x", ""), ("<!--x", ">"), ("<a ", ">"), ("</a ", ""), ("<?x", ""), ("<![CDATA[", ">"), ("&#12", "")])
def test_malformed_markup_takes_linear_time(piece, end):
    import time

    began = time.process_time()
    text = html_extraction.main_text("<p>Before.</p><!-- c -->" + piece * 100_000 + end)
    assert text.startswith("Before.") and time.process_time() - began < 5


def test_unterminated_markup_is_text():
    for page, want in (("<p>a <b", "a <b"), ("<p>a</p>&amp;<i", "a\n&<i"), ("<div>1 < 2</div> <!-- c -->tail <!-- d", "1 < 2\ntail <!-- d"), ("<p>x</p><script>a</script", "x")):
        assert html_extraction.main_text(page) == want
