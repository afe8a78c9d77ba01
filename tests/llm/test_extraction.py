"""Main text of pages whose article is known."""

import random

import pytest
from ostinato.llm.extraction import extract_main_text, main_blocks, parse


def text_of(page):
    return "\n".join(b.text for b in main_blocks(parse(page)[1]))


PAGES = [
    ("", ""),
    ("plain  text\n only", "plain text only"),
    ("<p>a<p>b", "a\nb"),
    ("<article><h1>T &amp; x</h1><p><b>one<br>two<p>three <i>four</i>five</article><p>out</p>", "T & x\none two\nthree fourfive"),
    ("<nav>menu</nav><p>a &lt;b&gt; &eacute;</p><script>var x='<p>no</p>'</script><style>p{}</style>", "a <b> é"),
    ("<!DOCTYPE html><!-- <p>no</p> --><p>x<!-- y -->z</p><!-- open", "xz"),
    ("<header>h</header><main><article><header><h1>Title</h1></header><p>t</p></article></main><footer>f</footer>", "Title\nt"),
    ('<div class="post"><p>text</p></div><div class="sidebar-left"><p>side</p></div><div id="comments"><p>c</p></div>', "text"),
    ('<article><p>a</p><div class="ad">buy</div><aside>x</aside><form>f<input></form><section class="comments"><p>r</p></section><p>b</p></article>', "a\nb"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ('<div style="display: none">x</div><div hidden>y</div><p aria-hidden="true">z</p>w', "w"),
    ("<body class='has-sidebar'><p title='a>b'>x</p></body>", "x"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<div><a href='/'>Home</a> <a href='/x'>About us</a></div><p>story with <a href='#'>a link</a> in it</p>", "story with a link in it"),
    ('<div class="cookie-notice">We use</div><div role="navigation">n</div><div id="shareButtons">s</div><p>t</p>', "t"),
    ("<p>a</p></div></b><p>b</p>", "a\nb"),
    ("<pre>x\n  y</pre><blockquote>q</blockquote>", "x y\nq"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_structure(page, want):
    assert text_of(page) == want


def test_broken_markup_takes_linear_time():
    for part in ("<a ", "<!", "<a '", "<", "</", "<p title=\"", "&", "<script>", "<!--"):
        page = part * 40_000
        assert parse(page) is not None


def site(host, n, rng):
    """Pages of a host whose frame has no telling names, and the texts of their articles."""
    rows = []
    for k in range(n):
        body = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 5))]
        page = f"<html><body><div class='top'><p>The {host} gazette</p></div><div class='box'>" + "".join(f"<p>{p}</p>" for p in body)
        page += "</div><div class='low'><p>All stories since 1901</p></div></body></html>"
        rows.append((f"https://{host}/{k}", page, "\n".join(body)))
    return rows


def test_templates(spark):
    rng = random.Random(1)
    known = site("one.example", 40, rng) + site("two.example", 5, rng)
    few = site("few.example", 2, rng)
    rows = [(i, url, page, None) for i, (url, page, _) in enumerate([*known, *few])]
    more = [(900, None, None, "x"), (901, "no url", "<p>x</p>", "x"), (None, "http://a.b/", "<p>y</p>", "x"), (902, "http://c.d/?q", "", "x")]
    same = [(1000 + k, f"http://same.example/{k}", "<p>only this</p>", "x") for k in range(6)]
    pages = spark.createDataFrame([*rows, *more, *same, more[1]], "page_id long, url string, html string, text string")
    found = extract_main_text(pages).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows) + len(more) + len(same) + 1
    assert all(r.n_chars == len(r.text) for r in found)
    for i, (_, _, want) in enumerate(known):
        assert by_id[i].text == want
    for i in range(len(known), len(known) + len(few)):  # too few pages to tell what is common
        assert by_id[i].text.startswith("The few.example gazette\n")
    assert [by_id[i].text for i in (900, 901, None, 902)] == ["", "x", "y", ""]
    assert all(by_id[1000 + k].text == "only this" for k in range(6))  # never all of a page
    assert by_id[0].url == rows[0][1]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_common_passage_stays(spark):
    """A passage that many articles quote is no template: its element comes with other text too."""
    rng = random.Random(2)
    rows = []
    for i in range(30):
        paragraphs = [" ".join(rng.choices("abcdefgh", k=9)) for _ in range(3)] + (["a common passage"] if i % 3 else [])
        rows.append((i, "http://h.example/", "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>", "\n".join(paragraphs)))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_main_text(pages).collect()} == {r[0]: r[3] for r in rows}
