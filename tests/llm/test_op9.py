import html
import re

import numpy as np
import pytest

from tallyloom.llm import html_extract as H
from tallyloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def net(spark):
    return H.fitted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def main_text(page):
    """Blocks of the article element, by plain splitting: enough for the pages of the tables."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inside.replace("<br>", " "))]
    return "\n\n".join(b for b in blocks if b)


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op9_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == main_text(pages[r.page_id].html) and r.n_chars == len(r.text)


def text_of(net, page):
    blocks = H.blocks_of(page)
    return [b.text for b, m in zip(blocks, net.label([blocks])[0], strict=True) if m]


PARAGRAPHS = ["Ertion of the haenbre and the ondre thation, inthe whenor.", "Thnt is in the onder, and erly of a then thaterin; the ered for it.", "Of this, ered onthe was."]


@pytest.mark.parametrize("main", ['<div class="post-content">', "<main>", '<article class="entry">', '<div id="content">'])
@pytest.mark.parametrize("form", ["div", "aside"])
def test_other_templates(net, main, form):
    """Pages built in other ways: sidebars, notices, forms and comments stay out, whatever holds the article."""
    name = main[1:].split(" ")[0].rstrip(">")
    body = "<h1>Thand inthe ered</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = (
        "<html><head><title>x</title></head><body><header><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav></header>"
        f'<{form} class="sidebar"><p>Related thand</p><ul><li><a href="/q">Onder</a></li></ul></{form}>'
        f'<div class="cookie-notice">We use cookies. <button>OK</button></div>{main}{body}</{name}>'
        '<form class="newsletter"><label>Mail</label><input name="m"></form><section class="comments"><p>Nice onthe thing!</p></section>'
        "<footer><p>&copy; 2024</p></footer></body></html>"
    )
    assert text_of(net, page) == ["Thand inthe ered", *PARAGRAPHS]


def labels_of(page):
    return [H.named_label(b) for b in H.blocks_of(page)]


@pytest.mark.parametrize(
    "page, labels",
    [
        ("<body class='has-sidebar'><article><p>a</p></article><div class='sidebar'>b</div></body>", [True, False]),
        ("<body><article class='post no-share'><p>a</p><div class='share'>b</div></article></body>", [True, False]),
        ("<body><div class='sidebar'><article><p>a</p></article></div></body>", [False]),
        ("<body class='search'><div class='menu'><div class='page'><main><p>a</p></main></div></div></body>", [True]),
        ("<article><figure><p>a</p><figcaption>b</figcaption></figure><article class='comment depth-1'>c</article></article>", [True, True, False]),
        ("<form><main class='post comments-open'>a</main></form><aside><article>b</article></aside>", [True, False]),
    ],
)
def test_labels(page, labels):
    assert labels_of(page) == labels


def mixed_pages(templates):
    """Pages of three templates, one a div of the site's own class names, one with figures, and their main texts."""
    rng = np.random.default_rng(11)
    stems = ["ond", "than", "ered", "hae", "whe", "ertio", "inth", "forn", "sel", "quar", "mist", "bole"]
    pages, wanted = [], []

    def words(n):
        return " ".join(stems[rng.integers(12)] + stems[rng.integers(12)] for _ in range(n))

    for i in range(90):
        blocks = [f"{words(4)}", *(words(12 + rng.integers(20)) + "." for _ in range(3 + rng.integers(4)))]
        body = "<h1>{}</h1>".format(blocks[0]) + "".join(f"<p>{b}</p>" for b in blocks[1:])
        kind = templates[i % len(templates)]
        if kind == 0:
            body = f'<div class="zq-region"><div class="zq-pane">{body}</div></div>'
        elif kind == 1:
            caption = words(9) + "."
            body = f"<article>{body}<figure><img src=x><figcaption>{caption}</figcaption></figure></article>"
            blocks.append(caption)
        else:
            body = f"<article>{body}</article>"
        menu = "".join(f'<li><a href="/">{words(1)}</a></li>' for _ in range(4))
        foot = f"<footer><p>&copy; {words(3)}</p></footer>"
        pages.append(f'<html><body class="has-sidebar"><nav><ul>{menu}</ul></nav>{body}<aside class="sidebar"><p>{words(6)}</p></aside>{foot}</body></html>')
        wanted.append(blocks)
    return pages, wanted


@pytest.mark.parametrize("templates", [(0, 1, 2), (0,)])
def test_a_template_without_article_is_not_empty(spark, templates):
    """All three templates, and a table whose pages all lack the elements that name their main text."""
    pages, wanted = mixed_pages(templates)
    rows = [(i, "u", p) for i, p in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in H.extracted(spark, table, H.fitted(table)).collect()}
    for k in templates:
        own = [i for i, *_ in rows if templates[i % len(templates)] == k]
        found = sum(len(set(got[i]) & set(wanted[i])) for i in own)
        false = sum(len(set(got[i]) - set(wanted[i]) - {""}) for i in own)
        assert found >= 0.95 * sum(len(wanted[i]) for i in own), k
        assert false <= 0.05 * found, k


def test_blocks():
    page = "<!-- a <p> --><script>var x='</p><p>no';</script><p>one <b>two<br>three</b>&amp;&nbsp;four<p>five <a href=x>six</a></p></p><ul><li>a<li>b</ul>tail<style>p{}</style>"
    got = H.blocks_of(page)
    assert [b.text for b in got] == ["one two three& four", "five six", "a", "b", "tail"]
    assert got[0].path == ("p",) and got[2].path == ("ul", "li") and got[1].linked > 0.3
    assert H.blocks_of("") == [] and H.blocks_of("<p>") == [] and [b.text for b in H.blocks_of("plain < text")] == ["plain < text"]
    assert [b.text for b in H.blocks_of("<div a='x>y' b=\">\">in</div><p unfinished")] == ["in"]
    assert H.blocks_of("<script>never closed <p>x") == []


@pytest.mark.parametrize("page", ["<" * 50_000, "<p " * 30_000, "<div a='" * 20_000, "<p>x</p>" * 20_000, "<div>" * 20_000 + "x", "&amp;" * 50_000])
def test_long_pages(page):
    H.blocks_of(page)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = H.train(["<article><p>a b c.</p><p>d e.</p></article><nav>x</nav>"] * 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((3, 4, 2 * H.DIM + H.NUMBERS)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0.0]])
    target = rng.integers(0, 2, (3, 4)).astype(float)

    def loss():
        out = net.forward(x, mask)
        p = 1 / (1 + np.exp(-out))
        return -(np.log(np.where(target > 0, p, 1 - p)) * mask).sum() / mask.sum()

    grads, dx = net.backward(x, mask, target)
    for weight, grad in [(net.p[k], grads[k]) for k in ("Wf", "Wb", "Uf", "Ub", "cf", "wo")] + [(x, dx)]:
        for at in list(np.ndindex(weight.shape))[:: max(1, weight.size // 3)]:
            old, values = weight[at], []
            for step in (1e-3, -1e-3):
                weight[at] = old + step
                values.append(loss())
            weight[at] = old
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=3e-2, abs=2e-4)


def test_odd_rows(spark, net):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "x"), (3, "u", "x"), (4, "u", "<article><p>" + "one two three. " * 20_000 + "</article>")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = H.extracted(spark, table, net).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, None)] == ["", "", ""]
    assert H.extracted(spark, table.limit(0), net).collect() == []
    assert H.fitted(table.limit(0)) is None
    assert {r.text for r in H.extracted(spark, table, None).collect()} == {""}
