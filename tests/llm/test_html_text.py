import html
import re

import numpy as np
import pytest

from capweave.llm import html_text as H


def page(article, wrap="article", extra=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body>"
        "<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><!-- <p>no</p> -->"
        f'<div class="cookie-notice">We use cookies</div><aside><p>Popular posts</p></aside><{wrap}>{article}</{wrap.split()[0]}>{extra}'
        '<form><label>Mail</label><input></form><div id="comments"><p>I liked it a lot</p></div><div class="ad">Buy now</div>'
        "<footer>&copy; Site</footer></body></html>"
    )


@pytest.fixture(scope="module")
def trained(sf_dir):
    import pyarrow.parquet as pq

    return H.train(pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"])["html"].to_pylist()[: H.PAGES])


def test_the_pages_of_the_table(trained, sf_dir):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"])["html"].to_pylist()
    right = 0
    for source, text in zip(pages, H.main_texts(pages, trained)):
        inside = re.search("<article>(.*)</article>", source, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        right += text == "\n".join(p for p in parts if p)
    assert right >= 0.98 * len(pages)


@pytest.mark.parametrize("wrap", ["article", "main", 'div class="content"', 'section id="main-content"'])
def test_roles_that_the_sample_lacks(trained, wrap):
    body = "<h1>The head line</h1><p>First paragraph of the story, with <b>bold</b> words &amp; more.<p>A second\n one.<blockquote>Somebody said so.</blockquote><p>The end."
    want = ["The head line", "First paragraph of the story, with bold words & more.", "A second one.", "Somebody said so.", "The end."]
    got = H.main_texts([page(body, wrap)], trained)[0].split("\n")
    assert len(set(got) & set(want)) >= 4 and not {"Home", "About", "Buy now", "© Site", "We use cookies", "Popular posts", "I liked it a lot"} & set(got)


def test_blocks_of_broken_markup():
    texts = lambda x: [b[0] for b in H.blocks(x)]
    assert texts("") == [] and texts("plain") == ["plain"] and texts("<p>a<p>b</b></i>c<br>d") == ["a", "bc d"]
    assert texts("<script>x<p>y") == [] and texts("<!-- x <p>y") == [] and texts("a <!-- b --> c") == ["a c"]
    assert texts('<a title="x > y" href=z>q</a>') == ["q"] and texts("1 < 2 &lt;p&gt; &eacute;&#65;") == ["1 < 2 <p> éA"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("<div>" * 3000 + "deep") == ["deep"]


def test_the_gradient_is_that_of_the_loss(monkeypatch):
    draw = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in H._start(1).items()}
    size = H.PATH_SIZE + H.WORD_SIZE + H.NUMBERS
    rows = [draw.standard_normal((n, size)) * 0.3 for n in (4, 2)]
    y = np.zeros((2, 4))
    y[0, 1] = y[1, 0] = 1

    def loss(p):
        prob, (x, mask, *_rest) = H.scores(rows, p, keep=True)
        return -(np.where(y > 0, np.log(prob), np.log(1 - prob)) * mask).sum()

    prob, (x, mask, both, tf, tb) = H.scores(rows, p, keep=True)
    dz = (prob - y) * mask
    dboth = dz[:, :, None] * p["o"]
    slope = H._back(dboth[:, :, : H.HIDDEN], x, tf, p, "f") | H._back(dboth[:, :, H.HIDDEN :], x, tb, p, "b")
    for name in ("xf", "hf", "cf", "xb", "hb", "cb"):
        for _ in range(3):
            at = tuple(draw.integers(0, n) for n in p[name].shape)
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - slope[name][at]) < 2e-3 + 0.02 * abs(slope[name][at]), name


def test_odd_rows(spark):
    body = "<p>" + "word " * 20_000 + "</p>"
    rows = [(1, "u", page("<p>One story here.</p>")), (1, "u", page("<p>One story here.</p>")), (2, None, None), (3, "u", ""), (4, "u", page(body)), (None, "u", "<nav>x</nav>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS text", "1 AS n_chars", "0 AS extra")
    got = H.extract(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got) and "extra" in got[0]
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert H.extract(frame.limit(0)).count() == 0
    assert {r.text for r in H.extract(frame.filter("page_id = 3")).collect()} == {""}
