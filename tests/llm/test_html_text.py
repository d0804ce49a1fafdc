import pytest

from callmetrics.llm import html_text


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def test_held_out_accuracy(model):
    pages = html_text.labelled(200, seed=77)
    same = sum(a == b for blocks, labels in pages for a, b in zip(model.decode(blocks), labels, strict=True))
    assert same / sum(len(y) for _, y in pages) >= 0.97


def test_an_article_among_everything_else(model):
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <div class="cookie-notice">We use cookies. <button>Accept</button></div><header class="masthead"><a href="/">Site</a></header>
    <nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Two</a></li></ul></nav><!-- x --><div class="ad">Buy this now.</div>
    <article><h1>Title &amp; more</h1><p>First  one<br>goes\n on.<p>Second &lt;b&gt; with <b>bold</b> and <a href=x>link</a>.</p><ul><li>Item one.</li></ul></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other</a></li></ul></aside><form><label>Mail</label><input><button>Go</button></form>
    <div class="comments"><h2>Comments</h2><div class="comment">I disagree with this.</div></div><footer>&copy; Site</footer></body></html>"""
    assert html_text.main_text(page, model) == "Title & more\n\nFirst one goes on.\n\nSecond <b> with bold and link.\n\nItem one."


def test_broken_pages(model, spark):
    pages = [None, "", "<", "&am", "<article><p>cut &amp", "<article><p>a<p>b", "<p" * 3000, "<article>" + "<p>x y z.</p>" * 2000 + "</article>"]
    frame = spark.createDataFrame([(i, p, "k") for i, p in enumerate(pages)], "page_id long, html string, text string")
    got = {r.page_id: r for r in html_text.extract(frame, model=model).collect()}
    assert got[0].main_text == got[1].main_text == "" and got[4].main_text == "cut &" and got[5].main_text == "a\n\nb"
    assert got[7].main_text == "\n\n".join(["x y z."] * 2000) and got[0].text == "k"
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string"), model=model).count() == 0


def test_viterbi_finds_the_best_labelling(model):
    from itertools import product

    blocks = html_text.labelled(5, seed=3)[2][0][:9]
    gain = [sum(model.weights.get(f, 0) for f in html_text.features(b)) + model.weights["bias"] for b in blocks]

    def score(y):
        return model.first[y[0]] + sum(g for g, v in zip(gain, y, strict=True) if v) + sum(model.step[a][b] for a, b in zip(y, y[1:]))

    best = max(product((0, 1), repeat=len(blocks)), key=score)
    assert model.decode(blocks) == [bool(v) for v in best]


AROUND = """<!DOCTYPE html><html><head><title>T</title></head><body><header class="site-header"><a href="/">Site name</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>{}<footer><p>&copy; 2024 Site. All rights reserved.</p></footer></body></html>"""


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<article><p>A short sentence.</p></article>", "A short sentence."),
        ("<article><p>Word</p></article>", "Word"),
        ('<article><p>Text before.</p><div class="ad">Buy now</div><p>Text after.</p></article>', "Text before.\n\nText after."),
        ("<article><h2>Comments</h2><p>He said more.</p><p>And the reply posted.</p></article>", "Comments\n\nHe said more.\n\nAnd the reply posted."),
        ('<article><p>Text before.</p></article><section class="comments"><h3>Comments</h3><p class="comment">I disagree.</p></section>', "Text before."),
        ("<main><h1>Title</h1><p>Yes.</p></main><aside><h3>Related</h3><ul><li><a href=x>Other</a></li></ul></aside>", "Title\n\nYes."),
        ('<div class="content"><p>Only a few words here</p><form><label>Mail</label><button>Subscribe</button></form></div>', "Only a few words here"),
    ],
)
def test_short_and_nested_articles(model, inner, want):
    assert html_text.main_text(AROUND.format(inner), model) == want


LONG = "Here is a paragraph that says a good deal about the matter at hand, and goes on for a while before it ends."
UNMARKED = [
    (f"<div><h1>A plain title</h1><p>{LONG}</p></div>", f"A plain title\n\n{LONG}"),
    (f"<div><h1>A plain title</h1><p>{LONG}</p><p>{LONG}</p></div>", f"A plain title\n\n{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=/1>First reference link</a></li><li><a href=/2>Second reference</a></li></ul><p>{LONG}</p></article>", f"{LONG}\n\nFirst reference link\n\nSecond reference\n\n{LONG}"),
    (f"<main><h2>See also</h2><ul><li><a href=/1>Another page</a></li></ul><p>{LONG}</p></main>", f"See also\n\nAnother page\n\n{LONG}"),
    (f"<article><header><h1>Big title</h1></header><p>{LONG}</p></article>", f"Big title\n\n{LONG}"),
    (f"<article><header><h1>Big title</h1><p>And a line below it.</p></header><p>Short.</p></article>", "Big title\n\nAnd a line below it.\n\nShort."),
    (f'<article><p>{LONG}</p><nav><ul><li><a href=/1>Next</a></li></ul></nav><aside><h3>More</h3><ul><li><a href=/2>Other</a></li></ul></aside></article>', LONG),
]


@pytest.mark.parametrize(("inner", "want"), UNMARKED)
@pytest.mark.parametrize("frame", [AROUND, "<html><body>{}</body></html>"])
def test_unmarked_articles_titles_in_headers_and_link_lists(model, frame, inner, want):
    assert html_text.main_text(frame.format(inner), model) == want


def test_gradient_against_enumeration():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(3)
    x, lengths = (rng.random((3, 4, 5)) < 0.5).astype(float), (4, 2, 1)
    here = np.array([[t < n for t in range(4)] for n in lengths])
    y = rng.integers(0, 2, (3, 4)) * here
    x *= here[..., None]
    theta = rng.normal(size=11)

    def counts(p, labels):
        c = np.zeros(11)
        for t, v in enumerate(labels):
            c[:5] += v * x[p, t]
            c[9 + v if t == 0 else 5 + 2 * labels[t - 1] + v] += 1
        return c

    loss, slope = 0.0, np.zeros(11)
    for p, n in enumerate(lengths):
        every = [counts(p, labels) for labels in product((0, 1), repeat=n)]
        weight = np.exp([c @ theta for c in every])
        gold = counts(p, [int(v) for v in y[p, :n]])
        loss += np.log(weight.sum()) - gold @ theta
        slope += weight @ np.array(every) / weight.sum() - gold
    got = html_text.likelihood(x, y, here, theta)
    assert abs(got[0] - loss / 3) < 1e-9 and np.allclose(got[1], slope / 3)


def test_repeated_rows_and_clashing_names(spark, model):
    frame = spark.createDataFrame([(1, "<article><p>a b.</p></article>", "x", 9)] * 2, "page_id long, html string, main_text string, blocks long")
    got = html_text.extract(frame, model=model).collect()
    assert [(r.page_id, r.main_text, r.blocks) for r in got] == [(1, "a b.", 1)] * 2
