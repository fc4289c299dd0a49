"""Wrappers and main text on pages whose main text is known."""

import random
from html import escape

import pytest
from pyspark.sql import functions as F

from eligo.llm import wrappers as W


def sentence(rng, n=12):
    return " ".join(rng.choice(["river", "moss", "A & B", "x < y", "naïve", "quiet", "42"]) for _ in range(rng.randrange(3, n)))


def noisy(rng, blocks, style):
    """A page with the blocks as main text amid all that is none; the way to mark them differs by style."""
    inner = "\n".join(f"<{t}>{escape(x)}" + (f"</{t}>" if rng.random() < 0.8 or t != "p" else "") for t, x in blocks)
    extra = rng.choice(["", "<aside>Read also <a href=x>this</a></aside>", '<div class="ad-box">Buy now</div>', "<form><p>Your mail</p><input><button>Go</button></form>", "<script>if (a</p>b) {}</script>"])
    comments = '<section id="comments"><h3>Comments</h3>' + "".join(f"<article class='comment'><p>I say {i} {sentence(rng)}</p></article>" for i in range(rng.randrange(3))) + "</section>"
    body = {
        "article": f"<article class='post'><header><h1>Title of it</h1><p>By someone</p></header>{extra}{inner}<footer>Tags: a</footer></article>{comments}",
        "main": f"<main><div>{inner}{extra}</div></main>",
        "plain": f"<div class='story-text'>{inner}</div><div class='more'><ul><li><a href=1>Other story with a long name</a><li><a href=2>One more story with a long name</a></ul></div>",
    }[style]
    side = "<div class='sidebar'><h4>Latest</h4><p>Side text " + sentence(rng) + "</p></div>"
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p > a {{}}</style></head><body class='has-sidebar'><header class='top'><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>"
        f"<!-- <p>not seen</p> --><div role='alert'>We use cookies</div>{body}{side}<footer><p>&copy; Site</p></footer>" + rng.choice(["</body></html>", "", "</body"])
    )


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(90):
        style = ["article", "main", "plain"][i % 3]
        blocks = [("h2", "Part one")] * (i % 2) + [(rng.choice(["p", "p", "p", "blockquote"]), f"{i} {sentence(rng, 40)}") for _ in range(rng.randrange(2, 9))]
        rows.append((i, f"https://{style}.example.org/{i}?q=1", noisy(rng, blocks, style)))
        want[i] = "\n".join(([] if style != "article" else ["Title of it"]) + [x for _, x in blocks])
    return rows, want


def test_main_text(spark, pages):
    rows, want = pages
    more = [(100, None, "<p>a&nbsp;&amp;\n b<br>c</p>"), (101, "x", None), (102, "http://h/", ""), (103, "http://h/", "<div" * 3), (None, "http://h/", "<article>n"), (5, rows[5][1], rows[5][2])]
    more += [(104, "http://d/", "<div>" * 4000 + "deep" + "</div>" * 4000), (105, "http://w/", "<main>" + "".join(f"<{t}>{k}</{t}>" for k in range(900) for t in ("p", "h2", "ul", "pre", "div")[: 1 + k * 7 % 5]) + "</main>")]
    more += [(106, "http://l/", "<article><p>" + "long & wide " * 100_000 + "</article>"), (107, "http://q/", "<article title='a > b'><p class=x'>it's <b>so</p><p>next</b> one</p> tail &lt;p&gt; &#x41; &bogus;")]
    df = spark.createDataFrame(rows + more, "page_id long, url string, html string").repartition(5).withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = W.main_text(df)
    assert [f"{c} {t}" for c, t in got.dtypes] == ["page_id bigint", "url string", "text string", "n_chars bigint"]
    out = got.collect()
    assert len(out) == len(rows + more) and all(r.n_chars == len(r.text) for r in out)
    text = {r.page_id: r.text for r in out}
    assert {i: text[i] for i in want} == want
    assert text[100] == "a & b c" and text[101] == text[102] == text[103] == "" and text[None] == "n" and text[104] == "deep"
    assert len(text[105].split("\n")) == sum(1 + k * 7 % 5 for k in range(900)) and text[106] == ("long & wide " * 100_000).strip()
    assert text[107] == "it's so\nnext one\ntail <p> A &bogus;"
    assert W.main_text(df.limit(0)).count() == 0
    assert W.main_text(df.limit(3).repartition(16)).count() == 3  # tasks without rows


def test_a_host_is_aligned_in_rounds(spark, pages):
    rows, want = pages
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("one")).repartition(8)
    assert [W.Node.read(__import__("json").loads(r.wrapper)).held[0] for r in W.wrappers(df, fan=2).collect()] == [90]
    assert [W.Node.read(__import__("json").loads(r.wrapper)).held[0] for r in W.wrappers(df).collect()] == [90]


def expression(*pages):
    whole = None
    for p in pages:
        one = W.with_sums(*W.parsed(p))
        whole = one if whole is None else W.aligned(whole, one, W.summed)
    return whole.shape()


def test_expressions():
    assert expression("<h1>a</h1><p>b<p>c") == "page(h1(#;)p*(#;))"
    assert expression("<h1>a</h1><p>b", "<p>b<hr><ul><li>x</ul>") == "page(h1?(#;)p(#;)ul?(li(#;)))"
    assert expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "page(dl((dt dd)*(dt(#;)dd(#;))))"
    assert expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "page(dl((dt dd)*(dt(#;)dd(#;))))"
    assert expression("<table><tr><td>1<td>2<tr><td>3</table>") == "page(table(tr*(td*(#;))))"
    assert expression("<div class='b2 a'>x</div><div>y</div>") == "page(div.a(#;)div(#;))"
    assert expression("<p>a<nav>b</nav>c") == "page(p(#;)nav!(#;)#;)"


def test_order_of_pages_does_not_matter_for_slots(pages):
    rows, want = pages
    for seed in range(4):
        some = [r for r in rows if r[0] % 3 == 2]
        random.Random(seed).shuffle(some)
        whole = None
        for _, _, page in some:
            one = W.with_sums(*W.parsed(page))
            whole = one if whole is None else W.aligned(whole, one, W.summed)
        told = W.judged(whole)
        for i, _, page in some:
            node, blocks = W.parsed(page)
            sure = W.levels(node, told, len(blocks))
            assert "\n".join(t for (t, _), s in zip(blocks, sure) if s and s == max(sure)) == want[i]
