"""Operators on pages: archives and main text."""

import gzip
import html
import io
import re
import time

import numpy as np
import pytest

from tollgate.llm import html_crf, store, warc

SCHEMA = "page_id long, url string, html string, target string, kind int"


@pytest.fixture(scope="module")
def pages(spark):
    long, longer = "é" * 600, "<p>" + "x" * 3000
    rows = [
        (1, "http://a/1", long),
        (2, None, long),
        (9, "http://a/9\r\nX: y", long),
        (4, "u", "short"),
        (5, "u", "short"),
        (6, "u", None),
        (7, "u", ""),
        (None, "u", longer),
        (8, "u", longer),
        (3, "u", "y" * 200_000),
        (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 100),
        (12, "u", long + "!"),
        (12, "u", long + "!"),
    ]
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)


def test_archive_round_trip(spark, pages, tmp_path):
    roots = [store.work_folder(spark, "test-warc") for _ in range(2)]
    manifests = [warc.write(pages, root, roll_bytes=400) for root in roots]
    got = sorted(map(str, map(tuple, warc.read(spark, roots[0], manifests[0]).collect())))
    pages.select("page_id", "html").toPandas().to_parquet(tmp_path / "pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, html FROM read_parquet('{tmp_path}/pages.parquet')")
    want = sorted(str(tuple(r)) for r in con.execute(warc.SQL).fetchall())
    assert got == want
    names = [r["name"] for r in manifests[0].orderBy("name").collect()]
    assert len(names) > 3 and names == [r["name"] for r in manifests[1].orderBy("name").collect()]
    for name in names:
        raw = [store.reopen(f"{root}/{name}").read() for root in roots]
        assert raw[0] == raw[1], "the same pages give the same archives"
        text = gzip.GzipFile(fileobj=io.BytesIO(raw[0])).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: re")
    # a rename that is done twice changes nothing
    row = manifests[0].first()
    store.move(row["temporary"], f"{roots[0]}/{row['name']}")


def test_no_pages(spark):
    root = store.work_folder(spark, "test-no-warc")
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read(spark, root, warc.write(empty, root)).count() == 0
    assert html_crf.main_text(empty).count() == 0


def test_damage_is_found():
    data = warc.record(1, "u", b"payload", "0" * 40, None, 0)
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload", b"payl0ad"))


def test_leaves():
    page = "x<nav><a href='a>b'>menu</a></nav><article><p>One <b>tw</b>o &amp; three<br>four<p>five<ul><li>a<li>b</ul><!-- c --><script>var t='</p>'</script></article><style>p{"
    found = html_crf.leaves(page)
    assert [b.text for b in found] == ["x", "menu", "One two & three four", "five", "a", "b"]
    assert found[1].linked == 4 and [t for t, _ in found[4].chain] == ["article", "ul", "li"]
    assert html_crf.leaves(None) == [] and html_crf.leaves("<p><p>") == []
    assert [b.text for b in html_crf.leaves("a < b <c")] == ["a < b"]
    assert len(html_crf.leaves("<p>" * 3000 + "deep")) == 1
    assert html_crf.leaves('<p class="x' * 500 + ">end") is not None


def test_leaves_keep_text_around_embedded_elements(spark):
    def texts(page):
        return [b.text for b in html_crf.leaves(page)]

    assert texts("<p>so <math display='block'><mi>a</mi><mo>=</mo><mspace/><semantics><mn>2</mn><annotation encoding='tex'>x</annotation></semantics></math> holds</p><p>b") == ["so a=2 holds", "b"]
    assert texts("<p>a<math/> b</p>") == ["a b"] and html_crf.leaves("<p>a<math/> b</p><i>c")[1].chain == ()
    assert texts('<p>one <object data="f>g"><p>instead</p></object></p><noscript><p>plain &amp; text</p></noscript><p>two') == ["one", "instead", "plain & text", "two"]
    assert texts('<p>one <svg viewBox="0 0 > 1" /> two</p><svg><text>no</text></svg ><p>three</p><svg width=1><path/>') == ["one two", "three"]
    for tag in ("svg-icon", "object-viewer", "template-x", "script-note", "style-guide", "iframe-box", "math-field", "noscript-x"):
        assert texts(f"<p>one <{tag} name='a'></{tag}> two</p><{tag}>three</{tag}><p>four</p>") == ["one", "two", "three", "four"], tag
    assert texts("<p>a</p><script src='x>y'>b</script ><style>c</style><template><p>d</p></template><iframe>e</iframe><p>f</p><script>g") == ["a", "f"]
    page = "<nav><a href='/'>menu</a></nav><article><h1>Report</h1>{}</article><footer>&copy; site</footer>"
    body = f"<p>{html_crf.SENTENCE}</p>"
    odd = body + '<svg-icon name="a"></svg-icon><svg width="1"/>' + body + "<noscript>" + body + "</noscript><p>In all, it is <math><mi>x</mi></math>, as they said, and no more than that.</p>"
    rows = [(1, "u", page.format(body + body)), (2, "u", page.format(odd))]
    found = {r["page_id"]: r["text"] for r in html_crf.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == " ".join(["Report"] + [html_crf.SENTENCE] * 2)
    assert found[2] == " ".join(["Report"] + [html_crf.SENTENCE] * 3 + ["In all, it is x, as they said, and no more than that."])


def test_main_text_on_held_out_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    field = html_crf.train(pages.where("page_id % 2 = 0"))
    for row in html_crf.main_text(pages.where("page_id % 2 = 1"), field).collect():
        page = pages.where(f"page_id = {row['page_id']}").first()["html"]
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert row["text"] == want and row["n_chars"] == len(want)
    rng, wrong, total = np.random.default_rng(42), 0, 0
    for row in pages.where("page_id % 2 = 1").collect():
        blocks = html_crf.leaves(row["html"])
        truth = html_crf.natural_labels(blocks)
        main, other = ([b.text for b, y in zip(blocks, truth) if y == k] for k in (1, 0))
        for _ in range(4):
            made = html_crf.leaves(html_crf.rearranged(main, other, rng))
            found = field.decode(html_crf.features(made))
            wrong += sum(int(b.marked) != y for b, y in zip(made, found))
            total += len(made)
    assert wrong <= 0.02 * total


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    field = html_crf.Field()
    field.index = {str(i): i for i in range(6)}
    field.weights, field.transitions, field.first = rng.normal(0, 2, 6), rng.normal(0, 2, (2, 2)), 0.7
    for _ in range(40):
        rows = [[str(i) for i in rng.choice(6, 2)] for _ in range(int(rng.integers(1, 9)))]

        def value(labels):
            score = field.first * labels[0]
            score += sum(field.weights[[int(x) for x in r]].sum() * y for r, y in zip(rows, labels))
            return score + sum(field.transitions[a, b] for a, b in zip(labels, labels[1:]))

        every = [[n >> i & 1 for i in range(len(rows))] for n in range(1 << len(rows))]
        assert value(field.decode(rows)) == pytest.approx(max(map(value, every)))


A = "The committee met on Tuesday to discuss the new plan, which had been delayed twice."
B = "After two hours of debate, members agreed that the budget would be revised by spring."
LAYOUTS = {
    "names inside attributes": (f"<article><h1>Plan delayed</h1><p data-id='comment-share-ad'>{A}</p><p data-class=nav aria-role=menu>{B}</p></article>", ""),
    "bare containers": (f"<div>Plan delayed</div><div>{A}</div><div>{B}</div>", ""),
    "nested containers": (f"<div><h1>Plan delayed</h1><div>{A}</div><div>{B}</div></div>", ""),
    "menu and footer": (f"<div id=nav><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Plan delayed</h1><p>{A}</p><p>{B}</p></div><div class=footer>&copy; 2020 Site</div>", ""),
    "table": (f"<main><h1>Plan delayed</h1><p>{A}</p><table><tr><td>Year</td><td>Cost</td></tr></table><p>{B}</p></main><aside><p>{A}</p></aside>", "Year Cost"),
    "list and comments": (f"<nav><ul><li><a href=/>Home</a></ul></nav><div class=post><h1>Plan delayed</h1><p>{A}</p><ul><li>First item of the list</ul><p>{B}</p></div><div class=comments><div class=comment><p>{A}</p></div></div>", "First item of the list"),
    "code": (f"<article><h1>Plan delayed</h1><p>{A}</p><pre>x = 1\ny = 2</pre><p>{B}</p></article><footer><p>{A}</p></footer>", "x = 1 y = 2"),
    "unclosed": (f"<header><p>Site name</header><article><h1>Plan delayed</h1><p>{A}<p>{B}</article><form><p>{A}</form>", ""),
    "newsletter": (f"<div class='menu'><ul><li><a>a</a></li></ul></div><section class='entry-content'><h2>Plan delayed</h2><p>{A}</p><blockquote>{B}</blockquote></section><div class='newsletter'><p>{A}</p></div>", ""),
    "cookies and adverts": (f"<div id=cookie-banner><p>{A}</p></div><div id=main-content><h1>Plan delayed</h1><p>{A}</p><div class=ad>Buy now</div><p>{B}</p></div>", ""),
}


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return html_crf.train(spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet"))


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_layouts_made_by_hand(trained, layout):
    page, between = LAYOUTS[layout]
    want = " ".join(x for x in ("Plan delayed", A, between, B) if x)
    assert html_crf.extract(f"<html><body>{page}</body></html>", trained) == want


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<div><b>x", "<div>x</span>", "<ul><li><div>x", "<li><b>x</li><p>"])
def test_depth_takes_linear_time(trained, piece):
    began = time.process_time()
    html_crf.extract(piece * 100_000, trained)
    assert time.process_time() - began < 40
    assert html_crf.leaves("".join(f"<div class='c{i}'>x" for i in range(2_000)))[-1].chain[-1] == ("div", ("c",))
