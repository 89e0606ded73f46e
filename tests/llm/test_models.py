"""Classifiers on held-out rows, token counts against a segmentation without a trie, pages, and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_rows import blank_words
from tidepanel.llm import html_layout, labelled, pairwise_quality, token_counts, toxicity

FOLDER = "/root/testdata/sf0.01"


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(i, folds, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == rest


def test_toxicity_held_out(spark, odd, none):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "labels", "/root/testdata/sf0.1").collect()}
    rows = toxicity.predict(table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"], 5, 0) for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == t for p, t in tested]) > 0.97
    assert np.mean([p for p, t in tested if t]) > 0.8 and np.mean([p for p, t in tested if not t]) < 0.01


def test_models_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (6, 0, None), (None, 0, 1), (7, 0, 1), (7, 1, 0), (9, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for module, folds, rest in ((toxicity, 5, 0), (pairwise_quality, 3, 1)):
        for some in (labels, labels.where("1 = 0"), labels.where("doc_id = 1")):
            rows = module.predict(odd, some).collect()
            assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
            assert all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"], folds, rest) for r in rows)
            empty = {r["score"] for r in rows if r["doc_id"] in (3, 4)}
            assert len(empty) == 1  # a null text is an empty one
        assert module.predict(none, labels).count() == 0
    assert toxicity.keep_clean(odd, labels.where("1 = 0")).count() == odd.count()
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_ngrams_by_brute_force():
    texts = ["Abc dé fghi jklm", "", None, "x", "ABC DÉ fghi jklm " * 3, "ab" * 50]
    whole = {(i + first, b) for first, _, t, bs in toxicity.present(texts) for i, b in zip(t, bs)}
    alone = {(i, b) for i, text in enumerate(texts) for _, _, t, bs in toxicity.present([text]) for b in bs}
    assert whole == alone
    raw = " abc dé fghi jklm "
    assert sum(1 for i, _ in whole if i == 0) == sum(len({raw[j:j + n] for j in range(len(raw) - n + 1)}) for n in toxicity.ORDERS)
    assert {b for i, b in whole if i == 0} <= {b for i, b in whole if i == 4}


def test_training_rows_are_bounded(spark):
    """One labelled id repeated many times is one row, the same one on every run."""
    docs = spark.range(5000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).unionByName(
        spark.createDataFrame([(2, "a"), (2, None), (6, None)], "doc_id int, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 1)], "doc_id int, toxic int")
    runs = [sorted((r["doc"], r["text"] or "", r["label"]) for r in labelled.training_rows(d, labels, "toxic", 5, 9, 10).collect())
            for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [1, 2, 6] and runs[0][0][2] == 1
    assert labelled.training_rows(docs, labels, "toxic", 5, 9, 2).count() <= 2


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()}
    rows = pairwise_quality.predict(table(spark, "documents"), table(spark, "labels")).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows)
    tested = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == t for p, t in tested]) > 0.95


def test_bradley_terry_prefers_the_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=400) > 0.8).astype(int)
    w = pairwise_quality.bradley_terry(x, y)
    s = x @ w
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.98 and abs(w[2]) < abs(w[1]) < abs(w[0])


def plain_count(token, pieces, unknown):
    """Best sum of scores over all segmentations, without sharing."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        ways = [(best[end - 1][0] + unknown, -(-best[end - 1][1] + 1))]
        for start in range(end):
            if token[start:end] in pieces:
                ways.append((best[start][0] + pieces[token[start:end]], best[start][1] - 1))
        best.append(max((total, n) for total, n in ways))
    return -best[-1][1]


def test_token_counts(spark, odd, none, monkeypatch):
    import regex

    pieces = token_counts.scores()
    trie = token_counts.PrefixTrie(pieces)
    docs = table(spark, "documents", "/root/testdata/sf0.001")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    find = regex.compile(token_counts.PRE_TOKENS).findall
    known = {}
    for r in token_counts.token_counts(docs.where("n_chars < 1500")).collect():
        pre = find(texts[r["doc_id"]])
        for p in set(pre) - set(known):
            known[p] = plain_count(p.encode(), pieces, trie.unknown)
        assert (r["n_pretokens"], r["n_tokens"], r["n_bytes"]) == (
            len(pre), sum(known[p] for p in pre), len(texts[r["doc_id"]].encode()))
        assert "".join(pre) == texts[r["doc_id"]]
    small = {b"a": -1.0, b"ab": -1.5, b"b": -1.0, b"abc": -9.0}
    trie = token_counts.PrefixTrie(small)
    assert [trie.insert(t) for t in (b"ab", b"abab", b"abz", b"", b"aab", b"ab")] == [1, 2, 2, 0, 2, 1]
    assert len(trie.best) == 1 + len({t[:i] for t in (b"abab", b"abz", b"aab") for i in range(1, 5) if t[:i]})
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert token_counts.token_counts(none).count() == 0


CASES = [
    ("<p>One <b>two</b>  three<p>Four<br>five", "One two three\n\nFour\nfive"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>fig<td>12 <i>x</i></table>after",
     "Name       Qty\napple pie  3\nfig        12 x\n\nafter"),
    ("<table><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide     z\na     b  c"),
    ("<table><tr><td>a<br>bb<td>c</table>", "a   c\nbb"),
    ("a<script>var x='</p>';</script>b<style>p{}</style><!-- c -->d", "abd"),
    ("<style>.no,#n{display:none}</style><div class='a no'>x</div><i id=n>y</i><b style='visibility: hidden'>z</b><b hidden>q</b>w", "w"),
    ("<details><summary>S</summary>hid<p>den</details><details open><summary>T</summary>seen</details>", "S\nT\nseen"),
    ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
    ("a &amp; &lt;b&gt; &eacute;", "a & <b> é"), ("", ""), (None, ""), ("<", "<"), ("a < b > c", "a < b > c"),
    ("</p></div>x</table>", "x"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("<p title='a>b'>x", "x"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_page_layout(html, text):
    assert html_layout.render(html)[1] == text


def test_backface_visibility_hides_nothing():
    html = """<style>.card{-webkit-backface-visibility:hidden;backface-visibility: hidden}.gone{color:red;visibility:hidden}</style>
    <p class=card>front<p style="backface-visibility: hidden">back<p style="color:red; visibility: hidden">x<p class=gone>y"""
    assert html_layout.render(html)[1] == "front\n\nback"


SHEETS = [  # style sheet, body, visible text
    ("@media print{.c{display:none}}", "<p class=c>a", "a"), ("@media (max-width:600px){.c{display:none}} .d{display:none}", "<p class=c>a<p class=d>b", "a"),
    ("@media screen and (min-width:600px){.c{display:none}}", "<p class=c>a</p>b", "b"), ("@media print, screen{.c{display:none}}", "<p class=c>a</p>b", "b"),
    (".c{display:none}.c{display:block}", "<p class=c>a", "a"), (".c{display:none}", "<p class=c style='display:block'>a", "a"),
    (".c{display:none!important}.c{display:block}", "<p class=c style='display:block'>a</p>b", "b"),
    (".c{display:block}p{display:none}", "<p class=c>a<p>b", "a"), ("#n{display:none}.c{display:block}", "<p class=c id=n>a</p>b", "b"),
    (".c{display:none}@media (min-width:900px){.c{display:block}}", "<p class=c>a", "a"), (".c{display:block}", "<p class=c hidden>a<p hidden>b", "a"),
    ("ul{visibility:hidden}.s{visibility:visible}", "<ul><li>a<li class=s>b</ul>c", "- b\n\nc"),
    ("@supports (display:grid){@media screen{.c{display:none}}}", "<p class=c>a</p>b", "b"), ("@supports not (display:grid){.c{display:none}}", "<p class=c>a", "a"),
    (".x{color:red;@media print{display:none}}.y{.z{display:none}}.q{display:none", "<p class=x>x<p class=z>z<p class=q>q", "x\n\nz"),
    ("a::after{content:'}'}/* .b{display:none} */.c{display:none}", "<p class=b>a<p class=c>b", "a"),
]


@pytest.mark.parametrize("sheet,body,text", SHEETS)
def test_style_sheets(sheet, body, text):
    assert html_layout.render(f"<style>{sheet}</style><body>{body}")[1] == text


def test_sheets_that_do_not_count():
    html = "<style media=print>.c{display:none}</style><noscript><style>.c{display:none}</style></noscript><!-- <style>.c{display:none}</style> --><p class=c>a"
    assert html_layout.render(html)[1] == "a"


SHOWN = [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"), ("<math><semantics><mi>x</mi><annotation>TeX</annotation></semantics></math>", "x"),
    ("<svg><title>t</title><defs><text>no</text></defs><g>no<text>Label <tspan>one</tspan></text><text>two</text></g></svg>after", "Label one\ntwo\nafter"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"), ("a<svg viewBox='0 0' />b<math/>c<p>d", "abc\n\nd"), ("a<svg><path d=z/><rect/></svg>b", "ab"),
    ("<svg><title/><style/><script/><text>x</text></svg>y", "x\ny"), ("<svg><path><p>out</p>", "out"), ("<svg a=b/>x</svg>y", "y"), ("<div/>a", "a"),
    ("<textarea>\n one &amp; <b>\n  two</textarea>", " one & <b>\n  two"), ("<xmp>\n<i>&amp;</i>\n x</xmp>y", "<i>&amp;</i>\n x\n\ny"),
    ("a <select><option>b<option selected>c<option>d</select>e", "a c e"), ("<select><optgroup label=g><option disabled>b<option>c</select>", "c"),
    ("<select multiple><optgroup label=g><option>b<option label=l>c</select>d", "g\nb\nl\nd"), ("<select hidden><option>b</select>c", "c"),
    ("<select><option>a<input>b", "a b"), ("<textarea hidden>a</textarea><select></select>b", "b"), ("<svg style='display:none'><text>a</text></svg>b", "b"),
]


@pytest.mark.parametrize("html,text", SHOWN)
def test_elements_a_browser_shows(html, text):
    assert html_layout.render(html)[1] == text


def test_pages_by_brute_force(spark):
    """All visible words of a page, in order, against a plain removal of markup."""
    import re
    from html import unescape

    pages = table(spark, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_layout.extract(pages).collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|head)\b.*?</\1>", " ", html[r["page_id"]])
        want = unescape(re.sub(r"</?(?:b|i|a|em|span|strong)\b[^>]*>", "", re.sub(r"<(?!/?(?:b|i|a|em|span|strong)\b)[^>]*>", " ", body))).split()
        got = r["text"].split()
        assert [w for w in got if w != "-"] == [w for w in want if w != "-"]


def test_pages_odd_rows(spark):
    deep = "<div>" * 30_000 + "x" + "<table><tr><td>" * 200 + "y" + "<ul><li>" * 300 + "z"
    rows = [(1, "<p>a"), (1, "<p>a"), (None, None), (2, ""), (3, deep), (4, "<p>a" * 20_000)]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, html string, text string, n_lines long")
    out = {r["page_id"]: r for r in html_layout.extract(pages).collect()}
    assert out[1]["text"] == "a" and out[2]["text"] == out[None]["text"] == "" and out[2]["n_lines"] == 0
    assert out[3]["text"].split() == ["x", "y", "-", "z"] and out[4]["n_lines"] == 39_999
    assert html_layout.extract(pages.where("1 = 0")).count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, "documents", folder)
    labels = {r["doc_id"]: r for r in table(spark, "labels", folder).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_join", "mixing", "packing"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], folder)
        path = corpus_pipeline.durable(out)
        frames.append(path)
    ids = [Counter(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:])) and all(f.columns == docs.columns for f in frames[:-1])
    clean = {i for i, r in labels.items() if not r["toxic"]}
    assert len(clean - set(ids[1])) <= 0.01 * len(clean)
    good = {i for i, r in labels.items() if r["quality"] and i in ids[1]}
    short = {r["doc_id"] for r in frames[1].collect() if len(blank_words(r["text"])) < 10}
    assert len(good - short - set(ids[2])) <= 0.02 * len(good)
    from test_pairs import brute_join
    want = brute_join([(r["doc_id"], r["text"]) for r in frames[2].collect()])
    assert set(ids[3]) == {d for d, (n, c, _) in want.items() if not n or c == d} and set(ids[3].values()) == {1}
    assert max(ids[4].values()) <= 2
    words = defaultdict(int)
    for r in frames[5].collect():
        words[r["doc_id"]] += r["n_words"]
    text = {r["doc_id"]: len(blank_words(r["text"])) for r in docs.collect()}
    assert {d: n * text[d] for d, n in ids[4].items()} == dict(words)
    shares = Counter()
    for r in frames[4].collect():
        shares[r["source"]] += len(blank_words(r["text"]))
    total = sum(len(blank_words(r["text"])) for r in frames[3].collect())
    assert abs(sum(shares.values()) - 1.5 * total) < 0.02 * total
