"""Searches over vectors and words against brute force: hard negatives, exact top-k, spelling variants."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import approximation_file, frequency_trie, hyperplane_tree
from tidepanel.llm.whole_vectors import Best, thawed

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, score double, n long, dims int, tree string, v binary"
MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, *[None] * 6) for i, v, label in rows], SCHEMA)


def some_vectors(n, seed, dims=12):
    """Clusters, one of them a third of all rows; copies; ties; a few far out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 6, n))
    x = centres[of] + 0.2 * rng.normal(size=(n, dims))
    copies = rng.random(n) < 0.1
    x[copies] = x[0]
    x[rng.random(n) < 0.01] *= 40
    label = np.where(rng.random(n) < 0.4, 3, rng.integers(0, 5, n))
    return [(i, [float(y) for y in x[i].astype(np.float32)], int(label[i])) for i in range(n)]


def whole(rows):
    seen = {}
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            seen.setdefault(i, (np.floor(256 * np.array(v, float)), label))
    return seen


def brute_top(rows, k=5):
    seen, out = whole(rows), []
    for q in seen:
        if q % 50 == 0:
            a = seen[q][0]
            scored = sorted((-int(a @ b), i) for i, (b, _) in seen.items() if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def brute_negatives(rows):
    seen = {i: (v, (label + 1) % 10 if i % 7 == 0 else label) for i, (v, label) in whole([r for r in rows if r[2] is not None]).items()}
    out = []
    for q, (a, label) in seen.items():
        if q % 50:
            continue
        scored = sorted((-int(a @ b), i, kind) for i, (b, kind) in seen.items() if i != q and len(b) == len(a))
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(s, i) for s, i, kind in scored if kind != label and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out += [(q, p, r, i, -ps, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def top(df):
    return sorted(tuple(r) for r in approximation_file.top_k(df, F.expr("vec % 50 = 0")).collect())


def negatives(df):
    return sorted(tuple(r) for r in hyperplane_tree.hard_negatives(df, F.expr("vec % 50 = 0"), F.expr(MOVED)).collect())


ODD = [
    (0, [0.5, -0.25, 1.0], 1), (0, [0.5, -0.25, 1.0], 1), (50, [0.5, -0.25, 1.0], 1), (100, [0.0, 0.0, 0.0], 2), (7, [0.4, 0.0, 0.9], 1),
    (8, [0.4, 0.0, 0.9], 1), (9, [0.3, 0.0, 0.6], 4), (10, [0.3, 0.0, 0.6], 4), (11, None, 1), (12, [1.0, None, 2.0], 1),
    (13, [float("nan"), 1.0, 1.0], 1), (14, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (15, [1.0, 2.0], 1), (150, [2.0, 2.0], 3),
    (16, [0.2, 0.1, 0.4], None), (200, [], 1), (17, [], 1), (18, [-3.0, 2.0, -1.0], 5), (250, [-300.0, 200.0, -100.0], 5),
]


@pytest.mark.parametrize("rows", [ODD, [], [(3, [1.0], 2)], [(50, [1.0], 2)]])
def test_searches_on_odd_rows(spark, rows):
    df = frame(spark, rows)
    assert top(df) == brute_top(rows)
    assert negatives(df) == brute_negatives(rows)


def test_searches_on_clusters(spark, monkeypatch):
    """Several pages, groups, trees and blocks."""
    for module, name, value in ((approximation_file, "PAGE", 60), (approximation_file, "PAGES", 3), (approximation_file, "LEAST_SEARCHES", 8),
                                (hyperplane_tree, "TREE", 150), (hyperplane_tree, "TREES", 2), (hyperplane_tree, "LEAST_ANCHORS", 4)):
        monkeypatch.setattr(module, name, value)
    rows = some_vectors(1500, 3)
    df = frame(spark, rows).repartition(5)
    assert top(df) == brute_top(rows)
    assert negatives(df) == brute_negatives(rows)


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_page_bounds(bits):
    """Whatever the cells, a page gives the exact result; finer cells read fewer exact vectors."""
    rng = np.random.default_rng(bits)
    x = np.floor(256 * rng.normal(size=(400, 24)) / 5)
    x[50:90] = x[7]
    ids = np.sort(rng.choice(10_000, 400, replace=False))
    page = thawed(approximation_file.page_of(ids, x, bits))
    asked = np.arange(0, 400, 9)
    best = Best(len(asked), 5)
    read = approximation_file.search_page(page, ids[asked], x[asked], best)
    for n, q in enumerate(asked):
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:5]
        assert best.id[n].tolist() == ids[order].tolist() and best.score[n].tolist() == s[order].tolist()
    if bits >= 6:
        assert read < 0.25 * len(asked) * 400


def test_tree_eliminates_and_is_exact():
    """On clustered vectors most leaves are ruled out; windows and ties are exact."""
    rng = np.random.default_rng(5)
    centres = 300 * rng.normal(size=(40, 16))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + 8 * rng.normal(size=(4000, 16)))
    ids = rng.permutation(4000).astype(np.int64)
    tree = hyperplane_tree.Tree.grown(ids, x)
    again = hyperplane_tree.Tree(**thawed(hyperplane_tree.frozen(**tree.parts)))
    assert sorted(again.ids) == list(range(4000)) and (again.degree > 0).sum() > 5
    own, anchor = ids[:80], x[:80]
    score = anchor @ x.T
    for low, high in ((-np.inf, np.inf), (-1e5, 2e5), (3e5, 3.2e5)):
        best = Best(80, 4)
        seen = again.search(own, anchor, np.full(80, low), np.full(80, high), best)
        for n in range(80):
            fit = np.flatnonzero((score[n] >= low) & (score[n] <= high) & (ids != own[n]))
            fit = fit[np.lexsort((ids[fit], -score[n][fit]))][:4]
            assert best.id[n][:len(fit)].tolist() == ids[fit].tolist() and np.isfinite(best.score[n]).sum() == len(fit)
        assert seen < (0.4 if high == np.inf else 0.9) * score.size


def test_tree_of_copies():
    tree = hyperplane_tree.Tree.grown(np.arange(500), np.ones((500, 3)))
    assert tree.degree.tolist() == [0]
    best = Best(1, 3)
    tree.search(np.array([1]), np.ones((1, 3)), np.array([-np.inf]), np.array([np.inf]), best)
    assert best.id.tolist() == [[0, 2, 3]]


# spelling variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word):
    """The word without each of its code points in turn, with the place."""
    return {(i, word[:i] + word[i + 1:]) for i in range(len(word))}


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run.translate(LOWER)}".encode())
            word = run.translate(LOWER)
            counts[word if h % 199 else word[:h % len(word)] + word[h % len(word) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    cut = {w: edits(w) for w in n}
    pieces = {w: {p for _, p in c} for w, c in cut.items()}
    near = {a: {b for b in n if b != a and abs(len(a) - len(b)) <= 1 and (
        (len(a) == len(b) and cut[a] & cut[b]) or a in pieces[b] or b in pieces[a])} for a in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def variants(docs):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frequency_trie.variants(docs).collect()}


def test_variants_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = variants(docs)
    assert got == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()]) and len(got) > 100


def spelt(seed):
    """Words with all kinds of edits, chains of forms, ties, one class of equal counts, accents, long words."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeéintÿ×") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["q" * 70, "stationary" * 8, "abcdefgh"]
    words = []
    for w in base:
        words += [w] * rng.choice((5, 30, 200))
        for _ in range(6):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            words += [w[:i] + ("" if kind == 0 else rng.choice("abeé")) + w[i + (kind < 2):]] * rng.choice((4, 5, 6, 26))
    words += ["Abcdefgi", "abcdefgj", "abcdefg"] * 6 + ["abcdefgk"] * 36 + ["ABCDEFGK"] * 150
    words += ["marble"] * 6 + ["marbles"] * 50 + ["marblesx"] * 400
    words += ["".join(p) for p in ("listen", "silent", "enlist", "tinsel", "inlets") for _ in range(9)]
    rng.shuffle(words)
    cuts = sorted(rng.sample(range(len(words)), 40))
    return [(i % 31 if i % 9 else None, rng.choice((" ", "-", "1", "\n")).join(words[a:b])) for i, (a, b) in enumerate(zip([0] + cuts, cuts + [len(words)]))]


@pytest.mark.parametrize("piece", [4096, 12, 3])
def test_variants_of_edited_words(spark, monkeypatch, piece):
    """Small pieces deal the trie's upper levels out, and split branches."""
    monkeypatch.setattr(frequency_trie, "PIECE", piece)
    monkeypatch.setattr(frequency_trie, "PAIRS", 50)
    rows = spelt(piece)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got, want = variants(docs), brute_variants(rows)
    assert got == want
    assert any(f is not None and r != f for f, r, *_ in want.values())


def test_variants_on_odd_rows(spark, odd, none):
    assert variants(odd) == brute_variants([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert frequency_trie.variants(none).count() == 0
    long = "x" * 1_000_000
    rows = [(i, long) for i in range(5)] + [(9, long + "y")] * 5 + [(10, "variant " * 200_000)]
    got = variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_variants_of_long(rows)


def brute_variants_of_long(rows):
    counts = Counter()
    for doc, text in rows:
        for run, n in Counter(text.split()).items():
            h = zlib.crc32(f"{doc}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += n
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {a: [b for b in n if b != a and b[:1] == a[:1] and abs(len(a) - len(b)) <= 1] for a in n}  # these differ by one letter
    return {w: (None, w, n[w], len(near[w]), None) for w in n}


@pytest.mark.parametrize("a, b, want", [
    ("letter", "letter", False), ("letter", "lettre", False), ("letter", "letters", True), ("letter", "etter", True), ("letter", "leter", True),
    ("letter", "lettar", True), ("letter", "lette", True), ("letter", "lettersx", False), ("abab", "baba", False), ("aaaa", "aaa", True)])
def test_one_edit(a, b, want):
    assert frequency_trie.one_edit(a, b) is want and frequency_trie.one_edit(b, a) is want
    (one, size), (other, other_size) = frequency_trie.coded([a]), frequency_trie.coded([b])
    assert bool(frequency_trie.near(one, size, other, other_size)[0]) is want
    assert bool(frequency_trie.near(other, other_size, one, size)[0]) is want
