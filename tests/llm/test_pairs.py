"""Operators on pairs against brute force: shingle join, lattice hashing, components."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from test_rows import LOWER, blank_words
from tidepanel.llm import lattice_dedup, ngram_join
from tidepanel.llm.components import components


def groups_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_join(rows):
    """{id: (n, component, links)} of rows with distinct ids."""
    sets = {}
    for doc, text in rows:
        w = blank_words((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    lists = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            lists[x].append(doc)
    pairs = []
    for doc, s in sets.items():
        for other, k in Counter(o for x in s for o in lists[x] if o > doc).items():
            if 100 * k >= 80 * (len(s) + len(sets[other]) - k):
                pairs.append((doc, other))
    component, links = groups_of(sets, pairs), Counter(d for p in pairs for d in p)
    return {d: (len(s), component[d], links[d]) for d, s in sets.items()}


def joined(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs).collect()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_join_on_documents(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
    assert joined(docs) == brute_join([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_join_of_edited_groups(spark, monkeypatch):
    """Chains of edits, a shared passage, edges of the threshold; chunks of a few documents."""
    monkeypatch.setattr(ngram_join, "CHUNK", 6)
    rng = random.Random(1)
    texts = []
    for g in range(12):
        words = [f"w{rng.randint(0, 10_000)}" for _ in range(rng.choice([5, 6, 9, 24, 60, 120]))]
        for _ in range(rng.randint(1, 25)):
            texts.append(" ".join(words))
            if rng.random() < 0.7:
                at = rng.randrange(len(words))
                words = words[:at] + [f"e{rng.randint(0, 99)}"] + words[at + rng.randint(0, 1):]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"u{i} {passage} v{i} x{i} y{i}" for i in range(40)]
    texts += ["a b c d", "A b  c\td", "a b c", "", "   ", "a b c d e", "a b c d e f"] + [f"Z{'z' * i}" for i in range(3)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_join(rows)
    assert joined(docs.repartition(5)) == want
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == {d for d, (n, c, _) in want.items() if not n or c == d}


def with_common_passages(rng, families):
    """Texts of 200 words of families of two to four near copies; a passage of 36 words stands in many families, three of five in each."""
    passages = [" ".join(f"p{k}x{i}" for i in range(36)) for k in range(5)]
    texts = []
    for f in range(families):
        own = [f"f{f}x{i}" for i in range(rng.randint(80, 100))]
        chosen = rng.sample(passages, 3)
        for c in range(rng.randint(2, 4)):
            words = own[:30] + [f"c{c}x{f}"] + own[31:]
            texts.append(" ".join([*words[:40], chosen[0], *words[40:60], chosen[1], *words[60:], chosen[2]]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rows_sent", [1000, 0])
def test_join_of_families_with_common_passages(spark, monkeypatch, rows_sent):
    """Passages make one candidate group of all; what is sent to all tasks stays within the limit of rows, none of them a list."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows_sent)
    sent, broadcast = [], ngram_join.F.broadcast

    def spy(table):
        lists = [c for c, kind in table.dtypes if kind.startswith("array")]
        sent.append(sum(1 + sum(len(r[c]) for c in lists) for r in table.collect()))
        return broadcast(table)

    monkeypatch.setattr(ngram_join.F, "broadcast", spy)
    rows = with_common_passages(random.Random(3), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs.repartition(5)) == brute_join(rows)
    assert all(n <= rows_sent for n in sent)


def test_wide_group_is_formed_anew(spark, monkeypatch):
    """Sets that only common passages connect are in groups of their own, so few of them are compared."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    stored, durable = [], ngram_join.durable

    def spy(table):
        table = durable(table)
        stored.append(table)
        return table

    monkeypatch.setattr(ngram_join, "durable", spy)
    rows = with_common_passages(random.Random(4), 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs) == brute_join(rows)
    visits = 0
    for table in stored:
        if "visits" in table.columns:
            visits += sum(len(r["visits"]) for r in table.select("visits").collect())
        elif {"left", "right"} <= set(table.columns):
            visits += table.count()
    assert len(rows) <= visits <= 2 * len(rows)


def test_join_odd_rows(odd, none):
    rows = ngram_join.join(odd).collect()
    assert len(rows) == odd.count()
    fox = [r for r in rows if r["component_id"] == 1]
    assert len(fox) == 4 and {r["n_links"] for r in fox} == {3} and {r["n_shingles"] for r in fox} == {11}
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [(by[d]["n_shingles"], by[d]["component_id"], by[d]["n_links"]) for d in (3, 4, 5, 7)] == [
        (0, 3, 0), (0, 4, 0), (0, 5, 0), (1, 7, 0)]
    out = ngram_join.keep_one(odd)
    assert out.columns == odd.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, 9, None, None])
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_search_by_brute_force():
    rng = random.Random(5)
    sets = []
    for _ in range(30):
        base = rng.sample(range(500), rng.randint(1, 40))
        for _ in range(rng.randint(1, 6)):
            sets.append(np.array(sorted(set(base) - set(rng.sample(base, len(base) // 8)) | set(rng.sample(range(500), len(base) // 20)))))
    sets = sorted((s for s in sets if len(s)), key=len)
    weight = np.arange(1, len(sets) + 1)
    for side in (None, np.array([i % 2 for i in range(len(sets))])):
        links, group = ngram_join.search(sets, weight, side)
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j])
                 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        want = Counter()
        for i, j in pairs:
            want[i] += weight[j]
            want[j] += weight[i]
        assert [want[i] for i in range(len(sets))] == list(links)
        assert groups_of(range(len(sets)), pairs) == dict(enumerate(group))


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(180)] + [(5000, 5000)]
    pairs += [(2000, 2000 + i) for i in range(500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs + [(None, 1)], "a long, b long"), "a", "b").collect()}
    want = groups_of({n for p in pairs for n in p}, pairs)
    assert got == {n: c for n, c in want.items() if n != c}


def test_nearest_lattice_points():
    """E8 points around the origin, by listing all with small coordinates."""
    from itertools import product
    whole = [p for p in product((-1, 0, 1, 2), repeat=8) if sum(p) % 2 == 0]
    halves = [tuple(x + 0.5 for x in p) for p in product((-1, 0, 1), repeat=8) if sum(p) % 2 == 0]
    points = np.array(whole + halves, float)
    y = np.random.default_rng(4).uniform(0, 1, (40, 8))
    got, distance = lattice_dedup.nearest(y)
    for i in range(len(y)):
        d = ((points - y[i]) ** 2).sum(axis=1)
        assert np.isclose(distance[i, 0], d.min())
        assert np.allclose(((got[i] / 2 - y[i]) ** 2).sum(axis=1), distance[i])
        assert len({tuple(p) for p in got[i]}) == 4 and (np.diff(distance[i]) >= 0).all()


def embeddings(seed=0, groups=25, dims=64):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.normal(size=dims)
        base /= np.linalg.norm(base)
        for _ in range(rng.integers(1, 30)):
            noise = rng.normal(size=dims)
            noise -= noise @ base * base
            cos = rng.uniform(0.9, 1.0)
            out.append(cos * base + np.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise))
    out += [out[0]] * 5 + [out[3] * 2.0]
    return np.array(out, np.float32)


def test_dedup_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "PART", 7)
    x = embeddings()
    docs = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    d = x.astype(float)
    cos = d @ d.T / np.sqrt((d * d).sum(1))[:, None] / np.sqrt((d * d).sum(1))[None]
    linked = cos >= 0.9
    np.fill_diagonal(linked, False)
    component = groups_of(range(len(x)), list(zip(*np.nonzero(np.triu(linked)))))
    rows = {r["vec_id"]: r for r in lattice_dedup.dedup(docs.repartition(4)).collect()}
    assert sum(r["n_links"] for r in rows.values()) >= 0.97 * linked.sum()
    assert all(r["n_links"] <= linked[i].sum() for i, r in rows.items())
    assert np.mean([rows[i]["component_id"] == component[i] for i in rows]) >= 0.97
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())


@pytest.mark.parametrize("few,part", [(32, 2048), (2, 9)])
def test_dedup_compares_all_that_share_a_cell(spark, monkeypatch, few, part):
    """A cluster at cosine 0.85 whose cells hold planted pairs at 0.93, with vectors between them that are linked with neither."""
    monkeypatch.setattr(lattice_dedup, "FEW", few, raising=False)
    monkeypatch.setattr(lattice_dedup, "PART", part)
    rng = np.random.default_rng(7)

    def tilted(v, cos):
        noise = rng.normal(size=64)
        noise -= noise @ v * v
        return cos * v + np.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise)

    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    near = [tilted(base, np.sqrt(0.85)) for _ in range(200)]
    x = np.array(near + [tilted(v, 0.93) for v in near[:60]])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    keys = [set(k) for k in lattice_dedup.cells(unit).tolist()]
    met = [(i, j) for i, j in zip(*np.nonzero(np.triu(linked))) if keys[i] & keys[j]]
    assert len(met) > 40
    component = groups_of(range(len(x)), met)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = {r["vec_id"]: r for r in lattice_dedup.dedup(docs.repartition(5)).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == component
    assert all(r["n_links"] == sum(linked[i][j] and component[i] == component[j] for j in rows) for i, r in rows.items())


def test_spanning():
    rng = np.random.default_rng(3)
    for density in (0.0, 0.02, 0.1, 1.0):
        linked = rng.uniform(size=(40, 30)) < density
        i, j = lattice_dedup.spanning(linked)
        assert linked[i, j].all() and len(i) < 70
        every = groups_of(range(70), [(a, 40 + b) for a, b in zip(*np.nonzero(linked))])
        assert groups_of(range(70), list(zip(i, 40 + j))) == every


def test_dedup_odd_rows(spark):
    v = [0.1 * i + 0.2 for i in range(8)]
    inf, nan = float("inf"), float("nan")
    rows = [(5, v), (3, v), (4, [2 * t for t in v]), (7, None), (8, []), (9, [0.0] * 8), (10, [nan] + v[1:]), (11, [inf] + v[1:]),
            (12, [None] + v[1:]), (13, v[:7]), (None, v), (None, [-t for t in v]), (5, v), (14, [-0.0] * 8)]
    docs = spark.createDataFrame([(*r, 1, 2, True) for r in rows],
                                 "vec_id long, embedding array<double>, vec long, component long, kept boolean")
    out = [tuple(r) for r in lattice_dedup.dedup(docs).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert Counter(out) == Counter([
        (5, 4, 3, False), (5, 4, 3, False), (3, 4, 3, True), (4, 4, 3, False), (None, 4, 3, False), (None, 0, None, True),
        (13, 0, 13, True), *[(i, 0, i, True) for i in (7, 8, 9, 10, 11, 12, 14)]])
    assert lattice_dedup.dedup(docs.where("1 = 0")).count() == 0
