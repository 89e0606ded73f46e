"""Native operators: license scans, quality cascade, mixing, packing."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidepanel.llm import license_scan, mixing, packing, quality_cascade

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def license_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_licenses(text, rules):
    """All matches of all rules on joined words, then suppression by comparing every pair of hits."""
    words = license_words(text)
    joined = "".join(f" {w} " for w in words)
    starts, at = {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 2
    hits = []
    for n, r in enumerate(rules):
        if r.keyword in words:
            for m in re.finditer(license_scan._spaced(r.pattern), joined):
                first = starts[m.start()]
                hits.append((first, first + len(m[0].split()) - 1, r.priority, n, r.label, r.base, r.weight))
    def gone(h):
        return any(o is not h and o[0] <= h[0] and o[1] >= h[1] and o[2] >= h[2]
                   and (o[:3] != h[:3] or o[3] < h[3]) for o in hits)
    return words, [h for h in hits if h[5]], [h for h in hits if not gone(h)]


def compare_licenses(docs):
    rules = license_scan.rules()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], tuple((h["first"], h["last"], h["rule"]) for h in r["base_hits"]),
                  tuple(sorted((h["first"], h["last"], h["rule"]) for h in r["hits"]))) for r in license_scan.scan(docs).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        words, base, kept = brute_licenses(r["text"], rules)
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(words), tuple((h[0], h[1], h[3]) for h in sorted(base)),
                     tuple(sorted((h[0], h[1], h[3]) for h in kept))))
    assert got == sorted(want)


def test_licenses_on_documents(spark):
    compare_licenses(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_licenses_overlapping(spark, odd, none):
    texts = ["Licensed under CC BY-NC-SA 4.0 and CC-BY 4.0, cc by.", "GNU Lesser General Public License, version 2.1 or later",
             "(c) All rights reserved. ALL RIGHTS RESERVED! all  rights\nreserved", "MIT License; the MIT license; Apache License, Version 2.0",
             "SPDX-License-Identifier: GPL-2.0-only", "all rights reserved " * 700, "ccby ccé by cc byé", "KK cc by"]
    compare_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    compare_licenses(odd)
    assert license_scan.digest(license_scan.scan(none)).count() == 0
    row = license_scan.digest(license_scan.scan(odd.where("doc_id = 4"))).first()
    assert (row.n_words, row.n_base, row.first_word, row.base_labels, row.score) == (0, 0, None, "", 0.0)


def test_rule_table():
    rules = license_scan.rules()
    assert len(rules) > 200 and all(r.priority in (1, 2, 3) and 0 < r.weight <= 1 for r in rules)
    for r in rules:
        re.compile(license_scan._spaced(r.pattern))
        assert " " not in r.keyword


def word_forms(parsed):
    """Texts a parsed pattern matches: all branches and letters, optional parts with and without, one digit or word for a range."""
    forms = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = ["7" if str(o) == "CATEGORY" else chr(a[0] if str(o) == "RANGE" else a) for o, a in arg]
        elif name == "MAX_REPEAT":
            inner = word_forms(arg[2])
            more = inner + ([""] if arg[0] == 0 else [])
        elif name == "BRANCH":
            more = [f for branch in arg[1] for f in word_forms(branch)]
        else:
            assert name == "SUBPATTERN"
            more = word_forms(arg[3])
        forms = [a + b for a in forms for b in dict.fromkeys(more)]
    return forms


def test_license_gates():
    """Every word form that a pattern allows passes its gate."""
    narrow = [(r.keyword, f) for r in license_scan.rules() for f in word_forms(re._parser.parse(r.pattern)) if r.keyword not in f.split()]
    assert {k for k, _ in narrow} == {"etalab"} and all(f.startswith("open licen") for _, f in narrow)


def test_licenses_behind_gates(spark):
    texts = {"Published under the Licence Ouverte.": "etalab", "trade secrets of Acme": "proprietary", "trade secret and more": "proprietary",
             "See the licence file for more details": "license-hint", "see licence for details": "license-hint",
             "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc", "An open licence": "",
             "Etalab publishes it under its open licence": "etalab"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.digest(license_scan.scan(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    compare_licenses(docs)


def brute_quality(text):
    text = text or ""
    w = blank_words(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines, repeated = set(), 0
    for line in text.split("\n"):
        if blank_words(line):
            repeated += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def test_quality_counts(spark, odd, none):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate([
        "a b c d e a b c d e", "a b c d e f a b c d e f a", "x\nx\n\nx\ny y y y y y y y y", "# $ % | < > & * a b c d", "q" * 5000,
        "same line here now\nsame line here now\nsame line here now"])], "doc_id long, text string")
    for docs in (spark.read.parquet(f"{FOLDER}/documents.parquet"), odd, extra):
        out = quality_cascade.verdicts(docs)
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                      for r in out.collect())
        assert got == Counter((r["doc_id"], *brute_quality(r["text"])) for r in docs.select("doc_id", "text").collect())
        assert out.where("kept and base_failed").count() == 0
    assert quality_cascade.verdicts(none).count() == 0 and quality_cascade.keep_good(none).count() == 0


def test_cascade_order_changes_nothing(spark, odd):
    from pyspark.sql import functions as F
    from tidepanel.llm.text import let, whole, words
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = quality_cascade.BASE_RULES + quality_cascade.RULES
    kept = {r["doc_id"] for r in quality_cascade.keep_good(docs).collect()}
    for seed in range(2):
        mixed = random.Random(seed).sample(rules, len(rules))
        ok = let(words(whole("text")), lambda w: quality_cascade.passes(whole("text"), w, mixed))
        assert {r["doc_id"] for r in docs.where(ok).collect()} == kept
    found = quality_cascade.estimate(docs, rules)
    assert {e.rule for e in found} == set(rules) and [e.worth for e in found] == sorted((e.worth for e in found), reverse=True)
    assert quality_cascade.keep_good(odd).columns == odd.columns
    good = docs.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("quality = 1")
    judged = quality_cascade.verdicts(good)
    assert judged.where("not kept and not base_failed").count() == 0  # what is labelled good falls by base rules only
    assert docs.where(F.col("doc_id").isin(list(kept))).count() == len(kept)


def brute_targets(sizes):
    sources = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, free, target = 1.5 * sum(sizes.values()), set(sources), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def mixed_rows(docs, **more):
    sizes = mixing.sized(docs)
    return mixing.taken(sizes, mixing.draw(sizes, mixing.targets(sizes), **more)).collect()


def test_mixing(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = mixed_rows(docs)
    assert {r["doc"]: r["size"] for r in rows} == {r["doc_id"]: len(blank_words(r["text"])) for r in docs.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r["doc"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[source[r["doc"]]] and math.isclose(r["target"], want[source[r["doc"]]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixed_rows(docs.orderBy("n_chars").repartition(7))
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("bucket_rows", [2, 16, 4096])
def test_mixing_draw_by_brute_force(spark, bucket_rows):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.randint(0, 40), rng.choice("aaaaab") if i % 9 else None) for i in range(900)],
                                 "doc_id long, text string, source string")
    rows = mixed_rows(docs, bucket_rows=bucket_rows)
    by = defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        by[source[r["doc"]]].append(r)
    for s, part in by.items():
        target, size = part[0]["target"], part[0]["source_size"]
        got = sum(r["taken"] for r in part)
        assert abs(got - target) <= 20 or got == 2 * size
        extra = [r["taken"] - (int(target / size) * r["size"]) for r in part if r["size"]]
        assert set(e > 0 for e in extra) <= {True, False} and min(extra) >= 0


def test_mixing_odd_rows(odd, none):
    rows = mixed_rows(odd)
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if not r["size"])
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert sum(len(blank_words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixed_rows(none) == []


def brute_pack(rows, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    rest = []
    for doc, source, cluster, size in rows:
        for piece in range(size // capacity):
            out.append((doc, piece, capacity, len(bins)))
            bins.append([0, set(), set()])
        if size % capacity:
            rest.append((size % capacity, doc, size // capacity, source, cluster))
    rest.sort(key=lambda r: (-r[0], r[1] is None, r[1] or "", r[3] or "", r[4] or ""))
    for size, doc, piece, source, cluster in rest:
        fits = [(b[0], n) for n, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append([capacity, set(), set()])
        bins[n][0] -= size
        bins[n][1] |= {source} - {None}
        bins[n][2] |= {cluster} - {None}
        out.append((doc, piece, size, n))
    return out


def test_packing_against_every_bin():
    for seed in range(6):
        rng = random.Random(seed)
        rows = [(str(i), rng.choice(["a", "a", "b", "c", None]), rng.choice([None, "x", "y", f"k{i}"]), rng.randint(0, 130)) for i in range(400)]
        got = packing.pack_turn(rows, 50)
        assert sorted((r[0], r[1], r[3], r[4]) for r in got if r[4] is not None) == sorted(brute_pack(rows, 50))
        assert Counter(r[0] for r in got if r[4] is None) == Counter(r[0] for r in rows if r[3] == 0)


def test_packing_query(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for table, shard in ((docs, 8192), (docs, 20), (odd, 2)):
        out = packing.pack(table, capacity=300, shard_rows=shard).collect()
        total = sum(len(blank_words(r["text"])) for r in table.collect())
        assert sum(r["n_words"] for r in out) == total
        fill = defaultdict(int)
        for r in out:
            if r["bin_id"] is not None:
                fill[r["bin_id"]] += r["n_words"]
                assert r["n_words"] > 0
            else:
                assert r["n_words"] == 0
        assert all(r["bin_words"] == fill[r["bin_id"]] <= 300 for r in out if r["bin_id"] is not None)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    met = Counter((r["bin_id"], source[r["doc"]]) for r in packing.pack(docs, capacity=300).collect())
    assert max(met.values()) == 1  # no source twice in a sequence
    assert packing.pack(none).count() == 0
