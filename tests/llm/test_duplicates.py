"""Suffix-array dedup and n-gram Jaccard join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from vulnsift.llm import graph, ngram_join, suffix_dedup
from vulnsift.llm.graph import components


def brute_repeats(rows, length=50):
    """doc_id -> n_bytes, n_removed, n_spans, digest; rows by ascending id, null last."""
    first, out = {}, []
    key = lambda i: (i is None, i or 0)
    for doc, text in sorted(rows, key=lambda r: key(r[0])):
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k:k + length], key(doc))
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k:k + length]] < key(doc):
                gone[k:k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def found_repeats(df):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)


def test_repeats_small_tables(spark, documents):
    rows = [(i, t) for i, t, _ in documents]
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_repeats(rows)


def test_repeats_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found_repeats(odd) == brute_repeats(rows)


def test_repeats_random_edits(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé ") for _ in range(200)) for _ in range(4)] + ["ab" * 120, "a" * 300]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        cut = rng.randrange(len(t))
        rows.append((rng.randrange(40), t[cut:] + rng.choice(["", "x"]) + rng.choice(base)[:rng.randrange(120)]))
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_repeats_kept_bytes(spark):
    shared = "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    df = spark.createDataFrame([(2, "x" + shared + "y"), (1, shared)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df, with_text=True).collect()}
    assert kept == {1: shared.encode(), 2: b"xy"}


def test_repeats_of_hot_hashes(spark, monkeypatch):
    """Windows dealt one by one give the same result."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(i, f"{i} " * 5 + line + f" {i}" * 8) for i in range(30)]
    import functools
    monkeypatch.setattr(suffix_dedup, "send_contexts", functools.partial(suffix_dedup.send_contexts, hot_from=2))
    assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_repeats_empty_table(empty):
    assert found_repeats(empty) == []


@pytest.mark.parametrize("seed", range(5))
def test_suffix_ranks(seed):
    rng = random.Random(seed)
    t = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(3, 300))] + [1, 0])
    for depth in (10, 10 ** 9):
        rank = suffix_dedup.suffix_ranks(t, np.arange(len(t)), 1, depth)
        cut = [tuple(t[i:i + depth].tolist() + [0] * 20)[:depth if depth < 99 else None] for i in range(len(t))]
        for i in range(len(t) - 1):
            assert all(rank[i] < rank[j] for j in range(len(t)) if cut[i] < cut[j])


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    posts, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            posts[g].append(i)
    for ids in posts.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    for (a, b), n in shared.items():
        if rows[a][0] is not None and rows[b][0] is not None and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return sorted(((d, len(s), None if d is None else min(least[root(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found_components(df):
    return sorted((tuple(r) for r in ngram_join.jaccard_components(df).drop("text_key").collect()), key=str)


def test_join_small_tables(spark, documents):
    rows = [(i, t) for i, t, _ in documents]
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_components(rows)


def test_join_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found_components(odd) == brute_components(rows)


def test_join_chains_in_small_pieces(spark, monkeypatch):
    """Chains of near copies and stray ones, with pieces of three sets: all ways through `linked` are taken."""
    monkeypatch.setattr(ngram_join, "PIECE", 3)
    rng = random.Random(6)
    rows, words = [], [f"w{k}" for k in range(60)]
    for _ in range(3):
        rng.shuffle(words)
        now = list(words)
        for _ in range(12):
            rows.append((len(rows), " ".join(now)))
            now[rng.randrange(60)] = f"n{rng.randrange(10 ** 6)}"
            if rng.random() < 0.4:
                now[rng.randrange(60)] = "x"
    rows += [(100 + k, f"A{k} b c d") for k in range(3)] + [(200, "a1 B c D")]
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


@pytest.mark.parametrize("cost, last, least, most", [(0, 0, 2, 12), (64, 500_000, 1, 3)])
def test_join_settles_groups_in_few_rounds(spark, monkeypatch, cost, last, least, most):
    """Groups of several pieces whose members come together slowly: every way through `linked`, and no round that brings
    only a few more together (20 of them before)."""
    monkeypatch.setattr(ngram_join, "PIECE", 8)
    monkeypatch.setattr(ngram_join, "ROUND", cost)
    monkeypatch.setattr(graph, "LAST_EDGES", last)
    rounds, merged = [], ngram_join._merged
    monkeypatch.setattr(ngram_join, "_merged", lambda rows: rounds.append(1) or merged(rows))
    rng = random.Random(11)
    rows, words = [], [f"w{k}" for k in range(100)]
    for k in range(90):
        now = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9])):
            now[rng.randrange(100)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((k, " ".join(now)))
    rows += [(200 + k, " ".join(f"g{k // 3}x{i}" for i in range(30)) + f" end{k}") for k in range(60)]
    want = brute_components(rows)
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want
    assert len({c for d, _, c in want if d < 200}) > 5 and least <= len(rounds) <= most


def test_join_hashes_each_text_once_for_its_digest(spark, monkeypatch):
    """Blocks hold each row once with the digest of its set; copies are left out by their place in the block, not by a
    second pass over the texts."""
    docs = spark.createDataFrame([(3, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (1, "x y"), (5, None)], "doc_id long, text string").coalesce(1)
    blocks = ngram_join.digested(docs, "doc_id", "text")
    members, firsts = ngram_join.classes(blocks)
    assert [(r.doc_ids, r.shingles) for r in blocks.collect()] == [([3, 1, None, 1, 5], [2, 2, 2, 1, 0])]
    assert members.count() == 5 and {(r.doc_id, r.weight, r.pos) for r in firsts.collect()} == {(1, 2, 1), (1, 1, 3)}


def test_join_empty_table(empty):
    assert found_components(empty) == []


def test_link_all_random_sets():
    rng = random.Random(2)
    for _ in range(60):
        base = [rng.sample(range(1, 10 ** 6), rng.randint(1, 60)) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(2, 50)):
            b = list(rng.choice(base))
            for _ in range(rng.randint(0, len(b) // 3 + 1)):
                b[rng.randrange(len(b))] = rng.randrange(10 ** 6)
            sets.append(np.unique(np.array(b, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        want, got = ngram_join.Forest(len(sets)), ngram_join.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    want.join(i, j)
        for a, b in ngram_join.link_all(sets, list(range(len(sets)))):
            got.join(a, b)
        assert [want.root(i) for i in range(len(sets))] == [got.root(i) for i in range(len(sets))]


@pytest.mark.parametrize("last", [0, 120, 10 ** 6])
def test_components_random_edges(spark, monkeypatch, last):
    """In steps, in one task, and in one task after some steps."""
    monkeypatch.setattr(graph, "LAST_EDGES", last)
    rng = random.Random(9)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(160)]
    up = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == up


def test_components_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in re.findall(r"[^ \t-\r]+", t or "")]
        if i is not None and w:
            sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}, sets


@pytest.mark.parametrize("piece", [3, 256])
def test_every_link_is_found(spark, monkeypatch, piece):
    """All links of groups of near texts, also across pieces; copies count by their number."""
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    rng = random.Random(8)
    rows = [(None, "a b c d e f"), (-1, None), (-2, " ")]
    for g in range(4):
        words = [f"g{g}w{k}" for k in range(160)]
        for _ in range(14):
            t = list(words)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(160)] = f"x{rng.randrange(9)}"
            rows += [(len(rows) + k, " ".join(t)) for k in range(rng.choice([1, 1, 2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, sets = brute_links(rows)
    first = {frozenset(s): i for i, s in sorted(sets.items(), reverse=True)}
    pairs = [tuple(r) for r in ngram_join.jaccard_links(df).collect()]
    assert sorted(pairs) == sorted((a, b) for a, b in want if sets[a] != sets[b] and {a, b} <= set(first.values())) and len(pairs) > 100
    count = {i: 0 for i, _ in rows if i is not None} | {None: None}
    for a, b in want:
        count[a] += 1
        count[b] += 1
    assert {r.doc_id: r.n_links for r in ngram_join.jaccard_link_counts(df).collect()} == count


def test_links_small_tables(spark, documents, empty):
    rows = [(i, t) for i, t, _ in documents]
    want, _ = brute_links(rows)
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_link_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: sum(i in p for p in want) for i, _ in rows}
    assert ngram_join.jaccard_link_counts(empty).count() == 0 and ngram_join.jaccard_links(empty).count() == 0
