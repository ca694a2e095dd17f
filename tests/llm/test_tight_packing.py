"""Best-fit packing by the configuration program, against the tokenizer file, exact covers and small exhaustive optima."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vulnsift.llm import config_packing as P
from vulnsift.llm.packing import best_fit_decreasing
from vulnsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(FILE)
WORDS = P.WordIds(FILE)


def of(texts):
    flat, ends = WORDS.of(pa.array(texts, pa.string()))
    return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t~'sÉ́ßΣİ<|endoftext|>")), max_size=60), max_size=4))
def test_ids_equal_the_tokenizer_file(texts):
    assert of(texts) == [np.array(ids(t), "<u4").tobytes() for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x00\x7f'sStrevmld0189aZÀéßÿ~!<>.,\xd7"), max_size=40), max_size=5))
def test_ids_of_plain_texts(texts):
    assert of(texts) == [np.array(ids(t), "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("text", [" " * 2_500_000, "\n" * 1_200_000, "ab " * 900_000, "é" * 20_000, "x" * 200_000, "<|endoftext|>" * 5000 + "~ a ~"])
def test_ids_of_long_texts(text):
    assert of(["a", text, "", "b"])[1] == np.array(ids(text), "<u4").tobytes()


def check(rows, texts, capacity=4096, end_id=1):
    """Every id in exactly one piece, cuts only where allowed, sequences gapless; returns how many there are."""
    want = Counter()
    for doc, text in texts:
        all_ids = [*ids(text), end_id]
        for n, start in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[start:start + capacity]
            want[doc, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at, total = Counter(), 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        total += r.length
    assert max(at.values(), default=0) <= capacity
    return len(at), -(-total // capacity)


def test_whole_table(spark, documents):
    used, least = check(QUERIES["op11_best_fit"](spark, SF).collect(), [(i, t) for i, t, _ in documents])
    assert used == least


def test_odd_rows(odd, empty):
    check(P.pack_tightly(odd, FILE).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    used, _ = check(P.pack_tightly(odd, FILE, capacity=16).collect(), [(r.doc_id, r.text) for r in odd.collect()], 16)
    assert used > 1
    assert P.pack_tightly(empty, FILE).collect() == []


def test_pieces_of_one_length_over_many_tasks(spark):
    """A third and more of all pieces share one length; ranks run through all tasks."""
    rows = [(i, "same words here") for i in range(900)] + [(i, "w " * (i % 50)) for i in range(900, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    used, least = check(P.pack_tightly(docs, FILE, capacity=64).collect(), rows, 64)
    assert used == least


def optimum(lengths, capacity):
    @lru_cache(None)
    def need(rest):
        if not rest:
            return 0
        first, others, best = rest[-1], rest[:-1], len(rest)
        seen = set()
        for mask in range(1 << len(others)):
            some = tuple(x for i, x in enumerate(others) if mask >> i & 1)
            if sum(some) + first <= capacity and some not in seen:
                seen.add(some)
                best = min(best, 1 + need(tuple(x for i, x in enumerate(others) if not mask >> i & 1)))
        return best
    return need(tuple(sorted(lengths)))


def laid_out(lengths, capacity):
    plan = P.plan(dict(Counter(lengths)), capacity)
    a = np.sort(np.array(lengths, np.int64))
    seq, off = plan.place(a, np.arange(len(a)) - np.searchsorted(a, a, "left"))
    order = np.lexsort((off, seq))
    at = Counter()
    for s, o, n in zip(seq[order].tolist(), off[order].tolist(), a[order].tolist()):
        assert o == at[s]
        at[s] += n
    assert len(at) == plan.sequences and max(at.values()) <= capacity
    return plan


def test_against_exhaustive_search():
    rng = random.Random(4)
    worse = 0
    for _ in range(40):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        plan, best = laid_out(lengths, 20), optimum(lengths, 20)
        assert plan.bound <= best + 1e-9 and plan.sequences >= best
        worse += plan.sequences > best
    assert worse <= 1


def test_where_best_fit_decreasing_is_not_best():
    lengths = np.random.default_rng(0).integers(600, 2100, 4000).tolist()
    assert laid_out(lengths, 4096).sequences < 0.99 * best_fit_decreasing(lengths, 4096)[2]
    assert laid_out([1366] * 300 + [1365] * 300 + [4096] * 3, 4096).sequences == 228
    assert laid_out([2049] * 500 + [100] * 5, 4096).sequences == 500


def test_bound_and_large_counts():
    counts = {1: 10**9, 700: 10**8, 1500: 10**8, 2500: 10**7}
    plan = P.plan(counts, 4096)
    # prices 0.2 of 700, 0.4 of 1500 and 0.6 of 2500 prove that no packing needs fewer
    assert sum(s * n for s, n in counts.items()) / 4096 - 1 <= plan.bound <= plan.sequences == 66_000_000
    assert (plan.rank >= 0).all() and len(plan.length) < 1000


def test_knapsack_values_equal_a_plain_program():
    rng = np.random.default_rng(0)
    for sparse in (3, 30):
        weight = np.zeros(61)
        weight[rng.choice(np.arange(1, 61), sparse, replace=False)] = rng.random(sparse)
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1]] + [weight[s] + best[c - s] for s in range(1, c + 1) if weight[s] > 0])
        assert np.allclose(P.best_values(weight, 60), best)
