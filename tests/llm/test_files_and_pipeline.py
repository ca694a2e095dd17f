"""Packing, WARC archives and the corpus pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from vulnsift.llm import packing, warc
from vulnsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_ids_equal_the_tokenizer_file(tokenizer, documents):
    for _, t, _ in documents:
        assert ENCODER.encode_to_numpy(t or "").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_on_any_text(text):
    assert ENCODER.encode_to_numpy(text, allowed_special="all").tolist() == JSON.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**7, "\n" * 10**7, "a" * 10**6, "ab1 \n" * 10**6, " \t" * 10**6 + "x", "word " * 10**6 + " " * 10**6 + "end"])
def test_ids_of_long_runs(text):
    got = packing.ids_of(text, ENCODER, public_tokenizers.path("byte_bpe_50k.json"))
    assert got.tolist() == JSON.encode(text, add_special_tokens=False).ids


def check_pieces(rows, texts, tokenizer, window=1024):
    """Every id in exactly one piece, sequences gapless and within the window; returns the share of padding."""
    ids = {}
    for doc, text in texts:
        ids.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[doc]))
        for p in pieces:
            assert any(p.doc_tokens == len(x) and p.ids_crc32 == zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) for x in ids[doc])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return 1 - sum(r.length for r in rows) / (window * len(by_seq)) if rows else 0


def test_packing_small_tables(spark, documents, tokenizer):
    assert check_pieces(QUERIES["op6_packing"](spark, SF).collect(), [(i, t) for i, t, _ in documents], tokenizer) < 0.02


def test_packing_odd_rows(odd, empty, tokenizer):
    pack = lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")).collect()
    check_pieces(pack(odd), [(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    assert pack(empty) == []


@pytest.fixture(scope="module")
def plain_tokenizer():
    """The tokenizer file as it loads, with its added tokens."""
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ADDED_TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n\n y<|endoftext|><|endoftext|>", "<|endoftext| >", "<|<|endoftext|>|>",
               "é<|ENDOFTEXT|>", "word <|endoftext|>  " * 700]


def test_added_tokens_are_those_of_the_tokenizer_file(plain_tokenizer):
    assert packing.ADDED == {t.content: i for i, t in plain_tokenizer.get_added_tokens_decoder().items()}


def test_packing_of_added_tokens(spark, documents, plain_tokenizer):
    texts = list(enumerate([*ADDED_TEXTS, *(t for _, t, _ in documents)]))
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_tokens for r in rows if r.doc_id == 0} == {5}
    check_pieces(rows, texts, plain_tokenizer)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'s", "<|", "|>", "7", "é"]), max_size=30).map("".join))
def test_ids_equal_around_added_tokens(plain_tokenizer, text):
    assert ENCODER.encode_to_numpy(text, allowed_special="all").tolist() == plain_tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 200))]
        where, offset, n = packing.best_fit_decreasing(lengths, 64)
        rooms = []
        for size in sorted(lengths, reverse=True):
            fit = [(room, k) for k, room in enumerate(rooms) if room >= size]
            if fit:
                rooms[min(fit)[1]] -= size
            else:
                rooms.append(64 - size)
        filled = [0] * n
        for w, size in zip(where, lengths):
            filled[w] += size
        assert sorted(64 - f for f in filled) == sorted(rooms)


# --- WARC ------------------------------------------------------------------------------------

BODY = "<p>" + "x" * 120 + "</p>"


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", BODY), (1, "http://b c/\n", BODY), (2, None, "short"), (5, "u", "short"), (4, "u", None), (7, "u", "é" * 60),
            (6, "u", "é" * 60), (8, "u", BODY + " "), (None, "u", BODY), (9, "u", "y" * 99), (10, "u", "y" * 99), (1, "again", BODY)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, offset int, archive string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.read_archives(warc.write_archives(df)).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == data]
        first = min(same) if len(data) >= 100 and page is not None else page
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert got == sorted(want, key=str)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def archive(n=30, zipped=True):
    records = [warc.record(i, f"http://x/{i}", (BODY * (i + 1)).encode(), None, False) for i in range(n)]
    parts = [warc.member(r) for r in records] if zipped else records
    return b"".join(parts), np.cumsum([0, *map(len, parts)]).tolist()


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_after_damage(zipped):
    data, at = archive(zipped=zipped)
    assert len(warc.salvage(data).records) == 30 and warc.salvage(data).gaps == []
    spoiled = bytearray(data)
    middle = (at[5] + at[6]) // 2
    spoiled[middle:middle + 9] = b"\1" * 9                            # in record 5
    spoiled[at[9]:at[9] + 5] = b"\0" * 5                              # the start of record 9
    cut = bytes(spoiled[:at[29] - 7])                                  # record 28 cut short, 29 gone
    found = warc.salvage(cut)
    ids = [warc.page_of(h["warc-record-id"]) for _, h, _ in found.records]
    # of a zipped record only the checksum at its end is cut off: the record is whole and given, its member logged
    assert ids == [i for i in range(29 if zipped else 28) if i not in (5, 9)]
    assert [(a, b) for a, b, _ in found.gaps] == [(at[5], at[6]), (at[9], at[10]), (at[28], len(cut))]
    assert all(why for *_, why in found.gaps)


def test_damaged_member_of_one_whole_record():
    """The record before the damage is given, and the damage is logged."""
    whole, more = (warc.record(i, f"http://x/{i}", (BODY * 40).encode(), None, False) for i in (1, 2))
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    torn = z.compress(whole) + z.flush(zlib.Z_SYNC_FLUSH) + b"\xff" * 30
    found = warc.salvage(torn + warc.member(more))
    assert page_ids(found) == [1, 2] and [g[:2] for g in found.gaps] == [(0, len(torn))]


def test_salvage_of_junk():
    data, at = archive(4)
    found = warc.salvage(b"junk\x1f\x8b\x08" + data + b"WARC/1.1\r\nbroken")
    assert len(found.records) == 4 and [(a, b) for a, b, _ in found.gaps] == [(0, 7), (7 + len(data), 7 + len(data) + 16)]
    assert warc.salvage(b"").records == [] and warc.salvage(b"\0" * 100).gaps == [(0, 100, "no version line")]


def page_ids(found):
    return [warc.page_of(h["warc-record-id"]) for _, h, _ in found.records]


def test_salvage_inside_a_member():
    """One gzip member for a whole archive: bad records, a cut tail, damaged streams."""
    data, at = archive(30, zipped=False)
    spoiled = bytearray(data)
    spoiled[at[5] + 400] ^= 1                                          # in record 5's payload
    spoiled[at[9]:at[9] + 5] = b"\0" * 5                              # the start of record 9
    spoiled[at[12]:at[13]] = spoiled[at[12]:at[13]].replace(b"Content-Length", b"Content-Lungth")
    whole = warc.member(bytes(spoiled))
    found = warc.salvage(whole)
    assert page_ids(found) == [i for i in range(30) if i not in (5, 9, 12)]
    assert [(a, b) for a, b, _ in found.gaps] == [(0, len(whole))] * 3
    assert [f"unpacked bytes {at[i]} to {at[i + 1]}" in g[2] for i, g in zip((5, 9, 12), found.gaps)] == [True] * 3
    found = warc.salvage(warc.member(bytes(spoiled[:at[28] + 50])) + warc.member(data[:at[2]]))
    assert page_ids(found) == [i for i in range(28) if i not in (5, 9, 12)] + [0, 1]


@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("n", [40, 400])
def test_salvage_of_a_damaged_member(n, level):
    rng = random.Random(4)
    records = [warc.record(i, f"http://x/{i}", "".join(rng.choices("abcdefgh", k=rng.randrange(900))).encode(), None, False) for i in range(n)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    packed, ends = b"", []                                             # bytes that hold records 0..i whole
    for r in records:
        packed += z.compress(r) + z.flush(zlib.Z_SYNC_FLUSH)
        ends.append(len(packed))
    packed += z.flush()
    more = warc.member(records[0])
    for at in (n // 2, n - 1):
        cut = packed[:ends[at] - 20]
        assert page_ids(warc.salvage(cut)) == list(range(at)) and [g[:2] for g in warc.salvage(cut).gaps] == [(0, len(cut))]
        torn = packed[:ends[at]] + b"\xff" * 40 + more                 # no block type 3: an error right there
        found = warc.salvage(torn)
        assert page_ids(found) == [*range(at + 1), 0] and [g[:2] for g in found.gaps] == [(0, ends[at] + 40)]


def test_quarantine_log(spark):
    data, at = archive(6)
    bad = data[:at[2] + 30] + b"????" + data[at[2] + 34:]
    df = spark.createDataFrame([("a", bytearray(bad)), ("b", bytearray(data)), ("c", None)], "archive string, content binary")
    assert [(r.archive, r.start, r.stop) for r in warc.quarantine(df).collect()] == [("a", at[2], at[3])]
    assert warc.read_archives(df).count() == 11


# --- pipeline --------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Each stage on all that its predecessor kept; what a stage says about a document is what its operator says."""
    from vulnsift.llm import decontaminate, langid, ngram_join, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "123 456", "en", "s", 7)], docs.schema)
    now = docs.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF).cache()
        kept[name] = (before, now)
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a, b = kept["language"]
    assert ids(b) == ids(langid.identify(a).where("lang_pred <> 'und'")) and set(ids(a)) - set(ids(b)) == {10 ** 6, 10 ** 6 + 1}
    a, b = kept["near_duplicates"]
    assert ids(b) == ids(ngram_join.jaccard_components(a).where("doc_id = component_id"))
    a, b = kept["decontaminate"]
    hit = set(ids(decontaminate.find_items(a, spark.read.parquet(f"{SF}/benchmark.parquet"))))
    assert hit and ids(b) == [i for i in ids(a) if i not in hit]
    a, b = kept["secrets"]
    old, new = ({r.doc_id: r.text for r in x.collect()} for x in (a, b))
    assert old.keys() == new.keys() and all((old[i] == new[i]) == (not secrets.scan(old[i])[1]) for i in old)
    assert not any(secrets.base_spans(t) for t in new.values())
    a, b = kept["packing"]
    assert ids(a) == sorted(set(ids(b)))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Ids that repeat with equal and with different texts, null ids and texts, a very long text, extra columns."""
    words = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(4)]
    prose = "the people who came to the town in the evening were tired of the road "
    rows = [(1, prose + words[0]), (1, prose + words[0]), (1, prose + words[1]), (2, prose + words[1]), (3, prose + words[1]), (4, prose + words[2]),
            (None, prose + words[2]), (None, prose + words[3]), (5, None), (6, ""), (7, prose + words[3]), (8, " ".join(f"long{i}" for i in range(60_000))), (9, "a"), (9, "b")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, "x") for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long, score double, spans string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    texts = {prose + words[k]: k for k in range(4)}
    assert [(i, texts.get(t, len(t or ""))) for i, t in got if i in (1, 2, 3, 4, 7, None)] == [(1, 0), (1, 1), (4, 2), (7, 3), (None, 2), (None, 3)]
    assert {i for i, _ in got} == {1, 4, 5, 6, 7, 8, 9, None} and sorted(t for i, t in got if i == 9) == ["a", "b"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 4, 7, 8, 9, None}


def test_no_table_stays_in_the_executors(spark):
    """What the near-duplicate stage holds is freed when the next stage begins."""
    from vulnsift.llm.common import release_held

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    release_held(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    corpus_pipeline.near_duplicates(spark, docs, SF).write.format("noop").mode("overwrite").save()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    corpus_pipeline.decontaminate(spark, docs, SF)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_run_equals_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100


def test_near_duplicates_holds_only_its_members(spark):
    """Near sets are a table: while the stage's last join shuffles the texts, no earlier shuffle of theirs is held. Rows of one
    id and one text are no shared id."""
    from vulnsift.llm.common import release_held

    rows = [(k % 5, f"the road to the town was long and the {k % 5} people were tired of it") for k in range(10)] + [(7, "a b c"), (7, "d e f"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    release_held(spark)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted({(i or -1, t) for i, t in rows})
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before + 1
