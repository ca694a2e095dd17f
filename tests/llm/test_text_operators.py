"""Quality, fingerprints, licenses, secrets, decontamination, language ID: brute force, held-out accuracy, odd rows."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
import zstandard

from vulnsift.llm import decontaminate, fingerprints, langid, licenses, quality, secrets
from vulnsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def by_text(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- quality -------------------------------------------------------------------------

def test_quality_held_out(spark):
    scored = QUERIES["op2_quality"](spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (6, 1), (10, 0), (None, 1), (9, 0), (9, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 9) for r in rows if r.doc_id in (1, 2, 3)}) == 1  # no words: one score
    assert quality.score_quality(empty, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


def test_word_vectors_against_loops(spark):
    texts = ["a b c a", "b a", None, "c c c c c"]
    index = quality.index_vectors().astype(int)
    total = np.zeros((quality.WORDS, quality.DIM))
    number = lambda w: zlib.crc32(w.encode()) % quality.WORDS
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(len(w)):
                if 0 < abs(i - j) <= quality.REACH:
                    total[number(w[i])] += index[number(w[j])]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(got, total / np.where(norm > 0, norm, 1), atol=1e-6)


# --- fingerprints ----------------------------------------------------------------------

def test_fingerprints_order_and_edit(spark, documents):
    rows = [(i, t or "") for i, t, _ in documents]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), runs=16).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        new = t[:len(t) - half] + u[:half]
        r = got[i]
        own, marks, nxt = (fingerprints.chunk_weights(x) for x in (t, new, u))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(own), fingerprints.fingerprint(marks))
        assert r.near_edited == fingerprints.likeness(own, marks) and r.near_next == fingerprints.likeness(own, nxt)
        assert fingerprints.weights_of(r.fingerprint) == own


def test_fingerprints_odd_rows(spark, odd, empty):
    rows = fingerprints.fingerprints(odd, runs=4).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.n_chars)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_chunks_are_bounded_and_resist_shifts():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ijk") for _ in range(20000))
    ends = fingerprints.chunk_ends(text.encode())
    sizes = np.diff([0, *ends])
    assert ends[-1] == 20000 and sizes.max() <= fingerprints.MAX_CHUNK and sizes[:-1].min() >= fingerprints.MIN_CHUNK
    shifted = fingerprints.chunk_weights("xyz" + text)
    assert fingerprints.likeness(fingerprints.chunk_weights(text), shifted) > 0.97
    assert fingerprints.chunk_ends(b"") == [] and fingerprints.chunk_ends(b"a" * 1000)[-1] == 1000


def test_chunk_pieces_do_not_matter(monkeypatch):
    data = bytes(random.Random(5).choices(range(256), k=5000))
    whole = fingerprints.chunk_ends(data)
    monkeypatch.setattr(fingerprints, "PIECE", 100)
    assert fingerprints.chunk_ends(data) == whole


# --- licenses ----------------------------------------------------------------------------

def brute_licenses(text, templates=licenses.TEMPLATES):
    words = lambda t: [tuple(x) for x in zip(*(re.findall(r"[^\W_]+", (t or "").lower())[k:] for k in range(5)))]
    doc, out = words(text), []
    for name, template in templates.items():
        sh = words(template)
        place = {}
        for k, s in enumerate(sh):
            place.setdefault(s, k)
        run, last = [], None
        runs = [run]
        for pos, s in enumerate(doc):
            if s in place:
                if last and (place[s] < last[1] or pos - last[0] > len(place) + licenses.WINDOW):
                    run = []
                    runs.append(run)
                run.append((pos, place[s]))
                last = (pos, place[s])
        for run in runs:
            n = len({i for _, i in run})
            if run and n / len(place) >= licenses.LEAST:
                out.append((name, run[0][0], run[-1][0] + 5, n))
    return out


def found_licenses(df):
    return sorted((r.doc_id, r.license, r.start_word, r.end_word, r.n_matched) for r in licenses.scan_licenses(df).collect())


def test_licenses_against_brute_force(spark):
    rng = random.Random(1)
    filler = [f"w{k}" for k in range(50)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(filler, k=rng.randrange(30)))]
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randrange(4)):
            t = licenses.TEMPLATES[name].split()
            if rng.random() < 0.3 and len(t) > 30:
                t[rng.randrange(10)] = "other"
            parts += [rng.choice([" ".join(t), " ".join(t).upper()]), " ".join(rng.choices(filler, k=rng.randrange(20)))]
        rows.append((i, "\n".join(parts)))
    want = sorted((i, *x) for i, t in rows for x in brute_licenses(t))
    assert len(want) > 100 and found_licenses(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_licenses_small_tables(spark, documents):
    rows = [(i, t) for i, t, _ in documents]
    assert found_licenses(spark.createDataFrame(rows, "doc_id long, text string")) == sorted((i, *x) for i, t in rows for x in brute_licenses(t))


def test_licenses_odd_rows(odd, empty):
    assert found_licenses(odd) == [] and found_licenses(empty) == []


def test_license_plan_has_no_python(spark):
    plan = QUERIES["op5_licenses"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- secrets -----------------------------------------------------------------------------

def brute_chunks(data):
    """Byte by byte: a gear hash rolled over all bytes, of which the last 32 count; a chunk ends where it passes the mask."""
    from vulnsift.llm import fingerprints as fp

    out, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(fp.GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - start
        bits = fp.HARD_BITS if size < fp.AVG_CHUNK else fp.EASY_BITS
        if size >= fp.MAX_CHUNK or size >= fp.MIN_CHUNK and h >> (32 - bits) == 0:
            out.append(i + 1)
            start = i + 1
    return out + [len(data)] * (start < len(data))


def test_chunks_equal_a_rolling_hash(documents):
    from vulnsift.llm import fingerprints as fp

    rng = random.Random(3)
    texts = [t.encode() for _, t, _ in documents if t] + [bytes(rng.choices(range(256), k=n)) for n in (1, 15, 16, 17, 255, 257, 5000)] + [b"a" * 1000, b""]
    for data in texts:
        assert fp.chunk_ends(data) == brute_chunks(data)


def test_kernel_equals_sets_of_ngrams(documents):
    """Rows of `presence` have the inner products that cosines of hashed n-gram sets give."""
    texts = [t for _, t, _ in documents[:12] if t]
    rows = langid.presence(texts)
    grams = []
    for t in texts:
        low, at, sets = t.lower(), 0, []
        for n, width in zip((1, 2, 3), langid.SPECTRUM):
            seen = {int(np.flatnonzero(langid.presence([low[i:i + n]])[0][at:at + width])[0]) for i in {low[j:j + n]: j for j in range(len(low) - n + 1)}.values()}
            sets.append(seen)
            at += width
        grams.append(sets)
    for i, a in enumerate(grams):
        for j, b in enumerate(grams):
            want = sum(len(x & y) / (len(x) * len(y)) ** 0.5 for x, y in zip(a, b))
            assert abs(float(rows[i] @ rows[j]) - want) < 1e-3


def test_many_languages_and_repeated_ids(spark):
    """250 languages all teach; of an id that comes often each language takes one text."""
    rows = [(k * 50 + i, f"{chr(0x4E00 + k)}{chr(0x5200 + k)} " * 5, f"l{k:03}") for k in range(250) for i in range(4)]
    rows += [(3, "zz yy " * 4, "l000")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = langid.sample(docs, 2, "doc_id", "text", "lang").collect()
    assert {r.lang for r in taught} == {y for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert max(Counter(r.lang for r in taught).values()) <= 2 and len({(r.lang, r.doc_id) for r in taught}) == len(taught)


def test_labels_of_repeated_ids_push_none_out(spark):
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(3, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    taught = quality.labelled(docs, labels, 20, "doc_id", "text", "quality")
    assert len(taught) == len(set(taught)) >= 15


def brute_base(text):
    kinds = [("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             ("access", r"(AKIA)[A-Z0-9]+"), ("hex", r"([0-9a-f])[0-9a-f]*")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m.group(2) if kind == "assign" else m.group()) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(documents):
    rng = random.Random(9)
    texts = [t or "" for _, t, _ in documents]
    bits = ["token", "TOKEN", "api_key", "apikey", "ſecret", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "x", "é", "passwd=", "-"]
    texts += ["".join(rng.choices(bits, k=40)) for _ in range(400)]
    for t in texts:
        assert secrets.base_spans(t) == brute_base(t)


SECRET = 'password = "hunter2hunter"'


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(("ÿ?>" + s).encode()).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(base64.b64encode(s.encode()))).decode(),
    lambda s: quote(quote(base64.b64encode(s.encode()).decode(), safe=""), safe=""),
    lambda s: base64.b64encode(s.replace("o", "\\u006f").encode()).decode(),
    lambda s: base64.b64encode(quote(s, safe="").encode()).decode(),
])
def test_nested_layers(wrap):
    inner = wrap(SECRET)
    base, spans, layers, _ = secrets.scan(f"start {inner} end")
    assert base == [] and layers and any(k == 0 and 6 <= a and b <= 6 + len(inner) for a, k, b in spans)


def test_escapes_map_to_their_own_span():
    text = "x tok%65n = abcdef1 \\u0074oken = qwertyu y"
    spans = secrets.scan(text)[1]
    assert {text[a:b] for a, _, b in spans} == {"tok%65n = abcdef1", "\\u0074oken = qwertyu"}


def test_cycles_and_large_layers_end():
    assert secrets.scan("%25" * 50)[1] == []
    bomb = base64.b64encode(gzip.compress(b"a" * 5000)).decode()
    assert secrets.scan(bomb, most=1000)[3] == 1 and secrets.scan(bomb)[3] == 0


def b64(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def wrapped(s, width, end="\n"):
    return end.join(s[i:i + width] for i in range(0, len(s), width))


NOISE = bytes(random.Random(2).choices(range(256), k=400))


@pytest.mark.parametrize("text", [
    *(before + b64(SECRET) + after for before in ("https://example.org/cfg/", "key-", "/", "x=", "a", "ab_", "abc/") for after in ("", "/tail", "-a")),
    b64("?" + SECRET).rstrip("=") + "a",
    wrapped(b64("some text " * 5 + SECRET), 76), wrapped(b64("some text " * 5 + SECRET), 20, "\r\n  "), wrapped(b64(SECRET), 10),
    wrapped(b64(gzip.compress(NOISE + SECRET.encode())), 76), "word\n" + wrapped(b64(bz2.compress(SECRET.encode())), 64) + "\nword",
    b64(b"\0" + SECRET.encode()), b64(SECRET.encode() + b"\xff"), b64(NOISE + SECRET.encode() + NOISE),
    b64(gzip.compress(NOISE) + gzip.compress(SECRET.encode())), b64(gzip.compress(SECRET[:8].encode()) + gzip.compress(SECRET[8:].encode())),
    b64(lzma.compress(NOISE) + lzma.compress(SECRET.encode())), b64(b"head \0" + zlib.compress(SECRET.encode()) + NOISE),
    *(b64(zstandard.compress(NOISE) + zstandard.compress(SECRET.encode()) + end) for end in (b"", b"\0")),
    "cfg/" + b64(gzip.compress(b64(gzip.compress(SECRET.encode())).encode())), b64(gzip.compress(SECRET.encode() + NOISE)[:-20]),
])
def test_base64_wherever_it_lies(text):
    base, spans, _, _ = secrets.scan(f"start {text} end")
    assert base == [] and any(k == 0 and 6 <= a < b <= 6 + len(text) for a, k, b in spans)


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_large_layers_are_scanned_in_pieces(pack, monkeypatch):
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    monkeypatch.setattr(secrets, "CHUNK", 64)
    for at in range(900, 1100, 7):
        _, spans, _, large = secrets.scan(b64(pack(b"." * at + SECRET.encode() + b"." * 3000)), most=1000)
        assert spans and large == 1


def every_layer(text):
    """Spans by following every order of decoding to its end, without remembering what was seen."""
    out = set()

    def follow(layer, path):
        if (layer.text, layer.fixed) in path:
            return
        if path:
            out.update((layer.span(a, b)[0], k, layer.span(a, b)[1]) for a, k, b in secrets.base_spans(layer.text))
        for child in secrets._children(layer, 1 << 20, [0]):
            follow(child, (*path, (layer.text, layer.fixed)))

    follow(secrets.Layer(text), ())
    return sorted(out | set(secrets.base_spans(text)))


def nested(depth, payload=SECRET, escapes=True):
    for _ in range(depth):
        payload = (r"%41\u0042 " if escapes else "") + b64(payload)
    return payload


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_visited_layers_lose_no_span(depth):
    text = f"start {nested(depth)} end %70assword=abcdefgh"
    assert secrets.scan(text)[1] == every_layer(text) and len(secrets.scan(text)[1]) >= 2


def test_deep_nesting_ends():
    """Every level has a URL and a Unicode escape, so five forms of it; each is followed once."""
    for depth in (9, 16):
        began = time.process_time()
        text = nested(depth)
        _, spans, layers, _ = secrets.scan(text)
        assert layers <= 30 * depth and any(k == 0 for _, k, _ in spans) and time.process_time() - began < 3
    began = time.process_time()
    text = nested(40, "token = abcdefgh", escapes=False)
    assert secrets.scan(text)[1] and time.process_time() - began < 8 * len(text) / 1e6


def test_redact_masks_decoded_secrets_in_runs(spark):
    df = spark.createDataFrame([(1, f"see https://example.org/cfg/{b64(SECRET)} now", "en", "s", 5)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    assert b64(SECRET)[8:] not in secrets.redact(df).first().text


def test_secrets_odd_rows(odd, empty):
    rows = secrets.find_secrets(odd).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()} and secrets.find_secrets(empty).count() == 0


def test_redact(spark, odd):
    df = spark.createDataFrame([(1, f"a {SECRET} b", "en", "s", 5), (2, None, None, None, None), (3, "plain", "en", "s", 99)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.redact(df).collect()}
    assert got == {1: ('a <SECRET>" b', "en", "s", 13), 2: (None, None, None, None), 3: ("plain", "en", "s", 99)}


# --- decontamination ------------------------------------------------------------------------

def edits_needed(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        old, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d))
    return min(row)


def test_alignment_against_full_table():
    rng = random.Random(3)
    for _ in range(200):
        item = "".join(rng.choices("abcd ", k=rng.randint(5, 30)))
        s = list(item)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(s) + 1)
            s[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
        text = "".join(rng.choices("abcd", k=10)) + "".join(s) + "".join(rng.choices("abcd", k=10))
        got = decontaminate.align(decontaminate.code_points(item), decontaminate.code_points(text), -99, 99, 99)
        assert got[0] == edits_needed(item, text) == edits_needed(item, text[got[1]:got[2]])


def test_items_with_edits_are_found(spark):
    """Everything within the edit budget is found, nothing beyond it (brute force over whole texts)."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rng.randint(8, 30))) for k in range(8)]
    docs = []
    for i in range(40):
        k, t = rng.choice(items)
        s = list(t)
        for _ in range(rng.randint(0, int(len(t) * 0.14))):
            j = rng.randrange(len(s))
            s[j:j + 1] = rng.choice([[], ["z"], [s[j], "z"]])
        docs.append((i, prose(rng.randint(0, 20)) + " " + "".join(s).upper().replace(" ", " \n") + " " + prose(rng.randint(0, 20))))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, d in docs for k, t in items if edits_needed(t, re.sub(r"\s+", " ", d.lower())) <= int(0.1 * len(t))}
    assert got == want and 10 < len(want) < 40


def test_items_in_long_texts_and_spans(monkeypatch):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    index = decontaminate.build([(5, item)])
    texts = ["", "x" * 900 + item + "y" * 700 + item.upper(), item]
    want = [(1, 5, 900, 900 + len(item), 0), (1, 5, 1600 + len(item), 1600 + 2 * len(item), 0), (2, 5, 0, len(item), 0)]
    assert decontaminate.matches(index, texts) == want
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    assert decontaminate.matches(index, texts) == want


def test_short_items_on_word_borders(monkeypatch):
    index = decontaminate.build([(1, "What is 2+2?"), (2, "what  is 2+2?"), (3, "cat"), (4, "x" * 31), (5, "long " * 8), (6, " ")])
    texts = ["Q: WHAT is\n2+2? A", "concat cats cat", "cat", "cat_ 'cat'", "y" + "x" * 31, "x" * 31, "what is 2+", "2?"]
    want = [(0, 1, 3, 15, 0), (0, 2, 3, 15, 0), (1, 3, 12, 15, 0), (2, 3, 0, 3, 0), (3, 3, 6, 9, 0), (5, 4, 0, 31, 0)]
    assert decontaminate.matches(index, texts) == want
    for piece in (1, 5, 50):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        assert decontaminate.matches(index, texts) == want


def test_decontaminate_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a very long text of words a very long text of words"), (None, "x" * 40)], "item_id long, text string")
    rows = decontaminate.find_items(odd, items).collect()
    assert {r.doc_id for r in rows} == {6, 7} and {r.item_id for r in rows} == {4}
    assert decontaminate.find_items(empty, items).count() == 0 and decontaminate.find_items(odd, items.limit(0)).count() == 0


# --- language ID ----------------------------------------------------------------------------

def test_language_held_out(spark):
    rows = QUERIES["op9_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_sample_of_many_rows(spark):
    """More than 2^23 labelled rows of one language outside the held-out fold."""
    docs = spark.range(14_000_000).selectExpr("id as doc_id", "'text ' || id as text", "'en' as lang")
    assert langid.sample(docs, 50, "doc_id", "text", "lang").count() == 50


def test_language_odd_rows(spark, odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 12)} == {("und", 0.0)}
    assert langid.identify(empty).count() == 0
    unknown = odd.withColumn("lang", odd.lang.substr(100, 1).isNull().cast("string")).drop("lang").withColumn("lang", odd.text.substr(0, 0))
    assert langid.identify(unknown.withColumn("lang", unknown.lang.cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")).select("lang_pred").distinct().collect() == [("und",)]


def test_presence_is_the_set_of_grams():
    long = "héllo wörld " * 50
    a, b = langid.presence([long, long * 3])
    assert np.allclose(a, b) and abs(float(a @ a) - 3) < 1e-5
    old, langid.PIECE = langid.PIECE, 37
    try:
        assert np.allclose(langid.presence([long])[0], a)
    finally:
        langid.PIECE = old
