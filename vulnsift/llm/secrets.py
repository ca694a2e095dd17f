"""Secret scans: base patterns over the text and, through a decoding worklist, over every layer inside it.

A layer is a text together with, for each of its characters, the span of the original text it came from.
URL and Unicode escapes are decoded over the whole layer; base64 runs are decoded at all four alignments, by line and
over line ends, and the readable stretches of what they hold (also in compressed data) become layers of their own, whose
characters all map to the stretch's place in the run. Every new layer is scanned and put back on
the worklist until nothing decodes any further. A layer is its text and its map: one that any path has reached before is not
followed again, so cycles end and orders of decoding that lead to the same layer cost it once. All work on one document happens where the row lies; no shuffle.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from vulnsift.llm.common import bounded, rows_of, text_slices

KINDS = ("assign", "access", "hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns, and the least length of what they must have found.
_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + \
    _either_case("api") + "_?" + _either_case("key")
ASSIGN = re.compile(rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")  # the same matches as HEX of 24 characters and more: runs are maximal
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
                            r"|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Fewer base64 characters hold fewer than the 12 bytes of the shortest secret.
LEAST_RUN, LEAST_TEXT = 16, 12
# a run of 16 and more, or runs that each end a line and go on at the start of the next
BASE64_BLOCK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++"
                          r"(?:(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++|(?<=[A-Za-z0-9+/_-]{16}))={0,2}")
BASE64_LINE = re.compile(r"([A-Za-z0-9+/_-]+)={0,2}")
URL_SAFE = {45: 43, 95: 47}
PRINTABLE = re.compile(rb"[\t-\r\x20-\x7e]{%d,}" % LEAST_TEXT)
PACKED = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Bytes unpacked at a time, and bytes that the pieces of large unpacked data share.
CHUNK, OVERLAP = 1 << 20, 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]
    found.sort()
    return found


class Layer:
    """A text whose character i came from the original span starts[i]..ends[i]; `fixed` maps all of it to one span."""

    __slots__ = ("text", "starts", "ends", "fixed")

    def __init__(self, text, starts=None, ends=None, fixed=None):
        self.text, self.starts, self.ends, self.fixed = text, starts, ends, fixed

    def key(self) -> bytes:
        """Digest of the text and of where its characters come from."""
        h = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        if self.fixed is not None:
            h.update(b"\xff%d %d" % self.fixed)
        elif self.starts is not None:
            h.update(b"\xff")
            h.update(self.starts.astype(np.int64))
            h.update(self.ends.astype(np.int64))
        return h.digest()

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.fixed is not None:
            return self.fixed
        if self.starts is None:
            return a, b
        return int(self.starts[a]), int(self.ends[b - 1])


def _replaced(layer: Layer, matches: list[tuple[int, int, str]]) -> Layer:
    """The layer with the given (start, end, replacement) runs replaced, and its map to the original."""
    parts, at = [], 0
    for a, b, new in matches:
        parts += [layer.text[at:a], new]
        at = b
    text = "".join([*parts, layer.text[at:]])
    if layer.fixed is not None:
        return Layer(text, fixed=layer.fixed)
    starts, ends, at = [], [], 0
    n = len(layer.text)
    old_s = layer.starts if layer.starts is not None else np.arange(n)
    old_e = layer.ends if layer.ends is not None else np.arange(1, n + 1)
    for a, b, new in matches:
        starts += [old_s[at:a], np.full(len(new), old_s[a])]
        ends += [old_e[at:a], np.full(len(new), old_e[b - 1])]
        at = b
    return Layer(text, np.concatenate([*starts, old_s[at:]]), np.concatenate([*ends, old_e[at:]]))


def _url(layer: Layer) -> Layer | None:
    if "%" not in layer.text:
        return None
    out = []
    for m in URL_ESCAPE.finditer(layer.text):
        try:
            new = bytes.fromhex(m.group().replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            continue
        # one replacement for each character, so that spans stay as narrow as the escape itself
        at = m.start()
        for c in new:
            width = 3 * len(c.encode("utf-8"))
            out.append((at, at + width, c))
            at += width
    return _replaced(layer, out) if out else None


def _unicode(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    out = []
    for m in UNICODE_ESCAPE.finditer(layer.text):
        digits = m.group(m.lastindex)
        code = int(digits, 10 if m.lastindex == 5 else 16)
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            out.append((m.start(), m.end(), chr(code)))
    return _replaced(layer, out) if out else None


def _unpacked(data: bytes, end: list[int]) -> Iterator[bytes]:
    """What the compressed members that lie end to end from end[0] on hold, as one run of chunks; end[0] becomes the
    position after the last whole member. Of a damaged or cut member what comes out before the damage is given."""
    view = memoryview(data)
    while m := PACKED.match(data, end[0]):
        kind, d = m.group()[:1], None
        try:
            if kind == b"\x28":
                d, at = zstandard.ZstdDecompressor().decompressobj(), end[0]
                while not d.eof and at < len(data):  # few bytes at a time bound what comes out at once
                    yield d.decompress(data[at:at + 256])
                    at = min(len(data), at + 256)
                left = len(data) - at + len(d.unused_data)
            elif kind in b"\x1fx":
                d = zlib.decompressobj(47)
                out = d.decompress(view[end[0]:], CHUNK)
                while out or d.unconsumed_tail and not d.eof:
                    yield out
                    out = d.decompress(d.unconsumed_tail, CHUNK) if not d.eof else b""
                left = len(d.unused_data)
            else:
                d = bz2.BZ2Decompressor() if kind == b"B" else lzma.LZMADecompressor()
                out = d.decompress(view[end[0]:], CHUNK)
                while out or not d.eof and not d.needs_input:
                    yield out
                    out = d.decompress(b"", CHUNK) if not d.eof and not d.needs_input else b""
                left = len(d.unused_data)
        except (zlib.error, OSError, lzma.LZMAError, zstandard.ZstdError, EOFError, ValueError):
            return
        if not d.eof:
            return
        end[0] = len(data) - left


def _pieces(chunks: Iterator[bytes], most: int) -> Iterator[bytes]:
    """The chunks put together: whole up to `most` bytes, beyond that in pieces of that size which overlap."""
    held, size, fresh, lap = [], 0, False, min(OVERLAP, most // 2)
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        fresh = fresh or bool(chunk)
        while size > most:
            whole = b"".join(held)
            yield whole[:most]
            held = [whole[most - lap:]]
            size = len(held[0])
    if fresh:
        yield b"".join(held)


def _readable(data: bytes) -> str | None:
    """UTF-8 text without control characters (but white space), else None."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return None if re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else text


def _texts(data: bytes, most: int, large: list[int], seen: set | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of what can be read in the bytes, also through compressed data in them, whose texts have its place.
    All base patterns and all that decodes is ASCII, so the ASCII stretches of partly readable bytes hold all that counts.
    large[0] counts compressed data of more than `most` bytes."""
    text = _readable(data)
    if text:
        yield 0, len(data), text
        return
    for m in PRINTABLE.finditer(data):
        yield m.start(), m.end(), m.group().decode("ascii")
    at = 0
    while m := PACKED.search(data, at):
        end, n = [m.start()], 0
        below = set() if seen is None else seen
        for piece in _pieces(_unpacked(data, end), most):
            n += 1
            digest = hashlib.sha256(piece).digest()
            if digest not in below:
                below.add(digest)
                stop = end[0] if end[0] > m.start() else len(data)
                for _, _, text in _texts(piece, most, large, below):
                    yield m.start(), stop, text
        large[0] += n > 1
        at = max(end[0], m.start() + 1)


def _decoded(run: str, most: int, large: list[int]) -> Iterator[tuple[int, int, str]]:
    """(first, last, text) of what the run's characters hold, at each of the four alignments base64 can have in it."""
    for a in range(4):
        n = len(run) - a
        if n < LEAST_RUN:
            break
        n -= n % 4 == 1
        data = binascii.a2b_base64(run[a:a + n] + "=" * (-n % 4))
        for s, e, text in _texts(data, most, large):
            yield a + s // 3 * 4, len(run) if e == len(data) else a - (-e // 3) * 4, text


def _base64(layer: Layer, most: int, large: list[int]) -> Iterator[Layer]:
    """Layers for the texts in each block of base64 characters: in each of its lines, and in its lines run together."""
    for m in BASE64_BLOCK.finditer(layer.text):
        if m.end() - m.start() < LEAST_RUN:
            continue
        lines = [(r.start(), r.end(1), r.end()) for r in BASE64_LINE.finditer(layer.text, m.start(), m.end())]
        done, by_line, whole = [], [0], [0]
        for a, b, end in lines:
            if b - a < LEAST_RUN:
                continue
            for first, last, text in _decoded(layer.text[a:b].translate(URL_SAFE), most, by_line):
                done.append((a + first, end if last == b - a else a + last))
                yield Layer(text, fixed=layer.span(*done[-1]))
        run = "".join(layer.text[a:b] for a, b, _ in lines) if len(lines) > 1 else ""
        at = None
        for first, last, text in _decoded(run.translate(URL_SAFE), most, whole):
            if at is None:
                at = np.concatenate([np.arange(a, b) for a, b, _ in lines])
            s, e = int(at[first]), m.end() if last == len(run) else int(at[last - 1]) + 1
            if not any(a <= s and e <= b for a, b in done):
                yield Layer(text, fixed=layer.span(s, e))
        large[0] += max(by_line[0], whole[0])


def _children(layer: Layer, most: int, large: list[int]) -> Iterator[Layer]:
    return (child for child in chain((_url(layer), _unicode(layer)), _base64(layer, most, large)) if child is not None)


def scan(text: str, most: int = 1 << 26) -> tuple[list, list, int, int]:
    """Base spans, all spans (both as (start, kind, end), sorted), decoded layers, and how many pieces of compressed
    data unpack to more than `most` bytes and so were scanned in overlapping pieces."""
    base = base_spans(text)
    spans, layers, large = set(base), 0, [0]
    whole = Layer(text)
    seen, work = {whole.key()}, [_children(whole, most, large)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        here = layer.key()
        if here in seen:
            continue
        seen.add(here)
        layers += 1
        for a, kind, b in base_spans(layer.text):
            s, e = layer.span(a, b)
            spans.add((s, kind, e))
        work.append(_children(layer, most, large))
    return base, sorted(spans), layers, large[0]


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
          "n_layers long, n_oversize long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                    ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("n_oversize", pa.int64())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base patterns, the digest of their spans, and all spans.

    Spans are code points of the original text, end exclusive, as kind:start:end by start and then kind.
    A null or empty text has no spans. Repeated rows and null ids are scanned like any row; an empty table
    gives no rows; other columns are not read. Compressed data that unpacks to more than 64 MB is counted in
    n_oversize and scanned in pieces that share 1 MB.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (part for batch in batches for part in text_slices(batch)):
            rows = []
            for doc, text in zip(ids, texts):
                base, spans, layers, large = scan(text)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), layers, large))
            yield rows_of(_ARROW, list(zip(*rows)))

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """`docs` (doc_id, text, lang, source, n_chars) with every found span, decoded ones included, replaced by `mask`
    and n_chars counted anew. Overlapping spans are merged; null texts stay null; every row stays."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()),
                       ("source", pa.string()), ("n_chars", pa.int64())])

    def masked(text):
        if not text:
            return text
        _, spans, _, _ = scan(text)
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in bounded(batch, 1)):
            old = part.column(1).to_pylist()
            new = [masked(t) for t in old]
            size = [len(t) if t is not None and t is not o else c for t, o, c in zip(new, old, part.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), *part.columns[2:4], pa.array(size, pa.int64())], schema=arrow)

    return docs.select([docs[c].cast(t) for c, t in zip(names, ("long", "string", "string", "string", "long"))]) \
        .mapInArrow(run, schema)
