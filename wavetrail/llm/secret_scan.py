"""Secret scans through nested encodings.

A text is scanned for three kinds of secrets. A worklist then unwraps what it holds: percent escapes and ``\\uXXXX`` escapes are
decoded in place, base64 runs become layers of their own, compressed payloads (zlib, gzip) inside base64 or hex runs are inflated. Runs
may be broken over lines or glued to a word; bytes that are no UTF-8 are read as Latin-1. Each
new layer is scanned like the text and unwrapped again, until nothing new appears; layers seen before (by digest) are not entered
again, which ends cycles. Every layer maps its places to the layer it came from, by arithmetic or by one entry a decoded escape, so each
secret is reported as a span of the text itself and memory follows the text by a small factor.

An escape that escapes an escape (``%2541``) is decoded in one step however deep the chain is, and what decoding makes anew is followed
to its end in one pass: a secret holds no percent sign, so none is lost between the steps.

One text is handled by one task, in a few passes; nothing is shuffled. A payload is inflated to its end, however large, in pieces of
``PIECE`` bytes: one piece and what it holds are scanned at a time. A piece begins with the encoded run that the one before it breaks off
in. Only a run of more than half a piece inside an inflated payload is cut: its parts are scanned, and as something compressed may go on
across the cut, the place is reported as kind ``oversized`` too, so nothing is dropped unseen.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetrail.llm.batches import slices
from wavetrail.llm.registry import query, table

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "oversized")
#: Bytes inflated at a time, and how many of them the next piece has again at least (a secret with its name fits).
PIECE, OVERLAP = 16 << 20, 1 << 16
#: What stands for a secret that was blanked.
BLANK = "[secret]"
#: Shortest run that is tried as base64 or hex.
MIN_RUN = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Equal to runs filtered by length: such a run can only begin at its left end, or at the first AKIA in it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
# the innermost escape of a chain ends it: %2541 is one unit
_UNIT = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}")
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_DIGITS = frozenset("0123456789abcdefABCDEF")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN)
_HEX_RUN = re.compile(r"[0-9a-fA-F]{%d,}" % MIN_RUN)
# runs broken over lines; the possessive quantifiers keep a long run without a line end linear
# (lines as long as a run, or three and more short ones)
_BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{%d,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++|[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++){2,}+)={0,2}" % MIN_RUN)
_HEX_LINES = re.compile(r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{%d,}+(?:[ \t]*+\r?\n[ \t]*+[0-9a-fA-F]++)++|[0-9a-fA-F]{4,}+(?:[ \t]*+\r?\n[ \t]*+[0-9a-fA-F]++){2,}+)" % MIN_RUN)
# what every secret has, plain or encoded; unreadable layers without it are not entered
_WORTH = re.compile(r"[A-Za-z0-9+/_.=%\\-]{8,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-%\\\r\n")] = True
_ODD = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Secrets of one layer, leftmost and not overlapping for each kind, by start and kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Layer:
    """Text, and how its places map to the layer it was decoded from; the root is the text itself."""

    parent: Layer | None = None

    def __init__(self, text: str):
        self.text = text

    def up(self, start: int, end: int) -> tuple[int, int]:
        """The span of the parent's text that [start, end) came from."""
        return start, end

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that [start, end) came from."""
        layer: Layer | None = self
        while layer is not None:
            start, end = layer.up(start, end)
            layer = layer.parent
        return start, end


class Replaced(Layer):
    """Escapes decoded in place. Pieces alternate between kept text, which maps character by character, and decoded characters."""

    def __init__(self, parent: Layer, text: str, here: array, left: array, right: array, plain: bytearray):
        super().__init__(text)
        self.parent, self.here, self.left, self.right, self.plain = parent, here, left, right, plain

    def up(self, start: int, end: int) -> tuple[int, int]:
        first = bisect_right(self.here, start) - 1
        last = bisect_right(self.here, end - 1) - 1 if end > start else first
        low = self.left[first] + (start - self.here[first] if self.plain[first] else 0)
        high = self.left[last] + (end - self.here[last]) if self.plain[last] else self.right[last]
        return low, high


class Payload(Layer):
    """A decoded run; `groups` of characters became as many bytes each, so a place is a matter of arithmetic."""

    def __init__(self, parent: Layer, text: str, at: Sequence[int], chars: int, size: int, utf8: bool):
        super().__init__(text)
        self.parent, self.at, self.chars, self.size = parent, at, chars, size
        self.bytes_before = None
        if utf8 and not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            self.bytes_before = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])

    def up(self, start: int, end: int) -> tuple[int, int]:
        if self.bytes_before is not None:
            start, end = int(self.bytes_before[start]), int(self.bytes_before[end])
        last = min(len(self.at), -(-max(end, start + 1) // self.size) * self.chars) - 1
        return self.at[start // self.size * self.chars], self.at[last] + 1


class Inflated(Layer):
    """Inflated bytes: every place maps to the whole compressed run."""

    def __init__(self, parent: Layer, text: str, span: tuple[int, int]):
        super().__init__(text)
        self.parent, self.span = parent, span

    def up(self, start: int, end: int) -> tuple[int, int]:
        return self.span


def _replaced(layer: Layer, decoded: Iterator[tuple[int, int, str]]) -> Layer | None:
    """The layer with every (start, end) of `decoded` replaced by its text; None if there is none."""
    out, at, length = [], 0, 0
    here, left, right, plain = array("q"), array("q"), array("q"), bytearray()

    def add(start: int, end: int, text: str, kept: bool) -> None:
        nonlocal length
        here.append(length)
        left.append(start)
        right.append(end)
        plain.append(kept)
        out.append(text)
        length += len(text)

    for start, end, text in decoded:
        if start > at:
            add(at, start, layer.text[at:start], True)
        add(start, end, text, False)
        at = end
    if at == 0:
        return None
    if at < len(layer.text):
        add(at, len(layer.text), layer.text[at:], True)
    return Replaced(layer, "".join(out), here, left, right, plain)


def _escapes(pattern: re.Pattern, decode, text: str) -> Iterator[tuple[int, int, str]]:
    for m in pattern.finditer(text):
        yield from decode(m)


def _percent(m: re.Match) -> Iterator[tuple[int, int, str]]:
    """Each character of a run of percent escapes with its own span; byte by byte if the run is no UTF-8.

    An escaped percent sign in front of two digits is an escape again: such a chain of any depth is one byte.
    """
    units = [(u.start(), u.end()) for u in _UNIT.finditer(m.string, m.start(), m.end())]
    raw = bytes(int(m.string[end - 2 : end], 16) for _, end in units)
    try:
        decoded = raw.decode()
    except UnicodeDecodeError:
        yield from ((start, end, chr(byte)) for (start, end), byte in zip(units, raw, strict=True))
        return
    at = 0
    for c in decoded:
        width = len(c.encode())
        yield units[at][0], units[at + width - 1][1], c
        at += width


def _percent_to_the_end(text: str) -> Iterator[tuple[int, int, str]]:
    """Percent escapes decoded until none is left, also those that decoding makes; every reduction shortens the stack, so time is linear.

    Characters beyond ASCII are left as bytes here; the layers before this one hold them decoded.
    """
    first = text.find("%")
    stack: list[tuple[str, int, int]] = []
    for i in range(first, len(text)):
        stack.append((text[i], i, i + 1))
        while len(stack) > 2 and stack[-3][0] == "%" and stack[-2][0] in _DIGITS and stack[-1][0] in _DIGITS:
            (_, start, _), (a, _, _), (b, _, end) = stack[-3:]
            stack[-3:] = [(chr(int(a + b, 16)), start, end)]
    for c, start, end in stack:
        if end - start > 1:
            yield start, end, c


def _unicode(m: re.Match) -> Iterator[tuple[int, int, str]]:
    units = b"".join(bytes.fromhex(x) for x in m.group().split("\\u")[1:])
    try:
        decoded = units.decode("utf-16-be")
    except UnicodeDecodeError:  # half a pair of surrogates: each unit alone
        for i in range(len(units) // 2):
            yield m.start() + 6 * i, m.start() + 6 * i + 6, units[2 * i : 2 * i + 2].decode("utf-16-be", "replace")[:1]
        return
    at = m.start()
    for c in decoded:
        width = 12 if ord(c) > 0xFFFF else 6
        yield at, at + width, c
        at += width


def _readable(payload: bytes) -> tuple[str, bool] | None:
    """The payload's text and whether it is UTF-8; other bytes are read as Latin-1, or not at all if no secret can be in them."""
    try:
        text = payload.decode()
        if not _ODD.search(text):
            return text, True
    except UnicodeDecodeError:
        pass
    text = payload.decode("latin-1")
    return (text, False) if _WORTH.search(text) else None


def _next_start(piece: bytes) -> tuple[int, bool]:
    """Where the next piece starts in this one, and whether that cuts an encoded run; it is never in the first half."""
    outside = ~_IN_RUN[np.frombuffer(piece, dtype=np.uint8)]
    run = len(piece) - int(outside[::-1].argmax()) if outside.any() else 0
    overlap = len(piece) - min(OVERLAP, len(piece) // 2)
    return (overlap, True) if run < len(piece) // 2 else (min(run, overlap), False)


def _inflate(payload: memoryview) -> Iterator[tuple[bytes, bool]]:
    """Inflated bytes up to the first fault, piece by piece, each with whether its end cuts an encoded run; none if not compressed."""
    if payload[:2] != b"\x1f\x8b" and not (payload[:1] == b"\x78" and len(payload) > 2 and (payload[0] << 8 | payload[1]) % 31 == 0):
        return
    machine, held, fresh = zlib.decompressobj(47), bytearray(), False  # zlib or gzip
    try:
        for at in range(0, len(payload), 256):
            feed = bytes(payload[at : at + 256])
            while feed and not machine.eof:
                part = machine.decompress(feed, PIECE - len(held))
                held += part
                fresh |= bool(part)
                feed = machine.unconsumed_tail
                if len(held) >= PIECE:
                    piece = bytes(held)
                    start, cut = _next_start(piece)
                    yield piece, cut
                    held, fresh = bytearray(piece[start:]), False
            if machine.eof:
                break
        else:
            tail = machine.flush()
            held += tail
            fresh |= bool(tail)
    except zlib.error:
        pass
    if fresh:
        yield bytes(held), False


def _payloads(text: str) -> Iterator[tuple[Sequence[int], bytes, int, int]]:
    """(places of the characters, bytes, characters per group, bytes per group) of runs that decode as base64 or hex, at every alignment.

    A run broken over lines is taken line by line and as a whole.
    """

    def places(m: re.Match) -> Sequence[int]:
        return array("q", (i for i, c in enumerate(m.group(), m.start()) if not c.isspace()))

    runs = [(range(m.start(), m.end()), m.group()) for m in _BASE64.finditer(text)]
    for at, run in runs + [(places(m), "".join(m.group().split())) for m in _BASE64_LINES.finditer(text)]:
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4):  # a word may be glued to the run's front
            part = run[skip:]
            part = part[:-1] if len(part) % 4 == 1 else part
            try:
                yield at[skip:], base64.b64decode(part + "=" * (-len(part) % 4), validate=True), 4, 3
            except binascii.Error:
                pass
    runs = [(range(m.start(), m.end()), m.group()) for m in _HEX_RUN.finditer(text)]
    for at, run in runs + [(places(m), "".join(m.group().split())) for m in _HEX_LINES.finditer(text)]:
        for skip in range(2):
            part = run[skip:]
            yield at[skip:], bytes.fromhex(part[: len(part) // 2 * 2]), 2, 1


Pieces = Iterator[tuple[Layer | None, Span | None]]


def _pieces(layer: Layer, span: tuple[int, int], inflated: Iterable[tuple[bytes, bool]]) -> Pieces:
    """A layer for each readable piece, and a span of the text where a piece cuts a run."""
    for raw, cut in inflated:
        found = _readable(raw)
        yield found and Inflated(layer, found[0], span), ("oversized", *layer.place(*span)) if cut else None


def unwrap(layer: Layer) -> tuple[list[Layer], list[Pieces]]:
    """The layers directly inside a layer, and payloads that inflate to more than one piece."""
    inner, large = [], []
    for mark, pattern, decode in (("%", _PERCENT, _percent), ("\\u", _UNICODE, _unicode)):
        if mark in layer.text and (decoded := _replaced(layer, _escapes(pattern, decode, layer.text))):
            if mark == "%" and _PERCENT.search(decoded.text):  # decoding made new escapes: all that follow at once
                inner.append(_replaced(layer, _percent_to_the_end(layer.text)))
            inner.append(decoded)
    for at, payload, chars, size in _payloads(layer.text):
        found = _readable(payload)
        if found is not None:
            inner.append(Payload(layer, found[0], at, chars, size, found[1]))
        if found is None or not found[1]:
            for start in sorted({0, *(m.start() for m in _PACKED.finditer(payload))}):
                inflated = _inflate(memoryview(payload)[start:])
                first = next(inflated, None)
                if first is None:
                    continue
                span = at[start // size * chars], at[-1] + 1
                if len(first[0]) >= PIECE:
                    large.append(_pieces(layer, span, chain([first], inflated)))
                elif (found_raw := _readable(first[0])) is not None:
                    inner.append(Inflated(layer, found_raw[0], span))
    return inner, large


def find_secrets(text: str) -> tuple[list[Span], list[Span], int]:
    """Secrets of the text itself, of the text and all layers (as spans of the text), and the number of layers entered."""
    base = scan(text)
    spans, seen, layers = set(base), {hashlib.sha256(text.encode()).digest()}, 0
    work, waiting = deque([Layer(text)]), []
    while work or waiting:
        if work:
            inner, large = unwrap(work.popleft())
            waiting += large
        else:  # the next piece only when all that the last one held is done
            found = next(waiting[-1], None)
            if found is None:
                waiting.pop()
                continue
            inner = [found[0]] if found[0] else []
            spans.update([found[1]] if found[1] else [])
        for layer in inner:
            # the same content elsewhere in the text is another place, so the place counts for payload layers
            place = layer.place(0, len(layer.text))
            digest = hashlib.sha256(f"{place}".encode() + layer.text.encode()).digest()
            if layer.text and digest not in seen:
                seen.add(digest)
                layers += 1
                spans.update((kind, *layer.place(a, b)) for kind, a, b in scan(layer.text))
                work.append(layer)
    return base, in_order(list(spans)), layers


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in _COLUMNS])
    for batch in (part for whole in batches for part in slices(whole)):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            base, spans, layers = find_secrets(text.as_py() or "")
            kinds = [kind for kind, _, _ in base]
            rows.append([doc_id, *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers])
        yield pa.RecordBatch.from_pydict(dict(zip(_COLUMNS, map(list, zip(*rows, strict=True)) if rows else [[]] * len(_COLUMNS), strict=True)), schema)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the plain secrets, all spans (also decoded ones), layers entered.

    documents: doc_id, text; other columns are ignored. Null text is empty and has no spans; repeated rows are scanned alike; no rows
    give no rows.
    """
    types = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in _COLUMNS)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan_batches, types)


def blanked(text: str) -> str:
    """The text with every secret (also a decoded one's place) replaced by a mark."""
    _, spans, _ = find_secrets(text)
    out, at = [], 0
    for _, start, end in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], BLANK]
            at = end
    return "".join([*out, text[at:]]) if spans else text


def redact(documents: DataFrame) -> DataFrame:
    """All rows and columns, with secrets in text blanked; n_chars, if present, follows the new text. Null text stays null."""
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            old = batch.column("text")
            new = [None if t is None else blanked(t) for t in old.to_pylist()]
            arrays = {c: batch.column(c) for c in columns} | {"text": pa.array(new, old.type)}
            if "n_chars" in arrays:
                same = [n if a == b else len(b) for n, a, b in zip(arrays["n_chars"].to_pylist(), old.to_pylist(), new, strict=True)]
                arrays["n_chars"] = pa.array(same, arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], names=columns)

    return documents.mapInArrow(run, documents.schema)


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
