"""Secret scan with a worklist that unwraps encoded layers and maps what it finds back to the text."""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch
from .pii import SPANS

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})++")
ESCAPE = re.compile(r"\\u\{?([0-9A-Fa-f]{4})\}?|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: ASCII as UTF-16, in either byte order, in a text that has a character for each byte.
WIDE = re.compile(r"(?:[\x01-\x7f]\0){4,}+|(?:\0[\x01-\x7f]){4,}+")
#: Base64 characters that may go on over single line breaks, with spaces around them.
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?<=[A-Za-z0-9+/_-]{16})|(?=[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]))(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
LEAST_RUN = 16
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
STANDARD = str.maketrans("-_", "+/", " \t\r\n=")
SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")  # begins a part of a zstd stream that holds no data
#: Bytes of a layer that are kept in memory; more go to an unnamed temporary file of the task.
KEPT_BYTES = 8_000_000
PIECE = 3 << 18  # divides by the width of every encoding
ZEROS = re.compile(rb"\0+")
FED = 256  # compressed bytes at a time, so that what comes out at once is small


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the plain patterns, leftmost and non-overlapping within each kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(name in low for name in NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


@dataclass
class Layer:
    """A decoded text; character k comes from code points start[k] up to end[k] of the document."""

    text: str
    start: np.ndarray
    end: np.ndarray


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of ``pattern`` decoded to (character, source width) pairs; None if there is none."""
    parts, start, end, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        if (found := decode(m)) is None:
            continue
        parts.append(layer.text[at : m.start()])
        start.append(layer.start[at : m.start()])
        end.append(layer.end[at : m.start()])
        source = m.start() + np.cumsum([0] + [width for _, width in found])
        parts.append("".join(c for c, _ in found))
        start.append(layer.start[source[:-1]])
        end.append(layer.end[source[1:] - 1])
        at = m.end()
    if not parts:
        return None
    return Layer("".join(parts) + layer.text[at:], np.concatenate([*start, layer.start[at:]]), np.concatenate([*end, layer.end[at:]]))


def percent(m: re.Match) -> list[tuple[str, int]]:
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    return [(c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in text]


def escape(m: re.Match) -> list[tuple[str, int]] | None:
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
    return [(chr(code), m.end() - m.start())] if code < 0x110000 else None


def narrow(m: re.Match) -> list[tuple[str, int]]:
    return [(c, 2) for c in m[0].replace("\0", "")]


class Spool:
    """Bytes that are written once and then read as ``bytes`` or, if they are many, as a mapped file."""

    def __init__(self):
        self.held, self.file, self.size, self.hash = bytearray(), None, 0, hashlib.sha1()

    def write(self, data: bytes) -> None:
        self.held += data
        self.size += len(data)
        self.hash.update(data)
        if len(self.held) > KEPT_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.held)
            self.held.clear()

    def read(self) -> bytes | mmap.mmap:
        if self.file is None:
            return bytes(self.held)
        self.file.write(self.held)
        self.file.flush()
        data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.file.close()
        return data


def inflate(data, start: int) -> tuple[Spool, int, bool] | None:
    """What the stream that begins at ``start`` and the members after it hold, its end, and whether its end was reached.

    A stream that is cut or damaged gives what came out before; None stands for nothing at all.
    """
    out, at, whole = Spool(), start, False
    while True:
        head = data[at : at + 8]
        if SKIPPED.match(head) and len(head) == 8:
            at += 8 + int.from_bytes(head[4:], "little")
            continue
        if not MAGIC.match(head):
            break
        whole = False
        if head[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            open_, wrong = zstandard.ZstdDecompressor().decompressobj(), zstandard.ZstdError
        elif head[:3] == b"BZh":
            open_, wrong = bz2.BZ2Decompressor(), OSError
        elif head[:1] == b"\xfd":
            open_, wrong = lzma.LZMADecompressor(), lzma.LZMAError
        else:
            open_, wrong = zlib.decompressobj(47), zlib.error
        limit = (PIECE,) if hasattr(open_, "needs_input") else ()
        fed = at
        try:
            while not open_.eof and fed < len(data):
                piece = data[fed : fed + FED]
                fed += len(piece)
                out.write(open_.decompress(piece, *limit))
                while limit and not open_.eof and not open_.needs_input:
                    out.write(open_.decompress(b"", *limit))
            whole = open_.eof
        except wrong:
            break
        at = fed - len(open_.unused_data or b"")
        if not whole:
            break
        if data[at : at + 1] == b"\0":  # padding between members
            zeros = ZEROS.match(data, at).end()
            if not MAGIC.match(data, zeros):
                break
            at = zeros
    return (out, at if whole else len(data), whole) if out.size else None


def streams(data):
    """(start, end, Spool) of each compressed stream in bytes; what a whole stream covers is passed over."""
    at = 0
    while m := MAGIC.search(data, at):
        at = m.start() + 1
        if found := inflate(data, m.start()):
            yield m.start(), found[1], found[0]
            if found[2]:
                at = found[1]


def runs(text: str):
    """Base64 runs of a text: (end with padding, positions of the characters, the characters in the standard alphabet).

    Lines that follow each other are one run, and each long enough line is a run of its own beside it.
    """
    for m in BLOB.finditer(text):
        lines = [(k.start() + m.start(), k.end() + m.start()) for k in LINE.finditer(m[0])]
        if sum(e - s for s, e in lines) < LEAST_RUN:
            continue
        yield m.end(), np.concatenate([np.arange(s, e) for s, e in lines]), m[0].translate(STANDARD)
        if len(lines) > 1:
            for s, e in lines:
                if e - s >= LEAST_RUN:
                    yield m.end() if e == lines[-1][1] else e, np.arange(s, e), text[s:e].translate(STANDARD)


def blobs(layer: Layer):
    """Layers inside base64 runs, at each of the four alignments, as what stands before a run may be glued to it.

    Bytes are taken as Latin-1, as all patterns are ASCII.  A compressed stream, wherever it begins in the bytes,
    maps as a whole to the characters from its beginning to the end of its run.
    """
    for end, spot, run in runs(layer.text):
        for shift in range(4):
            part = run[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            at = np.arange(len(data))
            first, last = spot[shift + at * 4 // 3], spot[shift - (-(at + 1) * 4 // 3) - 1]
            yield Layer(data.decode("latin-1"), layer.start[first], layer.end[last])
            for s, e, inside in streams(data):
                until = end - 1 if e == len(data) else last[e - 1]
                yield Whole(inside, int(layer.start[first[s]]), int(layer.end[until]))


@dataclass
class Whole:
    """Bytes that came out of a compressed stream, which stands from ``start`` to ``end`` of the document as a whole.

    So it is enough to know which kinds of secret are in them.  However many they are, they are read by pieces.
    """

    spool: Spool
    start: int
    end: int

    def kinds(self, data):
        if any(ASSIGNED.match(data, at) for at in self.names(data)):
            yield "assign"
        if re.search(rb"AKIA[A-Z0-9]{16}", data):
            yield "access"
        if re.search(rb"[0-9a-f]{24}", data):
            yield "hex"

    def names(self, data):
        """Where a name of a secret may begin."""
        for k in range(0, len(data), PIECE):
            piece = data[k : k + PIECE + 8].lower()
            if any(name in piece for name in NAMES):
                yield from (k + m.start() for m in NAME.finditer(piece) if m.start() < PIECE)

    def below(self, data):
        """Every layer directly below."""
        yield from (inside for _, _, inside in streams(data))
        for pattern, width, decode in BYTES:
            if found := self.replaced(data, pattern, width, decode):
                yield found
        for m in RUN.finditer(data):
            if m.end() - m.start() >= LEAST_RUN:
                yield from (self.decoded(data, m.start(), m.end(), shift) for shift in range(4))

    def replaced(self, data, pattern: re.Pattern, width: int, decode) -> Spool | None:
        out, at, some = Spool(), 0, False
        for m in pattern.finditer(data):
            some = True
            for k in range(at, m.start(), PIECE):
                out.write(data[k : min(k + PIECE, m.start())])
            for k in range(m.start(), m.end(), PIECE // width * width):
                out.write(decode(data[k : min(k + PIECE // width * width, m.end())]))
            at = m.end()
        for k in range(at, len(data) if some else 0, PIECE):
            out.write(data[k : k + PIECE])
        return out if some else None

    def decoded(self, data, start: int, end: int, shift: int) -> Spool:
        out, rest = Spool(), b""
        for k in range(start, end, PIECE):
            rest += data[k : min(k + PIECE, end)].translate(STANDARD_BYTES, b" \t\r\n=")
            if shift:
                shift, rest = max(0, shift - len(rest)), rest[shift:]
            out.write(binascii.a2b_base64(rest[: len(rest) // 4 * 4]))
            rest = rest[len(rest) // 4 * 4 :]
        if len(rest) > 1:
            out.write(binascii.a2b_base64(rest + b"=" * (-len(rest) % 4)))
        return out


def escape_bytes(data: bytes) -> bytes:
    found = escape(ESCAPE.fullmatch(data.decode()))
    return found[0][0].encode("utf-8", "surrogatepass") if found else data


NAME = re.compile(rb"password|passwd|secret|token|api_?key")
ASSIGNED = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]{6}""", re.IGNORECASE)
RUN = re.compile(BLOB.pattern.encode())
STANDARD_BYTES = bytes.maketrans(b"-_", b"+/")
BYTES = (
    (re.compile(PERCENT.pattern.encode()), 3, lambda data: bytes.fromhex(data.replace(b"%", b"").decode())),
    (re.compile(ESCAPE.pattern.encode()), 1, escape_bytes),
    (re.compile(WIDE.pattern.encode()), 2, lambda data: data.replace(b"\0", b"")),
)


def unwrapped(layer: Layer):
    """Every layer directly below."""
    if "%" in layer.text and (below := replaced(layer, PERCENT, percent)):
        yield below
    if ("\\" in layer.text or "&#" in layer.text) and (below := replaced(layer, ESCAPE, escape)):
        yield below
    if "\0" in layer.text and (below := replaced(layer, WIDE, narrow)):
        yield below
    yield from blobs(layer)


def worth_unwrapping(text: str) -> bool:
    return PERCENT.search(text) is not None or ESCAPE.search(text) is not None or next(runs(text), None) is not None


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets of all layers below the text that no base span of their kind holds already.

    The worklist ends when no layer is new: a layer whose content was seen before at the same place is not
    unwrapped again, so cycles end.
    """
    if not worth_unwrapping(text):
        return []
    spot = np.arange(len(text) + 1, dtype=np.int32)
    work, seen, out = [Layer(text, spot[:-1], spot[1:])], set(), set()

    begins = {kind: [s for k, s, _ in base if k == kind] for kind in KINDS}  # spans of a kind don't overlap
    ends = {kind: [e for k, _, e in base if k == kind] for kind in KINDS}

    def add(kind: str, s: int, e: int) -> None:
        at = bisect.bisect_right(begins[kind], s) - 1
        if at < 0 or ends[kind][at] < e:
            out.add((kind, s, e))

    while work:
        layer = work.pop()
        if isinstance(layer, Whole):
            data = layer.spool.read()
            for kind in layer.kinds(data):
                add(kind, layer.start, layer.end)
            found = (Whole(inside, layer.start, layer.end) for inside in layer.below(data) if inside.size)
        else:
            found = (below for below in unwrapped(layer) if isinstance(below, Whole) or below.text)
        for below in found:
            if isinstance(below, Whole):
                mark = below.spool.hash.digest(), below.start, below.end
            else:
                mark = hashlib.sha1(below.text.encode("utf-8", "surrogatepass")).digest(), int(below.start[0]), int(below.end[-1])
            if mark in seen:
                continue
            seen.add(mark)
            work.append(below)
            if isinstance(below, Layer):
                for kind, s, e in base_spans(below.text):
                    add(kind, int(below.start[s:e].min()), int(below.end[s:e].max()))
    return sorted(out)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) for every row of ``docs``, in code points, end exclusive.

    Spans are ordered by start, then kind as listed in KINDS, then end.  A secret inside an encoded layer has the
    span of the characters that encode it.  Null and empty texts have none; null ids and repeated rows give a row
    each; an empty table gives none.  Texts are read whole.  Other columns are ignored.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return per_batch(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}", make)
