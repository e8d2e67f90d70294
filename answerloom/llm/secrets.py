"""Secrets in texts and in what texts encode (operator 7).

Every text is scanned, then a worklist unwraps what it encodes: percent
escapes, Unicode escapes, base64 and compressed bytes, layer in layer, until
nothing new comes. A layer seen before in the same text is not opened again.
Each character of a layer knows the span of the text it came from, so a find
in any layer is reported where its carrier stands.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import fresh

KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the three kinds, and the least lengths.
_NAMES = "|".join((*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 6, 20

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over line breaks, as mail and key files wrap it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_][A-Za-z0-9+/_-]*)+={0,2}")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_PACKED_TEXT = re.compile("(?:\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00|x[\x01\x9c\xda])[\x00-\xff]*")
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_LOWERED = ("passw", "secret", "token", "api")

#: Unpacked bytes that are held at a time; a larger layer is scanned in pieces that overlap.
LAYER_BYTES, OVERLAP = 1 << 24, 1 << 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the finds in the text itself."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in _LOWERED):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _ACCESS_LEAST]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _opened(data: memoryview):
    head = bytes(data[:6])
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=1 << 27) if head == b"\xfd7zXZ\x00" else None


def _unpacked(data: memoryview) -> Iterator[bytes]:
    """The content of all members of gzip, zlib, bzip2 or xz bytes, in pieces; of damaged ones what comes before the damage."""
    held, new = b"", False
    while len(data) and (opened := _opened(data)) is not None:
        try:
            while not opened.eof:
                out = opened.decompress(data, LAYER_BYTES)
                data = getattr(opened, "unconsumed_tail", b"")
                held, new = held + out, new or bool(out)
                if len(held) > LAYER_BYTES:
                    yield held
                    held, new = held[-OVERLAP:], False
                if not out and not opened.eof and not data:
                    break
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            break
        data = memoryview(opened.unused_data)
    if new:
        yield held


def _of_bytes(data: bytes) -> Iterator[str]:
    """Bytes as text, with marks for what is no UTF-8, and the content of all that is packed in them."""
    seen, waiting = set(), [iter([data])]
    while waiting:
        if (data := next(waiting[-1], None)) is None:
            waiting.pop()
            continue
        if (digest := hashlib.sha256(data).digest()) in seen:
            continue
        seen.add(digest)
        yield data.decode(errors="replace")
        view = memoryview(data)
        starts = {m.start() for m in _PACKED.finditer(data)} | {0}
        waiting += [_unpacked(view[at:]) for at in sorted(starts)]


def _of_base64(run: str) -> Iterator[str]:
    """What the run encodes, from each of its first four characters on, as its true beginning may be glued to others."""
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    for skipped in range(4):
        part = body[skipped:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        try:
            yield from _of_bytes(base64.b64decode(part + "=" * (-len(part) % 4), validate=True))
        except (binascii.Error, ValueError):
            continue


#: A layer: its text, and for each character where it starts and ends in the document; None: as the document itself.
_Places = list[tuple[int, int]] | None


def _carrier(places: _Places, start: int, end: int) -> tuple[int, int]:
    return (start, end) if places is None else (places[start][0], places[end - 1][1])


def _replaced(text: str, places: _Places, runs: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, list[tuple[int, int]]]:
    """The text with each run replaced by its decoded characters, which know their own places."""
    out, at, done = [], [], 0
    for start, end, decoded in [*runs, (len(text), len(text), [])]:
        out.append(text[done:start])
        at += [(i, i + 1) for i in range(done, start)] if places is None else places[done:start]
        for c, a, b in decoded:
            out.append(c)
            at.append(_carrier(places, a, b))
        done = end
    return "".join(out), at


def _percent_run(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes with their spans; bytes that are no UTF-8 stay escapes."""
    data, i, out = bytes.fromhex(m[0].replace("%", "")), 0, []
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append((data[i : i + n].decode(), m.start() + 3 * i, m.start() + 3 * (i + n)))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out += [(c, m.start() + 3 * i + k, m.start() + 3 * i + k + 1) for k, c in enumerate(m[0][3 * i : 3 * i + 3])]
            i += 1
    return out


def _escape_run(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for e in _ESCAPE.finditer(m[0]):
        point = int(e[1], 16)
        span = (m.start() + e.start(), m.start() + e.end())
        if out and 0xDC00 <= point <= 0xDFFF and _SURROGATES.fullmatch(out[-1][0] + chr(point)):
            high, a, _ = out.pop()
            out.append((chr(0x10000 + (ord(high) - 0xD800 << 10) + point - 0xDC00), a, span[1]))
        elif point <= 0x10FFFF:
            out.append((chr(point), *span))
        else:
            out += [(c, span[0] + k, span[0] + k + 1) for k, c in enumerate(e[0])]
    return out


def layers(text: str) -> Iterator[tuple[str, _Places]]:
    """All layers under the text, each once."""
    seen, waiting = {text}, [(text, None)]

    def new(layer: str | None, places) -> Iterator[tuple[str, _Places]]:
        if layer and layer not in seen:
            seen.add(layer)
            waiting.append((layer, places))
            yield layer, places

    while waiting:
        layer, places = waiting.pop()
        for mark, pattern, decoded in (("%", _PERCENT, _percent_run), ("\\", _ESCAPES, _escape_run)):
            if mark in layer and (runs := [(*m.span(), decoded(m)) for m in pattern.finditer(layer)]):
                yield from new(*_replaced(layer, places, runs))
        for m in _PERCENT.finditer(layer) if "%" in layer else ():
            for inner in _of_bytes(bytes.fromhex(m[0].replace("%", ""))):
                yield from new(inner, [_carrier(places, *m.span())] * len(inner))
        for m in _PACKED_TEXT.finditer(layer):
            for inner in _of_bytes(m[0].encode("latin-1")):
                yield from new(inner, [_carrier(places, *m.span())] * len(inner))
        for pattern in (_BASE64, _WRAPPED):
            for m in pattern.finditer(layer):
                for inner in _of_base64(m[0]):
                    yield from new(inner, [_carrier(places, *m.span())] * len(inner))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base finds, and these with the finds of all layers; each by start, then kind as listed."""
    base = base_spans(text)
    found = set(base)
    for layer, places in layers(text):
        for kind, start, end in base_spans(layer):
            found.add((kind, *_carrier(places, start, end)))

    def order(span):
        return span[1], KINDS.index(span[0]), span[2]

    return sorted(base, key=order), sorted(found, key=order)


_SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def _scan(texts: pa.Array) -> pa.Array:
    rows = [all_spans(t.as_py() or "") for t in texts]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    made = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row[i]] for row in rows], kind) for i in (0, 1)]
    return pa.StructArray.from_arrays(made, ["base", "spans"])


def scanned(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """All columns of ``docs`` with the struct column ``secrets`` (base, spans).

    ``base`` are the finds in the whole text, ``spans`` these and the finds of its layers, in code points with
    the end exclusive. A null text counts as empty and has none; a find that
    several layers give at the same place counts once. If ``docs`` has a
    column ``secrets``, the new one gets a longer name, and is the last.
    """
    scan = F.arrow_udf(_scan, f"struct<base: {_SPAN}, spans: {_SPAN}>")
    return docs.withColumn(fresh(docs, "secrets"), scan(text if isinstance(text, Column) else F.col(text)))
