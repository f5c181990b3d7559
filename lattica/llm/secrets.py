"""Secret scans: three base patterns, and encoded keys and tokens that are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of start; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "key", "token", "wrapped")
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.-]*+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[yw][A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*+)(?:\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?")
#: Encoded text of 16 bytes or more, the least that _holds_secret looks at; and what a line may go on with.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}+={0,2}")
_HEXES = re.compile(r"[0-9a-fA-F]{32,}+")
_NEXT = re.compile(r"\r?\n[ \t]*+([A-Za-z0-9+/_-]++={0,2})")
LEAST = 16


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at `at`, None if its length doesn't fit."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n, at = int.from_bytes(b[at : at + size], "big"), at + size
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        x = _tlv(b, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def is_der_key(b: bytes) -> bool:
    """A DER private key: PKCS#1, PKCS#8, encrypted PKCS#8 or SEC 1, with lengths that nest exactly."""
    top = _tlv(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b) or len(b) < 24:
        return False
    parts = _children(b, top[1], top[2])
    if not parts or any(t & 0x20 and _children(b, s, e) is None for t, s, e in parts):
        return False
    tags = [t for t, _, _ in parts]
    if tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1:
        version = b[parts[0][1]]
        if version == 0 and len(parts) >= 9 and set(tags[:9]) == {0x02}:
            return True  # PKCS#1: version and eight integers
        if version <= 1 and len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            inner = _children(b, parts[1][1], parts[1][2])
            return bool(inner) and inner[0][0] == 0x06  # PKCS#8: algorithm, then octets
        if version == 1 and len(parts) >= 2 and tags[1] == 0x04 and parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66):
            return len(parts) == 2 or tags[2] in (0xA0, 0xA1)  # SEC 1
    if len(parts) == 2 and tags == [0x30, 0x04]:
        inner = _children(b, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and len(inner) == 2  # encrypted PKCS#8
    return False


def is_openssh_key(b: bytes) -> bool:
    """The private key container of OpenSSH: its mark, three strings, a count and the strings that it counts."""
    mark = b"openssh-key-v1\0"
    if not b.startswith(mark):
        return False
    at = len(mark)

    def string() -> bool:
        nonlocal at
        if at + 4 > len(b):
            return False
        at += 4 + int.from_bytes(b[at : at + 4], "big")
        return at <= len(b)

    if not all(string() for _ in range(3)) or at + 4 > len(b):
        return False
    n, at = int.from_bytes(b[at : at + 4], "big"), at + 4
    return 1 <= n <= 16 and all(string() for _ in range(n + 1)) and at == len(b)


def is_signed_header(segment: str, rest: str) -> bool:
    """A token's first segment: a JSON object with an algorithm; the second is JSON as well, or the header says it is encrypted."""
    try:
        head = json.loads(_unbase64(segment) or b"")
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        if "enc" in head:
            return True
        return isinstance(json.loads(_unbase64(rest) or b""), dict)
    except (ValueError, RecursionError):
        return False


def _is_key(b: bytes) -> bool:
    return is_der_key(b) or is_openssh_key(b)


def _holds_secret(b: bytes) -> bool:
    """Decoded bytes that are a key or, as text, hold a confirmed secret or an access key, however often it is encoded.

    Each decoding is at most three quarters as long as what it decodes, so that this ends.
    """
    if _is_key(b):
        return True
    if len(b) < LEAST:
        return False
    try:
        s = b.decode("ascii")
    except UnicodeDecodeError:
        return False
    if not s.isprintable() and not all(c.isprintable() or c in "\r\n\t" for c in s):
        return False
    return bool(_ACCESS.search(s)) or any(len(m[1]) >= 12 for m in _ASSIGN.finditer(s)) or bool(confirmed(s))


def _pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PEM blocks, each looked for up to the next header only."""
    heads = list(_PEM.finditer(text))
    for m, end in zip(heads, [*(x.start() for x in heads[1:]), len(text)], strict=True):
        tail = f"-----END {m[1]}-----"
        at = text.find(tail, m.end(), end)
        if at < 0 or not _PEM_BODY.fullmatch(text, m.end(), at):
            continue
        inner = text[m.end() : at]
        raw = _unbase64(re.sub(r"\s+", "", re.sub(r"(?m)^[A-Za-z-]+:.*$", "", inner)))
        if raw and (_is_key(raw) or "ENCRYPTED" in inner and len(raw) >= 24):
            yield m.start(), at + len(tail)


def _wrapped_lines(text: str, m: re.Match) -> tuple[int, int, str]:
    """Where lines end that a run of base64 goes on in, where other lines may begin, and their characters.

    Lines are as long as the first one, but for the last, which may be shorter, and may then be the first of others.
    """
    parts, end, width, begin = [m[0]], m.end(), len(m[0]), m.end()
    while "=" not in parts[-1] and len(parts[-1]) == width:
        after = _NEXT.match(text, end)
        if after is None or len(after[1]) > width:
            break
        parts.append(after[1])
        end = after.end()
        begin = end if len(after[1]) == width else after.start(1)
    return end, begin, "".join(parts)


def _kind(raw: bytes | None) -> str | None:
    return ("key" if _is_key(raw) else "wrapped") if raw and _holds_secret(raw) else None


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans of encoded secrets whose structure was parsed; a span inside one already taken is left out."""
    out: list[tuple[str, int, int]] = []
    layers: list[list[tuple[int, int]]] = []  # each in order and without overlaps

    def add(kind: str, start: int, end: int) -> None:
        for layer in layers:
            i = bisect.bisect_right(layer, (start, 1 << 62)) - 1
            if i >= 0 and end <= layer[i][1]:
                return
        out.append((kind, start, end))

    def close() -> None:
        layers.append([(s, e) for _, s, e in out[sum(map(len, layers)) :]])

    if "PRIVATE KEY-----" in text:
        for start, end in _pem_keys(text):
            add("key", start, end)
    close()
    if "." in text:
        for m in _TOKEN.finditer(text):
            if is_signed_header(m[1], m[2]):
                add("token", *m.span())
    close()
    taken = begin = 0  # the end of lines that were reported, and where lines may begin
    for run in _BASE64.finditer(text):  # runs of hex digits are runs of base64 as well
        if run.end() <= taken:
            continue
        if run.start() >= begin:
            end, begin, lines = _wrapped_lines(text, run)
            if end > run.end() and (found := _kind(_unbase64(lines))):
                add(found, run.start(), end)
                taken = begin = end
                continue
        whole = False
        for m in _HEXES.finditer(text, *run.span()):
            if found := _kind(bytes.fromhex(m[0][: len(m[0]) & ~1])):
                add(found, *m.span())
                whole = whole or m.span() == run.span()
        if not whole and (found := _kind(_unbase64(run[0]))):
            add(found, *run.span())
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one whole text, in code points, by start and kind."""
    if not text:
        return []
    return sorted(base_spans(text) + confirmed(text), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end), for each row of docs (doc_id, text).

    Encodings are opened however deep they are nested; texts are looked at whole, in time that grows with their length. A null
    or empty text has none; repeated rows and null ids each keep their row; an empty table gives no rows; other columns,
    whatever their names, are not read.
    """
    rows = docs.select("doc_id", "text")
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans)], ["doc_id", "secrets"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, secrets {_SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced by MASK, all columns kept; n_chars, where there is one, follows the new text.

    Overlapping spans become one mask. Null and empty texts stay as they are, as do repeated rows, null ids and columns of any
    other name; an empty table stays empty.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def masked(text: str | None) -> str | None:
        spans = secret_spans(text)
        if not spans:
            return text
        out, end = [], 0
        for _, s, e in spans:
            if s >= end:
                out += [text[end:s], MASK]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [masked(t) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            if chars is not None:
                cols[chars] = pa.array([c if a == n else len(n) for c, a, n in zip(b.column(chars).to_pylist(), old, new, strict=True)], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
