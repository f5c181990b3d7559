"""Byte-level BPE: tiktoken over a local rank file, with long texts split first at places where no match can span."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters above which a text is encoded piece by piece.
PIECE = 200_000
#: A match of the pattern holds white space only before its other characters, so none spans from a character that is not
#: white space to a space or line break after it.
_SAFE = re.compile(r"(?<=[^\s])(?=[ \n])")
#: White space above which a run of it does not go through the library's expression, whose stack grows with the run.
RUN = 10_000
#: What the expression's \\s stands for: Unicode's White_Space, which is not quite Python's.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The encoding of a rank file; one for each worker process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in order, cut only at safe boundaries, each piece as short as these allow beyond size."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _parts(text: str, run: int) -> Iterator[tuple[str, bool]]:
    """text in order, and whether a part is one match of the pattern: a long run of white space.

    Such a run is one match but for its last character if anything follows it, which may open the next match. Nothing else
    matches white space but one blank before other characters, so no match spans an edge of the parts.
    """
    at = 0
    for m in re.finditer(f"[{_SPACE}]{{{run},}}+", text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def encode_text(enc, text: str, size: int = PIECE, run: int = RUN) -> np.ndarray:
    """Ids of a whole text, of any length and with runs of any length, as the library would have them in one call."""
    if len(text) <= min(size, run):
        return np.array(enc.encode_ordinary(text), "<u4")
    out = []
    for part, single in _parts(text, run):
        if single:
            out.append(np.array(enc._encode_single_piece(part.encode()), "<u4"))
        else:
            out += [np.array(enc.encode_ordinary(p), "<u4") for p in pieces(part, size)]
    return np.concatenate(out)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of docs but the text, with ids (little-endian unsigned 32-bit) and n_tokens.

    A null text counts as empty and has no ids. Columns of docs that are called ids or n_tokens are replaced, others are kept
    as they are. Repeated rows and null ids each keep their row; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            ids = [encode_text(enc, t.as_py() or "") for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], [*keep, "ids", "n_tokens"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, ", ".join(x for x in (schema, "ids binary, n_tokens long") if x))


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded with decoded: the raw bytes of ids, which are cut anywhere need not be valid UTF-8. Null ids decode to null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            out = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the bytes decoded from them, by one pass of Python; with the ids if asked for.

    A null or empty text has no ids and the digest of nothing. Texts are encoded whole, whatever their length. Repeated rows
    and null ids each keep their row, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            coded = [encode_text(enc, t.as_py() or "") for t in b.column(1)]
            raw = [x.tobytes() for x in coded]
            out = [
                b.column(0), pa.array([len(x) for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                pa.array([hashlib.sha256(enc.decode_bytes(x.tolist())).hexdigest() for x in coded]), *([pa.array(raw, pa.binary())] if ids else []),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else ""))
