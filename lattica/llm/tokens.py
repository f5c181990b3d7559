"""Token-id shards with a minimal perfect hash index.

A store is a folder with two Parquet tables. `shards` has a row for each shard: its partition and number, the first start
within the partition, raw ids as little-endian unsigned integers of `width` bytes, the document keys in ascending order and
an index over them. `parts` has the ids before each partition. Spark's writers commit both, so a lost executor or a task
that runs twice leaves no partial file, and any store that Spark writes to will do.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import mix64, shared_dir

SHARD_IDS = 1 << 20
END_ID = 2
#: Bytes of pieces that a worker remembers, characters that it encodes at a time, and of the longest piece that it remembers.
MEMORY, SLICE, LONG_WORD = 96 << 20, 1 << 21, 128

# ---------------------------------------------------------------------------------------------------- the hash index


class MinimalPerfectHash:
    """Levels of bit sets: a key that is alone at its place of a level gets that place, the others go to the next level.

    A key's slot is the rank of its bit over all levels, so that n keys have the slots 0 to n - 1. Lookups touch less than
    two levels on average. Slots hold a 32-bit fingerprint, which tells keys that were never stored with odds of 2**-32.
    """

    GAMMA = 2

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, prints: np.ndarray):
        self.sizes, self.bits, self.prints = sizes, bits, prints
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix64(~keys) >> np.uint64(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        keys = keys.astype(np.uint64)
        rest, sizes, bits, level = keys, [], [], 0
        while len(rest):
            size = max(64, cls.GAMMA * len(rest))
            at = cls._at(rest, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("keys must differ")
        out = cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), np.zeros(len(keys), np.uint32))
        out.prints[out.slots(keys, check=False)] = cls._print(keys)
        return out

    def slots(self, keys: np.ndarray, check: bool = True) -> np.ndarray:
        """The slot of each key, -1 for a key that is not stored."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = self.starts[level] + self._at(keys[todo], level, int(size))
            hit = self.bits[at]
            out[todo[hit]] = self.rank[at[hit]]
            todo = todo[~hit]
        if check and len(self.prints):
            found = out >= 0
            out[found & (self.prints[np.maximum(out, 0)] != self._print(keys))] = -1
        return out

    def pack(self) -> bytes:
        return np.int64(len(self.sizes)).tobytes() + np.int64(len(self.prints)).tobytes() + self.sizes.tobytes() + self.prints.tobytes() + np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> MinimalPerfectHash:
        levels, n = np.frombuffer(raw, np.int64, 2)
        sizes = np.frombuffer(raw, np.int64, levels, 16)
        prints = np.frombuffer(raw, np.uint32, n, 16 + 8 * levels)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 + 8 * levels + 4 * n))[: sizes.sum()].astype(bool)
        return cls(sizes, bits, prints)


def key_of(doc_ids: np.ndarray, nulls: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Keys of documents: the id, whether it is null, and how many equal ids come before it in the shard."""
    second = ((turn.astype(np.uint64) << np.uint64(1)) | nulls.astype(np.uint64)) + np.uint64(0x51_7C_C1_B7_27_22_0A_95)
    return mix64(doc_ids.astype(np.int64).view(np.uint64)) + mix64(second)


def turns(doc_ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How many equal ids come before each of the ascending ids."""
    n = len(doc_ids)
    new = np.ones(n, bool)
    new[1:] = (doc_ids[1:] != doc_ids[:-1]) | (nulls[1:] != nulls[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.arange(n) - first


# ---------------------------------------------------------------------------------------------------- the encoder


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memory:
    """What a worker remembers, in two generations: a hit in the old one moves to the young one, and when the young one holds
    half of `most` bytes the old one goes. Bytes are counted as Python's own objects take them, table slots included."""

    ENTRY = 33 + 49 + 100 + 2 * 8  # a bytes and a str header, a slot at the usual load, rounding

    def __init__(self, most: int):
        self.most, self.young, self.old, self.held = most, {}, {}, 0

    def recall(self, keys: set) -> set:
        """Those of keys that are not known; the others are in the young generation now."""
        missing = keys.difference(self.young)
        again = missing.intersection(self.old)
        if again:
            self.put({k: self.old[k] for k in again})
            missing -= again
        return missing

    def put(self, items: dict) -> None:
        self.young.update(items)
        self.held += len(items) * self.ENTRY + sum(map(len, items)) + sum(map(len, items.values()))

    def turn(self) -> None:
        """Between slices, when nothing looks up keys that it has recalled."""
        if self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0


class WordEncoder:
    """Ids of whole texts by the tokenizers library, one library call for the pieces that a slice brings anew.

    The tokenizer at hand drops white space, so ids of a text are those of its words in order. A word of plain characters is
    the sequence of its pre-tokens, and the last id of each pre-token, and no other, ends with the word-end mark: unknown
    pre-tokens are encoded as one text and cut there. Any other word is a piece of its own that goes to the library whole.
    Long pieces are not remembered. The strings of special tokens are their ids, as the plain library call has it.

    Texts are encoded in slices of about SLICE bytes that end before white space, so that a batch's pieces are never in memory
    at once; what is remembered is bounded by its bytes.
    """

    #: Plain: Latin letters, digits and marks that neither normal forms nor lower case turn into others.
    MARKS = "¡§«°·»¿–—‘’“”•…€"
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    PLAIN = re.compile(f"[\t-\r -~À-ÖØ-öø-ÿ{MARKS}]*+")
    SPACE = re.compile("[ \t-\r]")
    ODD = "\0"  # before a word that is a piece; no pre-token of plain text has it

    def __init__(self, path: str, dtype: str, memory: int = MEMORY, slice_bytes: int = SLICE):
        self.t, self.dtype, self.slice = _tokenizer(path), dtype, slice_bytes
        self.size = np.dtype(dtype).itemsize
        self.known = Memory(memory)
        self.ends = np.zeros(self.t.get_vocab_size(), bool)
        for token, i in self.t.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.special = {x.content: np.array([i], dtype).tobytes() for i, x in self.t.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, cut from those of texts that have them as words."""
        out = {}
        coded = self.t.encode_batch_fast([" ".join(new[i : i + 2000]) for i in range(0, len(new), 2000)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in coded])
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):
            raise ValueError("the tokenizer does not end each pre-token with its mark")
        raw, at = ids.tobytes(), 0
        for word, cut in zip(new, (cuts * self.size).tolist(), strict=True):
            out[word] = raw[at:cut]
            at = cut
        return out

    def _pieces(self, text: str) -> list[str]:
        if self.PLAIN.fullmatch(text):
            return self.PIECES.findall(text.lower())
        out = []
        for w in self.SPACE.split(text):
            out += self.PIECES.findall(w.lower()) if self.PLAIN.fullmatch(w) else [self.ODD + w]
        return out

    def _slice(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(x) for x in texts]
        missing = self.known.recall(set(itertools.chain.from_iterable(split)))
        found: dict[str, bytes] = {}
        if plain := [x for x in missing if x[0] != self.ODD]:
            found = self._learn(plain)
        if odd := [x for x in missing if x[0] == self.ODD]:
            for x, e in zip(odd, self.t.encode_batch_fast([x[1:] for x in odd], add_special_tokens=False), strict=True):
                found[x] = np.array(e.ids, self.dtype).tobytes()
        long = {x: found.pop(x) for x in [x for x in found if len(x) > LONG_WORD]}
        self.known.put(found)
        get = (self.known.young | long if long else self.known.young).__getitem__
        out = [b"".join(map(get, x)) for x in split]
        self.known.turn()
        return out

    def _plain(self, text: str) -> bytes:
        """Ids of one text without special tokens, of any length."""
        out, at = [], 0
        while at < len(text):
            m = self.SPACE.search(text, at + self.slice)
            end = m.start() if m else len(text)
            out += self._slice([text[at:end]])
            at = end
        return b"".join(out)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            special = self.cut is not None and self.cut.search(text) is not None
            if held and (special or size + len(text) > self.slice):
                yield from self._slice(held)
                held, size = [], 0
            if special:
                yield b"".join(self.special.get(x) or self._plain(x) for x in self.cut.split(text))
            elif len(text) > self.slice:
                yield self._plain(text)
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._slice(held)


@functools.lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


# ---------------------------------------------------------------------------------------------------- the store

_SHARD = "part long, seq long, rel_start long, n_ids long, n_docs long, min_doc long, max_doc long, width int, payload binary, keys binary, nulls binary, lookup binary, places binary"


def _shard(part: int, seq: int, rel: int, ids: list, coded: list[bytes], width: int) -> dict:
    nulls = np.array([x is None for x in ids], bool)
    docs = np.array([x or 0 for x in ids], np.int64)
    lengths = np.array([len(x) // width for x in coded], np.int64)
    keys = key_of(docs, nulls, turns(docs, nulls))
    index = MinimalPerfectHash.build(keys)
    places = np.empty((len(ids), 2), np.uint32)
    places[index.slots(keys)] = np.column_stack([np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths])
    real = docs[~nulls]
    return {
        "part": part, "seq": seq, "rel_start": rel, "n_ids": int(lengths.sum()), "n_docs": len(ids), "min_doc": int(real.min()) if len(real) else None,
        "max_doc": int(real.max()) if len(real) else None, "width": width, "payload": b"".join(coded), "keys": docs.tobytes(), "nulls": np.packbits(nulls).tobytes(), "lookup": index.pack(), "places": places.tobytes(),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text of docs (doc_id, text) and write a store at path, in ascending doc_id order.

    Null ids come first; rows of one id are ordered by a hash of their text and then by their text. A null text is empty and
    has the end id only; texts of any length are encoded whole. Repeated rows are documents of their own. An empty table makes
    an empty store. Other columns are not read.
    """
    spark = docs.sparkSession
    # Whole texts are dealt in ranges, encoded where they land and packed there. Ties break by a hash and then by where a row
    # was read, so that an id with many rows, equal ones too, is split.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("p"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("text"), F.col("p")]
    rows = rows.repartitionByRange(order[0], order[1], order[3]).sortWithinPartitions(*order).select("doc_id", "text")
    size = _tokenizer(tokenizer_path).get_vocab_size()
    dtype = "<u2" if max(size, end_id or 0) < 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(tokenizer_path, dtype), b"" if end_id is None else np.array([end_id], dtype).tobytes()
        part, seq, rel = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        coded: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(part, seq, rel, ids, coded, width)], schema=_arrow())

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(x.as_py() for x in b.column(1)), strict=True):
                ids.append(doc)
                coded.append(raw + end)
                held += len(coded[-1]) // width
                if held >= shard_ids:
                    yield full()
                    seq, rel = seq + 1, rel + held
                    ids, coded, held = [], [], 0
        if ids:
            yield full()

    rows.mapInArrow(run, _SHARD).write.mode("overwrite").parquet(f"{path}/shards")
    shards = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    # One row for each task of the write, whatever the number of shards or documents.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")).write.mode("overwrite").parquet(f"{path}/parts")


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in _SHARD.split(", "))])


def _shards(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema("part long, base long").parquet(f"{path}/parts")
    # parts has a row for each task of the write: some 10**5 at most, two longs each.
    return spark.read.schema(_SHARD).parquet(f"{path}/shards").join(F.broadcast(parts), "part")


def _open(row: dict) -> tuple[MinimalPerfectHash, np.ndarray, np.ndarray]:
    return MinimalPerfectHash.unpack(row["lookup"]), np.frombuffer(row["places"], np.uint32).reshape(-1, 2), np.frombuffer(row["payload"], f"<u{row['width']}")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    Each document is found through the index of its shard by its key, as lookup() finds it. Null ids and documents that share
    an id have keys of their own; an empty store gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                index, places, payload = _open(row)
                docs = np.frombuffer(row["keys"], np.int64)
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[: len(docs)].astype(bool)
                slot = index.slots(key_of(docs, nulls, turns(docs, nulls)))
                if (slot < 0).any():
                    raise ValueError(f"shard {row['part']}/{row['seq']} has a key that its index does not know")
                at = places[slot].astype(np.int64)
                raw = [payload[a : a + n].astype("<u4").tobytes() for a, n in at]
                cols = [pa.array(docs, mask=nulls), pa.array(at[:, 0] + row["base"] + row["rel_start"]), pa.array(at[:, 1]), pa.array([zlib.crc32(x) for x in raw], pa.int64()), *([pa.array(raw, pa.binary())] if ids else [])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    return _shards(spark, path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def lookup(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """Documents with the given ids: doc_id, start and ids. Shards whose range holds none of them are not read; an unknown id has no row.

    A key costs its shard: the index, whose levels are touched less than twice, and one payload of SHARD_IDS ids at most but
    for its last document, whatever the size of the store.
    """
    wanted = np.unique(np.array(list(doc_ids), np.int64))
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    near = _shards(spark, path).where((F.col("max_doc") >= int(wanted[0])) & (F.col("min_doc") <= int(wanted[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                index, places, payload = _open(row)
                todo = wanted[np.searchsorted(wanted, row["min_doc"]) : np.searchsorted(wanted, row["max_doc"], "right")]
                turn, found = 0, []
                while len(todo):
                    slot = index.slots(key_of(todo, np.zeros(len(todo), bool), np.full(len(todo), turn)))
                    todo, slot = todo[slot >= 0], slot[slot >= 0]
                    found += [(int(d), int(places[s, 0]), int(places[s, 1])) for d, s in zip(todo, slot, strict=True)]
                    turn += 1
                if found:
                    base = row["base"] + row["rel_start"]
                    yield pa.RecordBatch.from_pylist([{"doc_id": d, "start": base + a, "ids": payload[a : a + n].astype("<u4").tobytes()} for d, a, n in found], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]))

    return near.mapInArrow(run, "doc_id long, start long, ids binary")


def token_store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs (doc_id, text) to a store in the shared folder and read every document back: see write_tokens and read_tokens
    for null and repeated ids, null, empty and long texts, and empty tables. Other columns, whatever their names, are not read."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lattica-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path)
    from ._shared import _written

    _written.append((spark, path))
    return read_tokens(spark, path, ids=False)
