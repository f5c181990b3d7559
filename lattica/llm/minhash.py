"""Near duplicates by Order MinHash, with candidates verified by banded alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import components, forget, mix64, written

K, SKETCHES, SIMILARITY_PERCENT = 5, 24, 80
#: Members above which a bucket is large.
SMALL = 48
#: Rows of a batch of texts that a worker is sent.
BATCH = 500
#: Counts of words by hash that bound a similarity, and members of a bucket's block, of which two meet in a task.
COUNTS, BLOCK = 128, 512
#: Values that the sketch of one text holds at a time; places that a word has bits for, and places of a rare word.
HELD, WHOLE, RARE = 1 << 17, 4096, 32
#: Large buckets elect further roots while at least this share of the pairs that meet one is linked.
WORTH = 0.02
_DROP = b".,;:!?\"'()[]{}"


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case and without punctuation; null counts as empty."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROP).split()


# ---------------------------------------------------------------------------------------------------- sketches

_MULTIPLIERS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def kmers(words: list[bytes], k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, the second and further occurrences of one apart from the first.

    A text of fewer than k words is one k-mer.
    """
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for i in range(min(k, len(h))):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        g = mix64(g)
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        if same.any():
            start = np.concatenate([[0], np.where(same, 0, np.arange(1, n))])
            turn = np.empty(n, np.int64)
            turn[order] = np.arange(n) - np.maximum.accumulate(start)
            g = np.where(turn > 0, mix64(g + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), g)
    return g


def sketch_of(g: np.ndarray, m: int = SKETCHES) -> np.ndarray:
    """m values: each hashes the two least k-mers under one order of all k-mers, in their order in the text.

    Occurrences count apart, so that the sketch sees a multiset, and keeping the order of the two makes it follow the edit
    similarity rather than the Jaccard similarity. As many orders are looked at at a time as HELD values allow.
    """
    out = np.empty(m, np.uint64)
    step = max(1, HELD // len(g))
    with np.errstate(over="ignore"):
        for at in range(0, m, step):
            own = _MULTIPLIERS[at : min(at + step, m)]
            v = g[None, :] * own[:, None]
            a = v.argmin(axis=1)
            if len(g) == 1:
                pair = g[a]
            else:
                v[np.arange(len(own)), a] = np.uint64(0xFFFFFFFFFFFFFFFF)
                b = v.argmin(axis=1)
                pair = g[np.minimum(a, b)] * np.uint64(3) + mix64(g[np.maximum(a, b)])
            out[at : at + step] = mix64(pair ^ own)
    return out.view(np.int64)


def order_sketches(words: list[bytes]) -> np.ndarray:
    return sketch_of(kmers(words))


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), a 128-bit key of the words (k1, k2), their number n and the sketch for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, n, sketch = [], [], [], []
            for cell in b.column(1):
                text = cell.as_py() or ""
                w = words_of(text)
                d = xxhash.xxh3_128_digest(b" ".join(w) if w else b"\0" + text.encode("utf-8", "surrogatepass"))
                k1.append(int.from_bytes(d[:8], "big", signed=True))
                k2.append(int.from_bytes(d[8:], "big", signed=True))
                n.append(len(w))
                sketch.append(order_sketches(w) if w else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(k1), pa.array(k2), pa.array(n, pa.int32()), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "h", "k1", "k2", "n", "sketch"])

    return rows.mapInArrow(run, "doc_id long, h long, k1 long, k2 long, n int, sketch array<long>")


# ---------------------------------------------------------------------------------------------------- alignment


class Places:
    """Where the words of a text are, as bits: memory in proportion to the text, whatever words it has.

    Up to WHOLE words, each distinct one has an integer with a bit for each place. Longer texts keep the places of rare words,
    and of frequent ones the bits by blocks of WHOLE places, of which only those in the asked window are put together.
    """

    def __init__(self, words: list, whole: int):
        self.n, self.whole = len(words), whole
        self.bits: dict = {}
        self.rare: dict = {}
        self.blocks: dict = {}
        if self.n <= whole:
            for i, x in enumerate(words):
                self.bits[x] = self.bits.get(x, 0) | (1 << i)
            return
        for i, x in enumerate(words):
            self.rare.setdefault(x, []).append(i)
        for x in [x for x, at in self.rare.items() if len(at) > RARE]:
            at = np.array(self.rare.pop(x))
            blocks = {}
            for c in np.unique(at // whole).tolist():
                own = np.zeros(whole, np.uint8)
                own[at[at // whole == c] - c * whole] = 1
                blocks[c] = np.packbits(own, bitorder="little").tobytes()
            self.blocks[x] = blocks
        self.none = bytes(whole // 8)

    def window(self, word, low: int, width: int) -> int:
        """Bit i tells whether the word is at place low + i, for i below width; low may be negative."""
        if self.n <= self.whole:
            p = self.bits.get(word, 0)
            return (p >> low if low >= 0 else p << -low) & ((1 << width) - 1) if p else 0
        if word in self.rare:
            return sum(1 << (i - low) for i in self.rare[word] if low <= i < low + width)
        blocks = self.blocks.get(word)
        if not blocks or low + width <= 0 or low >= self.n:
            return 0
        first = max(low, 0) // self.whole
        p = int.from_bytes(b"".join(blocks.get(c, self.none) for c in range(first, min(self.n, low + width) // self.whole + 1)), "little")
        shift = first * self.whole - low
        return (p << shift if shift >= 0 else p >> -shift) & ((1 << width) - 1)


def aligned_words(a: list, b: list, most: int, whole: int = WHOLE) -> int:
    """The words that the best alignment of a and b leaves in place, -1 if more than `most` are to be inserted or deleted.

    The matrix is computed in a band of `most` diagonals on either side of the main one, a whole column of the band at a time
    as the bits of one long integer: a cleared bit is a word of a that is matched. The band moves down a row with each column;
    the bit that leaves it is final.
    """
    if abs(len(a) - len(b)) > most:
        return -1
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    ea, eb = len(a), len(b)
    while ea > start and eb > start and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    same = start + len(a) - ea
    a, b = a[start:ea], b[start:eb]
    n, m = len(a), len(b)
    need = n + m - most  # twice the words that must be matched
    if n > whole and 2 * (Counter(a) & Counter(b)).total() < need:
        return -1  # whatever their order
    places = Places(a, whole)
    width = 2 * most + 1
    top = 1 << (2 * most)
    full = 2 * top - 1
    band, matched, low = full, 0, -most
    for j, y in enumerate(b):
        p = places.window(y, low, width)
        if p:
            u = band & p
            if u:
                band = ((band + u) | (band - u)) & full
        if not band & 1:
            matched += 1
        band = band >> 1 | top
        low += 1
        if not j & 63 and 2 * (matched + width - band.bit_count() + m - j) < need:
            return -1
    matched += width - band.bit_count()
    return same + matched if 2 * matched >= need else -1


def similar(a: list, b: list, percent: int = SIMILARITY_PERCENT) -> bool:
    """Whether the aligned words are at least percent / 100 of all words of the two texts, aligned ones counted once."""
    total = len(a) + len(b)
    return total == 0 or aligned_words(a, b, total * (100 - percent) // (100 + percent)) >= 0


class Corpus:
    """The representatives (node, rep, h, k1, k2, n, sketch) and the texts that stand for them."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        """rows: see sketch_rows. A node is a number that only one representative has; ids may have several texts."""
        least = F.min(F.struct("doc_id", "h")).alias("least")
        reps = rows.where("doc_id is not null").groupBy("k1", "k2").agg(least, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.reps = written(reps.select(F.monotonically_increasing_id().alias("node"), F.col("least.doc_id").alias("rep"), F.col("least.h").alias("h"), "k1", "k2", "n", "sketch"), "reps")
        self.keys = self.reps.select("node", "rep", "h")
        text = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__h"), F.col("text").alias("__t"))
        twice = rows.groupBy("doc_id", "h").agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null")
        # Where an id and text are in several rows, one of them stands for all.
        self.text = text if twice.isEmpty() else text.groupBy("__id", "__h").agg(F.first("__t").alias("__t"))

    def _with(self, df: DataFrame, node: str, to: str) -> DataFrame:
        keyed = df.join(self.keys, F.col(node) == F.col("node")).drop("node")
        return keyed.join(self.text, (F.col("rep") == F.col("__id")) & (F.col("h") == F.col("__h"))).drop("rep", "h", "__id", "__h").withColumnRenamed("__t", to)

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) for each of nodes (node), which are distinct."""
        return self._with(nodes.select(F.col("node").alias("__n")), "__n", "text").withColumnRenamed("__n", "node")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) of nodes whose whole texts are similar; texts travel only for nodes that are in a pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: tuple[str | None, list] = (None, [])
            for b in batches:
                ok = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    y = y.as_py()
                    if y != known[0]:
                        known = (y, words_of(y))
                    ok.append(similar(words_of(x.as_py()), known[1]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return self._with(self._with(pairs.select("a", "b"), "a", "ta"), "b", "tb").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------------------------------------------- classes


def _close(x: str, y: str) -> str:
    """Lengths alone allow the similarity."""
    return f"least({x}, {y}) * 100 >= greatest({x}, {y}) * {SIMILARITY_PERCENT}"


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and kept for each row of docs (doc_id, text): the class is the least id of its group, kept that one.

    Documents with the same words, case and punctuation aside, are one representative. Two representatives are linked if they
    share one of SKETCHES Order MinHash values and their aligned words are at least SIMILARITY_PERCENT of all their words.
    Every pair whose five-word shingles have a Jaccard similarity of 0.8 in text order is above that, and shares a value but
    for odds of 0.36 ** 24. Classes are the components of the links.

    Each bucket is compared with its shortest member. Members of a bucket of at most SMALL that are still in different
    components meet in pairs. Larger buckets elect further roots while that links many; then all their members that are in
    different components meet in blocks: counts of their words bound the similarity from above, and pairs that the bound
    leaves open are aligned.

    Texts without words equal only the same text. Null and empty texts are the same. Null ids have no class and are kept.
    Repeated rows are copies, of which those with the least id stay: kept is by id. Other columns are not read.
    """
    rows, classes, _ = _classes(docs)
    mine = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    out = rows.join(classes, ["k1", "k2"], "left")
    return out.select("doc_id", mine.alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The rows of docs (doc_id, h, k1, k2), the class_id of each text (k1, k2), and the tables that these two read."""
    sketches = written(sketch_rows(docs), "sketches", rows=BATCH)
    corpus = Corpus(docs, sketches)
    comp = written(_links(corpus), "classes")
    ids = corpus.keys.join(comp, F.col("node") == F.col("id")).groupBy("component").agg(F.min("rep").alias("class_id"))
    own = comp.join(ids, "component").select(F.col("id").alias("node"), "class_id")
    classes = corpus.reps.select("node", "rep", "k1", "k2").join(own, "node", "left").select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"))
    return sketches.select("doc_id", "h", "k1", "k2"), classes, [sketches, corpus.reps, comp]


def _links(corpus: Corpus) -> DataFrame:
    """Components (id, component) of the nodes that have links."""
    buckets = corpus.reps.where("sketch is not null").select("node", "n", F.posexplode("sketch").alias("band", "key"))
    roots = written(buckets.groupBy("band", "key").agg(F.min(F.struct("n", "node")).alias("least"), F.count("*").alias("size")).where("size > 1").select("band", "key", F.col("least.node").alias("root"), F.col("least.n").alias("root_n"), "size"), "roots")
    shared = written(buckets.join(roots, ["band", "key"]).select("band", "key", "node", "n", "root", "root_n", "size"), "buckets")
    forget(roots)
    stars = written(shared.where(f"node <> root and {_close('n', 'root_n')}").select("node", "root", "root_n").distinct(), "stars")
    # Each representative first meets the shortest root of its buckets, then those roots that are in other components still.
    first = stars.groupBy("node").agg(F.min(F.struct("root_n", "root")).alias("r")).select("node", F.col("r.root").alias("root"))
    found = written(corpus.verified(first.select(F.col("node").alias("a"), F.col("root").alias("b"))), "linked", rows=BATCH, few=True)
    comp = written(components(found, "near", kept=True), "components")
    rest = placed(placed(stars.join(first, ["node", "root"], "left_anti"), comp, "node", "ca"), comp, "root", "cb").where("ca <> cb").select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = written(corpus.verified(rest), "linked", rows=BATCH, few=True)
    forget(comp)
    found = found.unionByName(more)
    comp = written(components(found, "near", kept=True), "components")
    tested = stars.select(F.least("root", "node").alias("a"), F.greatest("root", "node").alias("b"))
    found = _crossed(shared.where(f"size <= {SMALL}"), comp, found, tested, corpus)
    forget(comp)
    large = shared.where(f"size > {SMALL}").select("band", "key", "node", "n", "root")
    if not large.isEmpty():
        found, members = _elected(large, found, tested, corpus)
        found = _blocks(members, found, corpus)
    out = written(components(found, "near", kept=True), "components")
    for x in (shared, stars):
        forget(x)
    return out


def placed(df: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    """df with the component of its column node."""
    own = comp.select(F.col("id").alias("__c"), F.col("component").alias(name))
    return df.join(own, F.col(node) == F.col("__c"), "left").withColumn(name, F.coalesce(name, node)).drop("__c")


def _several(members: DataFrame) -> DataFrame:
    """Those of members (band, key, c, ...) whose bucket holds several components.

    Both sides of the last join are tables, so that a bucket with many members is split over tasks.
    """
    members = written(members, "members")
    mixed = written(members.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "key"), "several")
    out = written(members.join(mixed, ["band", "key"]), "mixed")
    forget(members)
    forget(mixed)
    return out


def _elected(large: DataFrame, found: DataFrame, tested: DataFrame, corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """found, with the links of large buckets to further roots: the shortest member whose component has no root yet; and the
    members of those buckets that held several components, with their component c by all links but the last round's.

    It spares _blocks the pairs of large groups of copies and decides nothing: what a round leaves meets there. Components only
    grow, so the buckets of a round are among those of the one before.
    """
    met = written(large.select("band", "key", "root").distinct(), "met")
    members = large
    while True:
        own = written(components(found, "near", kept=True), "components")
        before, members = members, _several(placed(members.select("band", "key", "node", "n"), own, "node", "c"))
        forget(own)
        if before is not large:
            forget(before)
        done = written(members.join(met, (members["node"] == met["root"]) & (members["band"] == met["band"]) & (members["key"] == met["key"]), "left_semi").select("band", "key", "c").distinct(), "done")
        left = written(members.join(done, ["band", "key", "c"], "left_anti"), "left")
        root = written(left.groupBy("band", "key").agg(F.min(F.struct("n", "node")).alias("r")).select("band", "key", F.col("r.node").alias("root"), F.col("r.n").alias("root_n")), "roots")
        pairs = left.join(root, ["band", "key"]).where(f"node <> root and {_close('n', 'root_n')}").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b"))
        pairs = written(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        more = written(corpus.verified(pairs), "linked", rows=BATCH, few=True)
        found = found.unionByName(more)
        met = met.unionByName(root.select("band", "key", "root"))
        n, linked = pairs.count(), more.count()
        for x in (done, left, pairs):
            forget(x)
        if not linked or linked < WORTH * n:
            return found, members


def _word_counts(nodes: DataFrame, corpus: Corpus) -> DataFrame:
    """(node, counts, text): how many words of each of nodes have each of COUNTS hashes, 255 at most, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.bincount(np.fromiter((xxhash.xxh3_64_intdigest(w) % COUNTS for w in words_of(x.as_py())), np.int64), minlength=COUNTS) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.minimum(x, 255).astype(np.uint8).tobytes() for x in rows], pa.binary()), b.column(1)], ["node", "counts", "text"])

    return corpus.texts(nodes).mapInArrow(run, "node long, counts binary, text string")


def _tile_links(t: pa.Table) -> pa.Table:
    """Links (a, b) that unite the components of a tile's rows (bucket, buckets, first, node, n, c, counts, text).

    A pair meets in the first of the buckets that both are in. Lengths and counts bound the similarity; what they leave open
    is aligned, unless links of this tile have united it: there are fewer links than rows.
    """
    first, node, n, c = (t[k].to_numpy() for k in ("first", "node", "n", "c"))
    counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.uint8).reshape(-1, COUNTS)
    bucket, text, buckets = t["bucket"][0].as_py(), t["text"], t["buckets"]
    order = np.argsort(n, kind="stable")
    first, node, n, c, counts = first[order], node[order], n[order].astype(np.int64), c[order], counts[order]
    earlier: dict[int, set] = {}
    words: dict[int, list] = {}
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    def before(x: int) -> set:
        if x not in earlier:
            earlier[x] = {k for k in buckets[int(order[x])].as_py() if k < bucket}
        return earlier[x]

    def split(x: int) -> list:
        if x not in words:
            words[x] = words_of(text[int(order[x])].as_py())
        return words[x]

    one = bool(first.all())
    others = np.arange(len(n)) if one else np.flatnonzero(~first)
    lengths = n[others]
    a, b = [], []
    for x in np.flatnonzero(first).tolist():
        lo = x + 1 if one else np.searchsorted(lengths, -(-n[x] * SIMILARITY_PERCENT // 100))
        hi = np.searchsorted(lengths, n[x] * 100 // SIMILARITY_PERCENT, "right")
        y = others[lo:hi]
        y = y[c[y] != c[x]]
        if not len(y):
            continue
        apart = (np.maximum(counts[y], counts[x]) - np.minimum(counts[y], counts[x])).sum(axis=1, dtype=np.int64)
        for z in y[apart <= (n[y] + n[x]) * (100 - SIMILARITY_PERCENT) // (100 + SIMILARITY_PERCENT)].tolist():
            i, j = root(int(c[x])), root(int(c[z]))
            if i != j and before(x).isdisjoint(before(z)) and similar(split(x), split(z)):
                up[max(i, j)] = min(i, j)
                a.append(min(node[x], node[z]))
                b.append(max(node[x], node[z]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _blocks(buckets: DataFrame, found: DataFrame, corpus: Corpus) -> DataFrame:
    """found, with all links among members (band, key, node, n) of large buckets that are in different components.

    Members are dealt to classes of length, of which only neighbours hold similar texts. A bucket's most frequent component
    needs no pairs of its own: its members meet only the others, which are few where most of a bucket are copies. The others
    are dealt to blocks, and so are those of the component; two blocks meet in a tile, so that the pairs of one bucket are dealt
    over many tasks, and a row goes to each block that it meets. All that a member has to know of its bucket is one row.
    """
    own = written(components(found, "near", kept=True), "components")
    at = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101 / SIMILARITY_PERCENT))).cast("int")
    members = written(placed(buckets.select("band", "key", "node", "n"), own, "node", "c").withColumn("at", at), "members")
    forget(own)
    forget(buckets)
    of = written(members.groupBy("band", "key", "at", "c").agg(F.count("*").alias("of")), "of")
    most = of.groupBy("band", "key", "c").agg(F.sum("of").alias("of")).groupBy("band", "key").agg(F.max_by("c", F.struct("of", -F.col("c"))).alias("c"))
    same = of.join(most, ["band", "key", "c"]).select("band", "key", "at", F.col("c").alias("most"), F.col("of").alias("same"))
    every = of.groupBy("band", "key", "at").agg(F.sum("of").alias("of")).join(same, ["band", "key", "at"], "left")
    count = lambda x: F.ceil(x / BLOCK).cast("int")
    every = every.select("band", "key", "most", "at", count(F.col("of") - F.coalesce("same", F.lit(0))).alias("others"), count(F.coalesce("same", F.lit(0))).alias("same"))
    sizes = written(every.groupBy("band", "key").agg(F.max("most").alias("most"), *[F.map_from_entries(F.collect_list(F.struct("at", x))).alias(x) for x in ("others", "same")]), "sizes")
    counts = written(_word_counts(members.select("node").distinct(), corpus), "counts", rows=BATCH)

    def blocks(of: str, at: str, rest: int) -> Column:
        """The blocks of a class: whether they hold the rest, and their numbers."""
        n = F.coalesce(F.expr(f"{of}[{at}]"), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.lit(rest).alias("rest"), j.alias("block")))).otherwise(F.array().cast("array<struct<rest:int,block:int>>"))

    def met(at: str) -> Column:
        """The blocks of a class that a row meets: those of the rest, and of the component if it is not in it."""
        others = blocks("others", at, 1)
        return F.when(F.col("rest"), F.concat(others, blocks("same", at, 0))).otherwise(others)

    def tile(at: Column, low: Column, high: Column, first: Column, within: Column) -> Column:
        return F.struct(at.alias("at"), low.alias("i"), high.alias("j"), first.alias("first"), within.alias("within"))

    at, own = F.col("at"), F.col("own")
    rows = members.join(sizes, ["band", "key"]).withColumn("rest", F.col("c") != F.col("most"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.expr("others[at]")).otherwise(F.expr("same[at]"))).cast("int")
    rows = rows.withColumn("own", F.struct(F.col("rest").cast("int").alias("rest"), block.alias("block")))
    tiles = F.concat(
        F.transform(met("at"), lambda y: tile(at, F.least(own, y), F.greatest(own, y), own <= y, F.lit(True))),
        F.transform(met("at + 1"), lambda y: tile(at, own, y, F.lit(True), F.lit(False))),
        F.transform(met("at - 1"), lambda y: tile(at - 1, y, own, F.lit(False), F.lit(False))),
    )
    bucket = F.xxhash64("band", "key")
    # A node is in SKETCHES buckets at most.
    counts = counts.join(members.groupBy("node").agg(F.collect_set(bucket).alias("buckets")), "node")
    rows = rows.join(counts, "node").select("band", "key", bucket.alias("bucket"), "buckets", "node", "n", "c", "counts", "text", F.explode(tiles).alias("t"))
    rows = rows.select("band", "key", F.col("t.at").alias("at"), F.col("t.within").alias("within"), F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.first").alias("first"), "bucket", "buckets", "node", "n", "c", "counts", "text")
    more = written(rows.groupBy("band", "key", "at", "within", "i", "j").applyInArrow(_tile_links, "a long, b long"), "linked", few=True)
    for x in (members, of, counts, sizes):
        forget(x)
    return found.unionByName(more)


def _crossed(buckets: DataFrame, comp: DataFrame, found: DataFrame, tested: DataFrame, corpus: Corpus) -> DataFrame:
    """found, with the links among members (band, key, node, n) of a bucket of at most SMALL that are in different components."""
    members = _several(placed(buckets.select("band", "key", "node", "n"), comp, "node", "c"))
    x, y = members.alias("x"), members.alias("y")
    pairs = x.join(y, F.expr(f"x.band = y.band and x.key = y.key and x.node < y.node and x.c <> y.c and {_close('x.n', 'y.n')}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = written(corpus.verified(pairs.distinct().join(tested, ["a", "b"], "left_anti")), "linked", rows=BATCH, few=True)
    forget(members)
    return found.unionByName(more)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each class, with all their columns.

    Rows go by id and text, so that an id with several texts loses those alone whose class keeps another document. Equal ids
    and texts that stay are one document, of which one row stays, whatever its other columns. Null ids all stay. Null, empty
    and long texts are as in near_duplicate_classes; an empty table stays empty.
    """
    rows, classes, tables = _classes(docs)
    out = rows.where("doc_id is not null").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), (F.col("doc_id") == F.col("class_id")).alias("stays"))
    fate = written(out, "fate")
    for x in tables:
        forget(x)
    gone = fate.where("not stays").select("__id", "__h").distinct()
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    left = docs.join(gone, same, "left_anti")
    twice = written(fate.where("stays").groupBy("__id", "__h").agg(F.count("*").alias("c")).where("c > 1").select("__id", "__h"), "twice")
    if twice.isEmpty():
        return left
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
