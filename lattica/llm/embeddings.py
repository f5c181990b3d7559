"""Near duplicates among embeddings: int8 tile products with rigorous error bounds, then full precision where it matters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, written

THRESHOLD, TILE = 0.93, 2048
#: Rows of a tile whose products are held at a time, and open pairs.
ROWS, PAIRS = 512, 1 << 16
#: Float32 sums of products of int8 values are exact below this many dimensions.
EXACT_DIMENSIONS = (1 << 24) // (127 * 127)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in double precision, their int8 codes, scales, and the length of what the codes leave out."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1) + 1e-9  # the addition covers rounding
    return unit, codes, scale, error


@dataclass
class Codes:
    """Quantised vectors of one label: numbers of the vectors, copies of each, codes, scales and errors."""

    node: np.ndarray
    copies: np.ndarray
    code: np.ndarray
    scale: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, rows: np.ndarray) -> Codes:
        t = t.take(pa.array(rows))
        n = len(rows)
        return cls(t["node"].to_numpy(), t["c"].to_numpy(), np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(n, -1 if n else 0), t["scale"].to_numpy(), t["error"].to_numpy())


def bounded(a: Codes, b: Codes, same: bool, threshold: float = THRESHOLD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From which row of a, and for the rows of a from there on and all of b: which pairs are links, and which are open.

    With unit vectors x = x' + e and y = y' + f, x' and y' the decoded codes, x.y differs from x'.y' by at most
    |e| + (1 + |e|) |f|. Pairs whose least value reaches the threshold are links, those whose greatest does not are none, and
    the others are open. If a and b are the same, a pair is looked at once.
    """
    fa, fb = a.code.astype(np.float32), b.code.astype(np.float32)
    for at in range(0, len(fa), ROWS):
        if fa.shape[1] <= EXACT_DIMENSIONS:
            product = (fa[at : at + ROWS] @ fb.T).astype(np.float64)
        else:
            product = a.code[at : at + ROWS].astype(np.float64) @ b.code.astype(np.float64).T
        e = a.error[at : at + ROWS, None]
        product *= a.scale[at : at + ROWS, None] * b.scale[None, :]
        slack = e + (1.0 + e) * b.error[None, :]
        sure, maybe = product - slack >= threshold, product + slack >= threshold
        if same:
            later = np.arange(len(fb))[None, :] > np.arange(at, at + len(product))[:, None]
            sure &= later
            maybe &= later
        yield at, sure, maybe & ~sure


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = np.minimum(new, new[new])
        new = new[label]
        if (new == label).all():
            break
        label = new
    return label


def _linked(a: Codes, b: Codes, same: bool, i: np.ndarray, j: np.ndarray, is_open: np.ndarray | None = None) -> pa.Table:
    """For each vector of a and b that has links (i of a, j of b): the copies it links to, and one link that holds its component
    together, the least vector of it here; and whether it has open pairs."""
    node, copies = (a.node, a.copies) if same else (np.concatenate([a.node, b.node]), np.concatenate([a.copies, b.copies]))
    j = j if same else j + len(a.node)
    links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    order = np.argsort(node, kind="stable")
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    least = node[order][spanning(len(node), place[i], place[j])[place]]
    is_open = np.zeros(len(node), bool) if is_open is None else is_open
    hit = (links > 0) | is_open
    return pa.table({"node": node[hit], "links": links[hit].astype(np.int64), "other": least[hit], "open": is_open[hit]})


def _sides(t: pa.Table) -> tuple[Codes, Codes, bool]:
    tile, i, j = t["tile"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
    first = Codes.of(t, np.flatnonzero(tile == i))
    return first, first if i == j else Codes.of(t, np.flatnonzero(tile == j)), i == j


def _tile(t: pa.Table) -> pa.Table:
    """What the bounds decide within a tile or between two; vectors with open pairs are marked."""
    a, b, same = _sides(t)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_a, open_b = np.zeros(len(a.node), bool), np.zeros(len(b.node), bool)
    for at, sure, rest in bounded(a, b, same):
        i, j = np.nonzero(sure)
        left.append(i + at)
        right.append(j)
        open_a[at : at + len(rest)] |= rest.any(axis=1)
        open_b |= rest.any(axis=0)
    out = _linked(a, b, same, np.concatenate(left), np.concatenate(right), open_a | open_b if same else np.concatenate([open_a, open_b]))
    key = {c: pa.array(np.full(len(out), t[c][0].as_py()), pa.int32()) for c in ("i", "j")}
    return pa.table({**{c: out[c] for c in out.column_names}, **key})


def _exact(t: pa.Table) -> pa.Table:
    """The open pairs of a tile or of two, in double precision: t has the vectors that are in one."""
    a, b, same = _sides(t)
    where = {n: k for k, n in enumerate(t["node"].to_pylist())}
    vector = t["vector"]

    def unit(c: Codes, rows: np.ndarray) -> np.ndarray:
        return quantised(np.frombuffer(b"".join(vector[where[n]].as_py() for n in c.node[rows].tolist()), np.float64).reshape(len(rows), -1))[0]

    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, _, rest in bounded(a, b, same):
        i, j = np.nonzero(rest)
        if len(i):
            rows, cols = np.unique(i), np.unique(j)
            ua, ub = unit(a, rows + at), unit(b, cols)
            for k in range(0, len(i), PAIRS):
                ii, jj = i[k : k + PAIRS], j[k : k + PAIRS]
                sure = np.einsum("ij,ij->i", ua[np.searchsorted(rows, ii)], ub[np.searchsorted(cols, jj)]) >= THRESHOLD
                left.append(ii[sure] + at)
                right.append(jj[sure])
    return _linked(a, b, same, np.concatenate(left), np.concatenate(right)).select(["node", "links", "other"])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes, scales and errors of vectors (last column e), which travel instead of the vectors."""
    for b in batches:
        vectors = [np.asarray(x.values, np.float64) for x in b.column("e")]
        parts = [quantised(v[None, :]) for v in vectors]
        cols = [pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array([float(p[2][0]) for p in parts], pa.float64()), pa.array([float(p[3][0]) for p in parts], pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary())]
        keep = [c for c in b.schema.names if c != "e"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*keep, "code", "scale", "error", "vector"])


def near_embeddings(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null and they have the same number of dimensions; each pair with a
    cosine of at least THRESHOLD, in double precision, is a link. Equal vectors are compared once. Null ids, null or zero
    vectors and null or non-finite components link with nothing: no links, and the own id as component. Repeated rows are
    vectors of their own, and rows that share an id but not the vector or label have links and components of their own. An
    empty table gives no rows; other columns are not read. Every pair of a label is looked at, by pairs of tiles that are dealt
    out over all tasks, which are sent codes of a byte for each dimension. Vectors in full precision follow only where the
    error bounds leave a pair open. What leaves a task is one row for each vector, never a row for each pair.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.select("vec_id", "e", "label", F.coalesce(sound, F.lit(False)).alias("ok"))
    rows = written(v.select("vec_id", "ok", "label", "e", F.size("e").alias("d"), F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("e", lambda x: (x + 0.0).cast("string"))), 256)).alias("same")), "vectors")
    kind = rows.schema["label"].dataType.simpleString()
    reps = rows.where("ok").groupBy("label", "d", "same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("c"), F.first("e").alias("e"))
    # A node is a number that one vector of a label has: ids may repeat.
    reps = reps.select(F.monotonically_increasing_id().alias("node"), "label", "d", "same", "rep", "c", "e")
    reps = written(reps.mapInArrow(_coded, f"node long, label {kind}, d int, same string, rep long, c long, code binary, scale double, error double, vector binary"), "distinct")
    sizes = reps.groupBy("label", "d").agg(F.count("*").alias("n")).select("label", "d", F.ceil(F.col("n") / tile).cast("int").alias("t"))
    dealt = reps.drop("vector").join(written(sizes, "sizes"), ["label", "d"]).withColumn("tile", F.pmod(F.xxhash64("same"), F.col("t")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j"))))
    dealt = dealt.select("label", "d", "tile", "node", "c", "code", "scale", "error", pair.alias("p")).select("label", "d", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "tile", "node", "c", "code", "scale", "error")
    found = written(dealt.groupBy("label", "d", "i", "j").applyInArrow(_tile, "node long, links long, other long, open boolean, i int, j int"), "links")
    maybe = found.where("open").select("i", "j", "node").join(reps.select("node", "label", "d", "same", "c", "code", "scale", "error", "vector"), "node").join(written(sizes, "sizes"), ["label", "d"])
    maybe = maybe.select("label", "d", "i", "j", F.pmod(F.xxhash64("same"), F.col("t")).cast("int").alias("tile"), "node", "c", "code", "scale", "error", "vector")
    exact = written(maybe.groupBy("label", "d", "i", "j").applyInArrow(_exact, "node long, links long, other long"), "links", few=True)
    every = found.select("node", "links", "other").unionByName(exact).where("links > 0")
    links = every.groupBy("node").agg(F.sum("links").alias("links"))
    comp = written(components(every.select(F.col("node").alias("a"), F.col("other").alias("b")), "embeddings", kept=True), "components")
    least = comp.join(reps.select(F.col("node").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    comp = comp.join(least, "component").select(F.col("id").alias("node"), "component_id")
    per = reps.join(links, "node", "left").join(comp, "node", "left").select("label", "d", "same", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "label", "d", "same").join(per, ["label", "d", "same"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
