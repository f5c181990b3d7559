"""Quality rules: an isolation forest over rule statistics of whole texts, with a cut-off that comes from labelled rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written

SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest splits: letters a word, symbols a word, distinct words and the most frequent word among all words. Repeated
#: lines and windows are left to the base rules: they are rare in good texts, and a forest without labels takes that for odd.
FEATURES = ("mean_word", "symbol_ratio", "distinct_ratio", "top_ratio")
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Bound of the sample of labelled rows that the forest is fitted on; the cut-off is taken from all labelled rows.
FIT_ROWS, TREES, TREE_ROWS, SEED = 20_000, 100, 256, 17
#: Share of good labelled rows that the cut-off may reject.
MAX_GOOD_REJECTED = 0.005
#: Words up to which a text's share of distinct ones is raised to that of LONG words, by a power law.
LONG, POWER = 400, 0.3

_SPACE = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; windows are ranked exactly by doubling, so no hash can collide."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
    width = 1
    while width < window:
        step = min(width, window - width)
        pairs = (ids[: len(ids) - step] << 32) | ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width += step
    hot = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hot)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def rule_row(text: str | None) -> tuple:
    """The base counts and the forest's features of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    word_chars = len(text) - spaces
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    per = 1.0 / max(n, 1)
    counts = Counter(words)
    distinct = len(counts) * per * (min(n, LONG) / LONG) ** POWER if n else 0.0
    return n, word_chars, symbols, dup, repeat, word_chars * per, symbols * per, distinct, max(counts.values(), default=0) * per


_STATS = pa.schema([(c, pa.int64()) for c in BASE] + [(c, pa.float64()) for c in FEATURES])
STATS_SCHEMA = ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in FEATURES])


def _columns(texts: pa.Array) -> list[pa.Array]:
    rows = [rule_row(t.as_py()) for t in texts]
    return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_STATS)]


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of statistics for each row of docs; other columns of docs are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(b.column(1))], ["doc_id", *_STATS.names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {STATS_SCHEMA}")


@dataclass
class IsolationForest:
    """Trees over random splits as flat arrays: feature (-1 in a leaf), cut, left child; the right child follows it.

    A leaf's depth holds its path length with the usual addition for the rows left in it.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float

    @staticmethod
    def _c(n: int) -> float:
        return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(x))
        limit = max(1, int(np.ceil(np.log2(max(rows, 2)))))
        built = []
        for _ in range(trees):
            nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, rng.choice(len(x), rows, replace=False) if rows else np.empty(0, int), 0)]
            while todo:
                at, own, d = todo.pop()
                sub = x[own]
                span = np.flatnonzero(np.ptp(sub, axis=0) > 0) if len(own) > 1 and d < limit else []
                if not len(span):
                    nodes[at] = [-1, 0.0, 0, d + cls._c(len(own))]
                    continue
                f = int(rng.choice(span))
                cut = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
                low = sub[:, f] < cut
                nodes[at] = [f, cut, len(nodes), 0.0]
                nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                todo += [(len(nodes) - 2, own[low], d + 1), (len(nodes) - 1, own[~low], d + 1)]
            built.append(nodes)
        most = max(map(len, built))
        a = np.zeros((trees, most, 4))
        a[:, :, 0] = -1
        for i, nodes in enumerate(built):
            a[i, : len(nodes)] = nodes
        return cls(a[..., 0].astype(np.int32), a[..., 1], a[..., 2].astype(np.int32), a[..., 3], max(cls._c(rows), 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 to the power of the negative mean path over the usual path."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, cut, left, depth in zip(self.feature, self.cut, self.left, self.depth, strict=True):
            at = np.zeros(len(x), np.int32)
            while True:
                ff = f[at]
                inner = ff >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(ff, 0)] >= cut[at]
                at = np.where(inner, left[at] + right, at)
            total += depth[at]
        return np.exp2(-total / len(self.feature) / self.norm)


@dataclass
class QualityModel:
    forest: IsolationForest | None
    cutoff: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(x) if self.forest is not None and len(x) else np.zeros(len(x))

    def verdict(self, base: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, repeat = base["n_words"], base["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        score = self.score(x)
        return failed, score, ~failed & (score <= self.cutoff)


def fit_quality(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """The forest of labelled rows and its cut-off.

    The forest is fitted on the rule statistics of at most fit_rows labelled rows that pass the base rules, in the order of a
    hash of their id, whatever their label. Labels set the cut-off: the best Youden index over all labelled rows among the
    cut-offs that reject at most MAX_GOOD_REJECTED of the good ones. Without good labelled rows there is no forest, and only
    the base rules reject. Null labels and null ids are not used; of an id with several labels the greatest counts.
    """
    y = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("__y"))
    rows = stats.join(y, "doc_id").where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    rows = written(rows.select("doc_id", "__y", *FEATURES), "labelled")
    order = F.xxhash64("doc_id", F.lit(SEED))
    part = min(1.0, 1.25 * fit_rows / max(rows.count(), 1))  # so that tasks do not each send that many rows
    sample = rows.where(F.pmod(order, F.lit(1_000_000)) < round(part * 1e6)).orderBy(order, *FEATURES).limit(fit_rows).select("__y", *FEATURES).toPandas()
    if not (sample["__y"] == 1).any():
        forget(rows)
        return QualityModel(None, 1.0)
    model = QualityModel(IsolationForest.fit(sample[list(FEATURES)].to_numpy(float)), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
            yield pa.RecordBatch.from_arrays([b.column("__y"), pa.array(np.round(model.score(x), 3))], ["y", "s"])

    # Scores have three digits, so that at most a thousand rows come back whatever the corpus holds.
    counts = rows.mapInArrow(run, "y int, s double").groupBy("s").agg(F.sum((F.col("y") == 1).cast("long")).alias("good"), F.sum((F.col("y") == 0).cast("long")).alias("bad")).toPandas().sort_values("s")
    forget(rows)
    good_above = counts.good[::-1].cumsum()[::-1].to_numpy() / max(counts.good.sum(), 1)
    bad_above = counts.bad[::-1].cumsum()[::-1].to_numpy() / max(counts.bad.sum(), 1)
    gain = np.where(good_above <= MAX_GOOD_REJECTED, bad_above - good_above, -1.0)
    best = int(np.argmax(gain))
    model.cutoff = float(counts.s.iloc[best]) - 0.0005 if gain[best] > 0 else 1.0
    return model


def judged(stats: DataFrame, model: QualityModel) -> DataFrame:
    """stats with base_failed, anomaly and kept."""
    names = [c for c in stats.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            failed, score, kept = model.verdict(col, np.column_stack([col[c] for c in FEATURES]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(kept)], [*b.schema.names, "base_failed", "anomaly", "kept"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, {STATS_SCHEMA}, base_failed boolean, anomaly double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): base counts, features, base_failed, anomaly and kept.

    Null or empty texts have no words and fail. Repeated rows and ids each get their own row; null ids stay. An empty table
    gives an empty result. Other columns of docs, whatever their names, are not read.
    """
    stats = written(rule_stats(docs), "stats")
    return judged(stats, fit_quality(stats, labels))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; the statistics are taken again rather than joined back.

    Null, empty and short texts go, as the base rules have it. Repeated rows and null ids are each judged by their text; an
    empty table stays empty; columns of any other name pass through.
    """
    stats = written(rule_stats(docs), "stats")
    model = fit_quality(stats, labels)
    forget(stats)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(_STATS.names, (c.to_numpy(zero_copy_only=False) for c in _columns(b.column(at))), strict=True))
            kept = model.verdict(cols, np.column_stack([cols[c] for c in FEATURES]))[2]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
