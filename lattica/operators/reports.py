"""Reports: accuracy by intent, automatic labels, corpus runs, and figures as text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import geometry as G
from lattica.operators import corpus as C
from lattica.operators import metrics as M

#: What goes wrong with a video.
ERRORS = ("missing_file", "open_failed", "empty_video", "decode_failed")


def format_metrics(figures: Mapping[str, object], digits: int = 3) -> str:
    """One line `name: value` for each figure, names padded to one width; numbers with so many digits, none as a dash."""
    wide = max(map(len, figures), default=0)
    text = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)
    return "\n".join(f"{k:<{wide}}: {text(v)}" for k, v in figures.items())


def format_report(title: str, sections: Mapping[str, Mapping[str, object] | list[Mapping[str, object]]], digits: int = 3) -> str:
    """A report in Markdown: a table for each section, of one row for each figure or of one for each record."""
    text = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    out = [f"# {title}", ""]
    for name, body in sections.items():
        rows = [{"figure": k, "value": v} for k, v in body.items()] if isinstance(body, Mapping) else list(body)
        out += [f"## {name}", ""]
        if rows:
            names = list(rows[0])
            out += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(text(r.get(n)) for n in names) + " |" for r in rows], ""]
        else:
            out += ["nothing", ""]
    return "\n".join(out)


# ---------------------------------------------------------------------------------------------------- questions and labels


def accuracy_by_intent(answers: DataFrame) -> DataFrame:
    """Rows (intent, ok): how many were asked, how many could be judged (ok is not null), and the share that is right; and the same
    over all, as intent `all`."""
    rows = answers.select(F.explode(F.array(F.col("intent"), F.lit("all"))).alias("intent"), "ok")
    ok = F.when(F.col("ok").isNotNull(), F.col("ok").cast("double"))
    return rows.groupBy("intent").agg(F.count("*").alias("asked"), F.count("ok").alias("judged"), F.coalesce(F.sum(ok), F.lit(0.0)).cast("long").alias("right"), F.avg(ok).alias("accuracy"))


def asked_of_map(scene_map: Any, most: int = 20, reach: float = 0.6) -> list[dict]:
    """Questions of seven intents about a map, with whether its engine's answers agree with the boxes: (intent, question, ok).

    Distance, relation and list_on ask about labels of one object only, as others have no one answer; most bounds the questions of
    an intent. Each question is asked on the driver, as a user asks it.
    """
    o = scene_map.objects
    per = o.groupBy("label").agg(F.count("*").alias("n"), F.min_by("obj_id", F.struct((-F.col("conf")).alias("c"), "obj_id")).alias("best")).orderBy("label").limit(most).collect()
    single = [r["label"] for r in per if r["n"] == 1]
    out: list[dict] = []

    def ask(intent: str, question: str, check: Callable[[list], bool | None]) -> None:
        kind, rows = scene_map.answer(question)
        out.append({"intent": intent, "question": question, "ok": kind.kind == intent and check(rows.limit(most * 5).collect())})

    for r in per:
        ask("locate", f"where is the {r['label']}", lambda x, r=r: bool(x) and x[0]["obj_id"] == r["best"])
        ask("count", f"how many {r['label']}", lambda x, r=r: bool(x) and x[0]["n"] == r["n"])
        d = G.length([F.col(f"c{k}") for k in G.AXES])
        near = o.where(F.col("label") == r["label"]).orderBy(d, "obj_id").select("obj_id").first()
        ask("nearest", f"nearest {r['label']}", lambda x, near=near: bool(x) and x[0]["obj_id"] == near["obj_id"])
    for a, b in list(zip(single, single[1:], strict=False))[:most]:
        pair = {r["label"]: r for r in o.where(F.col("label").isin(a, b)).select("label", "cx", "cy", "cz").collect()}
        d = sum((pair[a][f"c{k}"] - pair[b][f"c{k}"]) ** 2 for k in "xyz") ** 0.5
        ask("distance", f"how far is the {a} from the {b}", lambda x, d=d: bool(x) and abs(x[0]["distance"] - d) < 1e-6)
        rel = scene_map.relations(1e6).where((F.col("subject") == a) & (F.col("object") == b)).select("relation").first()
        words = {"above": "above", "below": "below", "left_of": "left of", "right_of": "right of", "in_front_of": "in front of", "behind": "behind", "inside": "inside", "near": "near", "overlapping": "near"}
        if rel and rel["relation"] in words:
            ask("relation", f"is the {a} {words[rel['relation']]} the {b}", lambda x: bool(x) and x[0]["holds"])
    ask("describe", "describe", lambda x: sum(r["n"] for r in x) == sum(r["n"] for r in per) if len(per) < most else None)
    return out


def labelled(detections: DataFrame, sizes: DataFrame) -> DataFrame:
    """Automatic labels: detections (label, score, n_points, diagonal) with the reason why one is refused, empty if accepted.

    sizes (label, low, high) are the diagonals that objects of a class have; classes that it lacks may have any.
    """
    s = sizes.select(F.col("label").alias("__l"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    out = detections.join(F.broadcast(s), F.col("label") == F.col("__l"), "left")  # a row for each class
    return out.withColumn("reason", M.label_reason(F.col("score"), F.col("n_points"), F.col("diagonal"), F.coalesce("__low", F.lit(0.0)), F.coalesce("__high", F.lit(float("inf"))))).drop("__l", "__low", "__high")


def label_report(labels: DataFrame) -> DataFrame:
    """A row for each class of labelled(): detections, accepted ones, their mean score, and how many each gate refused."""
    ok = F.col("reason") == ""
    gates = [F.sum((F.col("reason") == g).cast("long")).alias(g) for g in ("low_score", "few_points", "implausible_size")]
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("accepted"), F.avg(F.when(ok, F.col("score"))).alias("mean_score"), *gates)


# ---------------------------------------------------------------------------------------------------- corpus runs


def video_error(exists: Column, opens: Column, frames: Column, decoded: Column) -> Column:
    """The first of ERRORS that holds of a video, empty if none."""
    return F.when(~F.coalesce(exists, F.lit(False)), ERRORS[0]).when(~F.coalesce(opens, F.lit(False)), ERRORS[1]).when(F.coalesce(frames, F.lit(0)) <= 0, ERRORS[2]).when(~F.coalesce(decoded, F.lit(False)), ERRORS[3]).otherwise("")


def process_each(videos: DataFrame, work: Callable[[dict], dict], schema: str, columns: list[str]) -> DataFrame:
    """videos (video_id, ...) through work, one at a time in Arrow batches: its columns, and error, empty unless work raised.

    What work raises becomes the error of its video and ends no other: FileNotFoundError is missing_file, OSError open_failed,
    EOFError empty_video, and anything else decode_failed.
    """
    kinds = ((FileNotFoundError, ERRORS[0]), (EOFError, ERRORS[2]), (OSError, ERRORS[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v in b.to_dict("records"):
                try:
                    rows.append({**{c: None for c in columns}, **work(v), "video_id": v["video_id"], "error": ""})
                except Exception as e:  # the corpus goes on
                    rows.append({**{c: None for c in columns}, "video_id": v["video_id"], "error": next((k for t, k in kinds if isinstance(e, t)), ERRORS[3])})
            yield pd.DataFrame(rows, columns=["video_id", *columns, "error"])

    kind = videos.schema["video_id"].dataType.simpleString()
    return videos.mapInPandas(run, f"video_id {kind}, {schema}, error string")


@dataclass
class CorpusRun:
    """A run over a corpus: the videos with their errors, the captions with their drop reasons, and the summary of both."""

    videos: DataFrame
    captions: DataFrame
    funnel: DataFrame
    failures: DataFrame

    def to_dict(self) -> dict[str, Any]:
        return {"funnel": self.funnel.first().asDict(), "failures": {r["error"]: r["n"] for r in self.failures.collect()}, "drop_reasons": {r["drop_reason"]: r["n"] for r in self.captions.groupBy("drop_reason").agg(F.count("*").alias("n")).collect()}}

    def summary(self) -> str:
        d = self.to_dict()
        return format_report("Corpus run", {"Funnel": d["funnel"], "Failures": d["failures"], "Dropped captions": d["drop_reasons"]})


def run_corpus(videos: DataFrame, captions: DataFrame, work: Callable[[dict], dict], done: DataFrame | None = None, full: bool = True) -> CorpusRun:
    """All videos that are not done yet through work, which gives frames and kept; then their captions in one pass: cleaned, and
    counted by video. A video that fails keeps its captions out of the figures of kept ones."""
    todo = videos if done is None else C.remaining(videos, done)
    seen = process_each(todo, work, "frames long, kept long", ["frames", "kept"])
    clean = C.cleaned(captions.join(todo.select("video_id"), "video_id", "left_semi"), full)
    per = clean.groupBy("video_id").agg(F.count("*").alias("captions"), F.sum((F.col("drop_reason") == "").cast("long")).alias("captions_kept"))
    both = seen.join(per, "video_id", "left").fillna(0, ["frames", "kept", "captions", "captions_kept"])
    return CorpusRun(both, clean, C.funnel(both), C.failures(both))
