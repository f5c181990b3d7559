"""Prompts for models, and what their free text says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators.language import RELATION_WORDS
from lattica.operators.reward import numbers, yes_no


def grounding(names: Sequence[str]) -> str:
    """Names as a grounding detector wants them: lower case, each ended by a full stop."""
    clean = [x for x in (str(n).strip().lower().rstrip(".") for n in names) if x]
    return ". ".join(clean) + "." if clean else ""


def capped(detections: DataFrame, most: int, by: str = "frame_id") -> DataFrame:
    """The best detections (by, score, label) of each frame, ties by label: a detector's own limit."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("__s"), "label", F.struct(*detections.columns).alias("d"))))
    return detections.groupBy(by).agg(F.slice(best, 1, most).alias("b")).select(F.explode("b.d").alias("d")).select("d.*")


def scene_prompt(objects: DataFrame, question: str, most: int = 40) -> DataFrame:
    """One row (prompt): a question about a scene with its most confident objects as lines, and the answer that is wanted."""
    top = objects.orderBy(F.desc("conf"), "obj_id").limit(most)
    line = F.format_string("- %s #%d at (%.2f, %.2f, %.2f) m, sure %.2f", "label", "obj_id", "cx", "cy", "cz", "conf")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), "obj_id", line.alias("line")))), lambda x: x["line"]), "\n")
    ask = F.lit(f'\n\nQuestion: {question}\nAnswer with a JSON object: {{"answer": text, "targets": [labels], "confidence": 0 to 1}}. Name only objects of the list.')
    return top.agg(F.concat(F.lit("Objects of the scene:\n"), lines, ask).alias("prompt"))


def free_answer(text: Column) -> Column:
    """What a text without JSON says: yes (denial is looked for first), the first number as a distance, the first three as a place,
    the first relation that it names, and the names of a list."""
    found = numbers(text)
    low = F.lower(text)
    relation = F.lit(None).cast("string")
    for name, words in reversed(RELATION_WORDS.items()):
        hit = F.lit(False)
        for w in (name, *words):
            hit = hit | low.contains(w)
        relation = F.when(hit, name).otherwise(relation)
    names = F.filter(F.transform(F.split(F.regexp_replace(low, r"^[^:：]*[:：]", ""), r"\s*(?:,|，|、|;|\band\b|和)\s*"), lambda x: F.trim(F.regexp_replace(x, r"[.。!?]+$", ""))), lambda x: x != "")
    place = F.when(F.size(found) >= 3, F.slice(found, 1, 3))
    return F.struct(yes_no(text).alias("yes"), F.get(found, F.lit(0)).alias("distance"), place.alias("place"), relation.alias("relation"), names.alias("names"))


def parsed_answer(text: Column, schema: str) -> Column:
    """A model's answer: its JSON object if there is one, and what the text says otherwise."""
    json = T.extract_json(text)
    return F.struct(F.from_json(json, schema).alias("json"), F.when(json.isNull(), free_answer(text)).alias("free"))
