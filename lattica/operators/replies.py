"""Answers in words: templates over the rows that an intent was answered with."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from lattica.operators import language as L

#: Words that name nothing, left out when the subject of a question is looked for.
EMPTY = ("the", "a", "an", "is", "are", "there", "of", "to", "me", "my", "any", "please", "in", "on", "and", "it", "from", "here", "do", "does", "you", "see", "room", "请", "问", "的", "了", "吗", "呢", "我", "这", "那", "里", "个", "是", "有", "在", "和")
_MARKS = " \t\r\n，。？！,.?!：:；;、\"'（）()「」【】"


@dataclass
class Reply:
    """An answer: what was asked, the words, the rows behind them, and how sure they are."""

    question: str
    kind: str
    text: str
    rows: list[dict]
    confidence: float
    debug: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return dict(vars(self))


def unknown_subject(question: str | None, labels: list[str]) -> str | None:
    """The first word of a question that neither asks, nor fills, nor is a name in the map."""
    left = f" {(question or '').lower()} "
    for word in sorted({w for words in L.KEYWORDS.values() for w in words} | {w for words in L.RELATION_WORDS.values() for w in words} | {x.lower() for x in labels}, key=lambda w: (-len(w), w)):
        left = left.replace(word, " ")
    for word in sorted(EMPTY, key=lambda w: (-len(w), w)):
        left = left.replace(word if ord(word[0]) > 127 else f" {word} ", " ")
    rest = [x for x in (w.strip(_MARKS) for w in left.split()) if x and x not in EMPTY]
    return rest[0] if rest else None


def missing_subject(question: str, intent: L.Intent, labels: list[str]) -> str | None:
    """What a question asks about that the map does not have; None if it has all, or nothing is asked about."""
    known = {x.lower() for x in labels}
    for name in (intent.subject, intent.other):
        if name and name.lower() not in known:
            return name
    if intent.kind == "locate" and not intent.subject:
        return unknown_subject(question, labels)
    return None


def _at(r: dict) -> str:
    return f"({r['cx']:+.2f}, {r['cy']:+.2f}, {r['cz']:+.2f}) m"


def reply(question: str, intent: L.Intent, rows: list[dict], missing: str | None, labels: list[str]) -> Reply:
    kind, a, b = intent.kind, intent.subject, intent.other
    if missing:
        has = ", ".join(sorted(labels)[:10]) or "nothing"
        return Reply(question, kind, f"There is no {missing} in this map. It has: {has}.", [], 0.0, {"reason": "not_in_map", "asked": missing})
    if kind in ("distance", "relation") and not b and kind == "distance":
        return Reply(question, kind, "Name two objects, as in: how far is the cup from the table.", [], 0.0)
    if not rows and kind not in ("list_on", "count"):
        return Reply(question, kind, "I found none of what was asked about.", [], 0.0)
    sure = float(min((r["conf"] for r in rows if r.get("conf") is not None), default=1.0))
    first = rows[0] if rows else {}
    if kind == "distance":
        text = f"The centre of the {a} is {first['distance']:.2f} m from that of the {b}, with {first['gap']:.2f} m between them; it is {first['relation']} it."
    elif kind == "relation" and b:
        text = f"{'Yes' if first['holds'] else 'No'}: the {a} is {first['relation']} the {b}" + (f", you asked for {intent.relation}" if intent.relation else "") + f"; their centres are {first['distance']:.2f} m apart."
    elif kind == "list_on":
        text = f"Nothing else is on or in the {a}." if not rows else f"There are {len(rows)} objects on or in the {a}: " + ", ".join(f"{r['label']} ({r['distance']:.2f} m)" for r in rows[:6]) + "."
    elif kind == "count":
        text = f"There are {first.get('n', 0)} of {a}."
    elif kind == "nearest":
        text = f"The nearest {a or 'object'} is a {first['label']} at {_at(first)}, {first['distance']:.2f} m away."
    elif kind in ("locate", "relation"):
        text = f"The {a} is at {_at(first)}, {first['x1'] - first['x0']:.2f} x {first['y1'] - first['y0']:.2f} x {first['z1'] - first['z0']:.2f} m in size, {first['distance']:.2f} m away."
    else:
        text = "The map has " + ", ".join(f"{r['n']} of {r['label']}" for r in rows) + "."
    return Reply(question, kind, text, rows, sure, {"relation_matches_question": bool(first.get("holds"))} if kind == "relation" and b else {})
