"""Text: captions, query terms and answers."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The gates of caption cleaning.
MIN_WORDS, MAX_WORDS, MAX_NON_ASCII, MIN_LETTERS, MAX_REPEAT = 3, 60, 0.15, 6, 0.5
URL = r"(?i)https?://|www\."


def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(t))))


def normalized_caption(text: Column) -> Column:
    """References decoded, tags blanked, NFKC, invisible characters blanked, runs of three or more equal marks as one, one space between words."""
    return squeezed(F.pandas_udf(_compatible, "string")(text))


def squeezed(t: Column) -> Column:
    """White space, invisible characters and tags as one blank, and then runs of three or more equal marks as one."""
    t = F.regexp_replace(t, "(?:<[^>]++>|[\u200b\u200c\u200d\ufeff\\s])++", " ")
    t = F.regexp_replace(t, r"([!?.,;:])\1{2,}+", "$1")
    return F.trim(t)


def plain_caption(text: Column) -> Column:
    """The same for text without references or compatibility characters: expressions only."""
    return squeezed(text)


def words(t: Column) -> Column:
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(t: Column) -> Column:
    """How many words() has, by its single blanks."""
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def letters(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"([A-Za-z']+)"), 1)


def caption_reason(t: Column, most: int | None = MAX_WORDS) -> Column:
    """Why a normalised caption is dropped, by the first gate it fails; empty if it is kept. most: words, None for any number."""
    n = word_count(t)
    non_ascii = F.length(F.regexp_replace(t, r"[\x00-\x7f]++", "")) / F.greatest(F.length(t), F.lit(1))
    enough = t.rlike(f"(?:[^A-Za-z']*+[A-Za-z']){{{MIN_LETTERS}}}")
    low = letters(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    # A lambda binds its argument: the words are extracted once.
    varied = F.get(F.transform(F.array(low), lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))), F.lit(0))
    return (
        F.when(t.rlike(URL), "url")
        .when(n < MIN_WORDS, "too_short")
        .when(F.lit(False) if most is None else n > most, "too_long")
        .when(t == "", "empty")
        .when(non_ascii > MAX_NON_ASCII, "non_ascii")
        .when(~enough, "no_alpha")
        .when(1 - varied > MAX_REPEAT, "degenerate_repeat")
        .otherwise("")
    )


def word_set(t: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words(F.lower(t)))), " ")


def query_text(t: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def bigrams(t: Column) -> Column:
    """The set of character pairs without spaces; a text of one character is its own."""
    s = F.regexp_replace(t, " ", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all members of two sets, `empty` if neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def lexical_score(query: Column, label: Column, shared: Column) -> Column:
    """1 for a shared concept, 0.85 if one text holds the other, else the scaled overlap of bigrams, 0.8 at most."""
    q, x = query_text(query), query_text(label)
    near = (F.length(q) > 0) & (F.length(x) > 0) & (q.contains(x) | x.contains(q))
    return F.when(shared, 1.0).when(near, 0.85).otherwise(F.least(F.lit(0.8), 1.6 * jaccard(bigrams(q), bigrams(x))))


def duration_bucket(s: Column) -> Column:
    return F.when(s < 15, "<15s").when(s < 30, "15-30s").when(s < 60, "30-60s").when(s < 120, "60-120s").otherwise(">120s")


def stable_hash(t: Column) -> Column:
    """60 bits of MD5, which other engines compute alike."""
    return F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("long")


def json_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text, fences and trailing commas aside; None without one."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(text[start:], start):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return re.sub(r",(\s*[}\]])", r"\1", text[start : i + 1])
    return None


def _json_objects(text: pd.Series) -> pd.Series:
    return text.map(json_object)


def extract_json(text: Column) -> Column:
    return F.pandas_udf(_json_objects, "string")(text)
