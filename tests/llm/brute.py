"""Plain versions of the operators, row by row, to hold results against."""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def article(page):
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body[1]))).split()) if body else ""


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15),
}


def pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PII.items() for m in re.finditer(p, text or "") if ok(m[0])]


def secrets(text):
    text = text or ""
    out = [("assign", 0, m) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 12]
    out += [("access", 1, m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", 2, m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{m.start()}:{m.end()}" for k, _, m in sorted(out, key=lambda x: (x[2].start(), x[1]))]


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])[:-1]])
    return [(int(s), len(x), zlib.crc32(x.tobytes())) for s, x in zip(starts, ids, strict=True)]


def byte_bpe(text):
    import base64

    import tiktoken

    global _ENC
    if "_ENC" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
        _ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = _ENC.encode_ordinary(text or "")
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def embeddings(rows):
    """vec_id to (n_links, component) for distinct ids."""
    groups = defaultdict(list)
    for i, e, label in rows:
        if i is not None and e is not None and label is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            groups[label, len(e)].append((i, np.array(e, float)))
    n, links = Counter(), []
    for own in groups.values():
        x = np.array([e / np.linalg.norm(e) for _, e in own])
        close = x @ x.T >= 0.93
        for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True):
            links.append((own[a][0], own[b][0]))
            n[own[a][0]] += 1
            n[own[b][0]] += 1
    comp = components([i for i, _, _ in rows if i is not None], links)
    return {i: (n[i], comp[i]) for i in comp}


def targets(sizes):
    """Targets of sources by repeated resharing of what is above three times a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        rest, w = total - sum(out.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / w > 3 * sizes[s]}
        if not full:
            return out | {s: rest * weight[s] / w for s in open_}
        out |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    return out


def words(text):
    """Words in lower case without the usual marks."""
    return re.sub(r"""[.,;:!?"'()\[\]{}]""", "", (text or "").lower()).split()


def aligned(a, b):
    """The length of the longest common subsequence, by the whole matrix, a row of it as one integer."""
    where = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        u = row & where.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def alike(a, b):
    """Whether aligned words are at least 0.8 of all words, aligned ones counted once."""
    if min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False
    n = aligned(a, b)
    return 5 * n >= 4 * (len(a) + len(b) - n)


def near_classes(texts):
    """id to the least id of its group, for a dict of texts: all pairs that could be alike are aligned."""
    w = {i: words(t) for i, t in texts.items()}
    bags = {i: Counter(x) for i, x in w.items()}
    ids = sorted(w)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            la, lb = len(w[a]), len(w[b])
            if la and lb and min(la, lb) >= 0.8 * max(la, lb):
                shared = sum(min(n, bags[b][x]) for x, n in bags[a].items())
                if 5 * shared >= 4 * (la + lb - shared) and alike(w[a], w[b]):
                    links.append((a, b))
            elif not la and not lb and (texts[a] or "") == (texts[b] or ""):
                links.append((a, b))
    return components(ids, links)


def contexts(rows, unit, seeds=5, share=0.5, sure_score=0.8):
    """id to spans that bootstrapped patterns disclose, for (id, text) rows: patterns are the one and two words next to a unit."""
    found, occurrences = [], Counter()
    for i, text in rows:
        text = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
        occurrences.update(w)
        occurrences.update(" ".join(p) for p in zip(w, w[1:], strict=False))
        hits = list(re.finditer(unit, text))
        edges = [0, *[m.end() for m in hits]], [*[m.start() for m in hits], len(text)]
        gaps = [re.split(r"[\x20\x09-\x0D]+", text[a:b].lower().strip(" \t\n\r\x0b\x0c")) for a, b in zip(*edges, strict=True)]
        gaps = [[x for x in g if x] for g in gaps]
        for k, m in enumerate(hits):
            token = m[0].lstrip("([{<\"'")
            start = m.end() - len(token)
            token = token.rstrip(".,;:!?)]}>\"'")
            if not token:
                continue
            left, right = gaps[k], gaps[k + 1]
            patterns = [("<", " ".join(left[-n:])) for n in (1, 2) if len(left) >= n] + [(">", " ".join(right[:n])) for n in (1, 2) if len(right) >= n]
            found.append((i, start, start + len(token), token, bool(pii(token)), patterns))
    n = Counter((p, f[3]) for f in found for p in f[5])
    first = {f[3] for f in found if f[4]}
    support = defaultdict(set)
    for p, t in n:
        support[p].add(t)
    sure = set(first)
    while True:
        strong = {}
        for p, own in support.items():
            if len(own) < seeds or own <= first:
                continue
            hit = [t for t in own if t in sure]
            value = sum(n[p, t] for t in hit) / max(occurrences[p[1]], sum(n[p, t] for t in own))
            if len(hit) >= seeds and value >= share:
                strong[p] = value
        score = defaultdict(lambda: 1.0)
        for p, t in n:
            if p in strong:
                score[t] *= max(1.0 - strong[p], 1e-6)
        new = first | {t for t, left in score.items() if 1.0 - left >= sure_score - 1e-9}
        if new == sure:
            break
        sure = new
    out = defaultdict(set)
    for i, a, b, t, seed, patterns in found:
        if not seed and t in sure and any(p in strong for p in patterns):
            out[i].add((a, b))
    return {i: sorted(x) for i, x in out.items()}


def masked(text, spans, mask="[SECRET]"):
    """text with each group of overlapping spans (start, end) as one mask."""
    out, end = [], 0
    for a, b in sorted(spans):
        if a >= end:
            out += [text[end:a], mask]
        end = max(end, b)
    return "".join([*out, text[end:]])
