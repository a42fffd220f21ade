"""The operators' contracts in plain Python, one text at a time."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CODES = ("assign", "access", "hex")


def words(text):
    return WORD.findall(text or "")


def counts(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, earlier, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for line in lines:
        dup += line in earlier
        earlier.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def distance(a, b):
    """Edit distance of two lists, in full: a row of the table at a time."""
    number = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    there, place = np.array([number[x] for x in b], int), np.arange(len(b) + 1)
    row = place.copy()
    for i, x in enumerate(a):
        new = np.append(i + 1, np.minimum(row[:-1] + (there != number[x]), row[1:] + 1))
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def similar(a, b, least=0.8):
    """Are two lists of words so alike? The first two tests only spare the table where no distance can be small enough."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - least) + 1e-9)
    if not a or not b or abs(len(a) - len(b)) > most or longer - (Counter(a) & Counter(b)).total() > most:
        return False
    return distance(a, b) <= most


def classes(rows, least=0.8):
    """Class of each row (id, text): the least id among texts that chains of similar pairs join."""
    w = [words(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and ((rows[i][1] or "") == (rows[j][1] or "") or similar(w[i], w[j], least)):
                top[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    return [min(x for x in members[root(i)] if x is not None) if any(x is not None for x in members[root(i)]) else None for i in range(len(rows))]


def kept_words(texts, n):
    w = [words(t) for t in texts]
    seen = Counter(tuple(x[i : i + n]) for x in w for i in range(len(x) - n + 1))
    out = []
    for x in w:
        gone = {i + k for i in range(len(x) - n + 1) if seen[tuple(x[i : i + n])] > 1 for k in range(n)}
        out.append((len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone)))
    return out


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, (shape, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(shape, text) if len(m[0]) >= least]
    return sorted(out)


def redacted(text, spans, mark="[SECRET]"):
    out, at = "", 0
    for start, _, end in spans:
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]
