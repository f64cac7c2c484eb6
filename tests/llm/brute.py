"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(seq, width):
    if not seq:
        return set()
    width = min(width, len(seq))
    return {tuple(seq[i:i + width]) for i in range(len(seq) - width + 1)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, least=10):
    """docs: (doc_id, text) -> list of (doc_id, n_lines, n_dropped, kept text)."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    owner = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k, o = key(line), LAST if d is None else d
            if len(k) >= least:
                owner[k] = min(owner.get(k, o), o)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == (LAST if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_counts(text):
    w, text = words(text), text or ""
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    places = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
    filled = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)), len(places))


def quality(docs, line_documents=20, line_percent=1.0, left=50):
    """docs: (doc_id, source, text) -> list of (doc_id, *base, base_failed, words_left, kept)."""
    normal = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    texts, first, host = defaultdict(set), {}, defaultdict(set)
    order = lambda d: LAST if d is None else d
    for d, s, t in docs:
        host[s].add(t)
        for line in (t or "").split("\n"):
            k = (s, normal(line))
            if k[1]:
                texts[k].add(t)
                first[k] = min(first.get(k, LAST), order(d))
    common = {k for k, v in texts.items() if len(v) > line_documents and 100 * len(v) > line_percent * len(host[k[0]])}
    out = []
    for d, s, t in docs:
        base = base_counts(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        lost = sum(len(normal(x).split(" ")) for x in (t or "").split("\n") if (s, normal(x)) in common and first[(s, normal(x))] != order(d))
        rest = max(0, base[0] - lost)
        out.append((d, *base, failed, rest, not failed and 100 * rest >= left * base[0]))
    return out


def near_components(docs, width, percent=80):
    """docs: (doc_id, text) with ids of their own -> {doc_id: (n_shingles, component)}."""
    sets = {d: shingles([w.translate(LOWER) for w in words(t)], width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    for a, s in sets.items():
        for b in {d for x in s for d in by[x]} if s else ():
            if a < b:
                both = len(s & sets[b])
                if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def plain(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)) if w]


def contained(docs, items, width=5, percent=80):
    out = []
    for d, t in docs:
        have = shingles(plain(t), width)
        for i, x in items:
            want = shingles(plain(x), width)
            if want and 100 * len(want & have) >= percent * len(want):
                out.append((d, i, len(want), len(want & have)))
    return out
