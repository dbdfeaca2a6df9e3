"""Plain sequential versions of the corpus operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, width, similarity=80):
    """``{doc_id: (n_shingles, component, kept)}`` of ``(doc_id, text)`` rows by counting shared shingles."""
    sets = {d: shingles(t, width) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    root = roots(sets, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def rule_counts(text):
    """Base counts of the quality rules, one definition at a time."""
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)
