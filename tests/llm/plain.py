"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO_ID = -(1 << 63)


def order(rows):
    """(doc_id, text) in document order; rows equal in both are one document."""
    return sorted({(NO_ID if i is None else i, t or "") for i, t in rows})


def earlier_words(rows, size):
    """Per (doc_id, text): words and which of them a window that stands earlier covers."""
    first, out = set(), {}
    for i, text in order(rows):
        words = WORD.findall(text.encode())
        gone = [False] * len(words)
        for j in range(len(words) - size + 1):
            window = tuple(words[j : j + size])
            if window in first:
                gone[j : j + size] = [True] * size
            first.add(window)
        out[i, text] = words, gone
    return out


def shared_bytes(rows, size):
    count = Counter(raw[j : j + size] for _, t in order(rows) for raw in [t.encode()] for j in range(len(raw) - size + 1))
    out = {}
    for i, text in order(rows):
        raw = text.encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - size + 1):
            if count[raw[j : j + size]] > 1:
                gone[j : j + size] = [True] * size
        out[i, text] = raw, gone
    return out


def shingles(text):
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4))


def components(rows):
    """Per (doc_id, text): set size, the smallest id reachable over links, and the component's number."""
    nodes = order(rows)
    sets = [shingles(t) for _, t in nodes]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in lists[x])
        for x in s:
            lists[x].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {node: (len(sets[i]), nodes[root(i)][0], root(i)) for i, node in enumerate(nodes)}


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)
