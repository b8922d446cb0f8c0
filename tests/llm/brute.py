"""Plain versions of the contracts, in one process, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_duplicates(rows, k, percent=80):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text)."""
    sets = {d: shingles(t, k) for d, t in rows}
    has = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            has[x].append(d)
    pairs = {p for ds in has.values() for p in combinations(sorted(ds), 2)}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def line_dedup(rows, min_chars=40, min_docs=5):
    """{doc_id: (n_lines, n_dropped, kept_text)}."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    holds = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holds[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holds.get(key(x), ())) >= min_docs and d != max(holds[key(x)]))]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def edited(rows):
    """{doc_id: (n_chars, sha256 of the edited text, edited text, next text)}."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), e, after)
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    """(counts by kind, spans string)."""
    spans, n = [], Counter()
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and _luhn(d))
                    or (kind == "phone" and 10 <= len(d) <= 15)):
                spans.append((m.start(), k, m.end()))
                n[kind] += 1
    return n, ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in sorted(spans))


def coverage(item, words, least):
    """Share of an item's words under greedy tiles, by trying all pairs of places."""
    ma, mb, total = [False] * len(item), [False] * len(words), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(words)):
                k = 0
                while i + k < len(item) and j + k < len(words) and item[i + k] == words[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return total / len(item)
        ma[i : i + k] = [True] * k
        mb[j : j + k] = [True] * k
        total += k
