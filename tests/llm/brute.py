"""Plain versions of the operators over (doc_id, text) pairs, for comparison on small data."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def cut_substrings(docs, length=50):
    """Rows of equal id do not count against each other; null ids take no part."""
    seen: dict[bytes, int] = {}
    for i, text in docs:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            if i is not None:
                w = raw[k:k + length]
                seen[w] = min(seen.get(w, i), i)
    out = []
    for i, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if i is not None and seen[raw[k:k + length]] < i:
                gone[k:k + length] = b"\x01" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def shingle_set(text):
    words = SPACED.findall((text or "").translate(LOW))
    if len(words) >= 5:
        return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def linked(docs):
    """(id, set size, component) with distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < 80 * large:
                continue
            met = len(sets[a] & sets[b])
            if 100 * met >= 80 * (len(sets[a]) + len(sets[b]) - met):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for item, text in items:
        words = PLAIN.findall((text or "").translate(LOW))
        if words:
            for k in range(max(len(words) - size, 0) + 1):
                windows[tuple(words[k:k + size])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words = PLAIN.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                w = tuple(words[k:k + n])
                if w in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(words), len(hit), len(found), sha(names), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def measures(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            twice += line in seen
            seen.add(line)
    count = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if count[tuple(words[k:k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(inside)


def cut_lines(docs, least=20, most=3):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOW)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < most or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out
