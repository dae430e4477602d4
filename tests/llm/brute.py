"""Plain Python versions of the registered queries' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, share=85):
    sets = {}
    for i, text in rows:
        w = SPACED.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = defaultdict(int)
    for own in holders.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n)]
    of = components(sets, links)
    return {i: (len(sets[i]), of[i], of[i] == i) for i in sets}


def contamination(rows, items, window=10):
    found = defaultdict(set)
    for i, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            found[tuple(w[k : k + m])].add(i)
    sizes = {len(x) for x in found}
    out = {}
    for i, text in rows:
        w = PLAIN.findall((text or "").translate(LOWER))
        hit, own = set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if t := found.get(tuple(w[k : k + m])):
                    own |= t
                    hit.update(range(k, k + m))
        out[i] = (len(w), len(hit), len(own), sha(",".join(sorted(map(str, own)))), bool(hit))
    return out


def line_dedup(rows, least=40, documents=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < documents or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def substrings(rows, window=50):
    words = {i: SPACED.findall(text or "") for i, text in rows}
    first: dict = {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(rows):
    out = {}
    for i, text in rows:
        w = PLAIN.findall((text or "").translate(LOWER))
        places, labels = [], set()
        for p, label in PHRASES.items():
            p = p.split(" ")
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            if at:
                labels.add(label)
        out[i] = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    return out


def embeddings(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            good[i] = (label, x / np.linalg.norm(x))
    links, n = [], defaultdict(int)
    by = defaultdict(list)
    for i, (label, v) in good.items():
        by[label, len(v)].append((i, v))
    for own in by.values():
        m = np.stack([v for _, v in own])
        hit = m @ m.T >= threshold
        for x, y in zip(*np.nonzero(hit)):
            if x != y:
                n[own[x][0]] += 1
                links.append((own[x][0], own[y][0]))
    of = components([r[0] for r in rows], links)
    return {r[0]: (n[r[0]], of[r[0]], of[r[0]] == r[0]) for r in rows}
