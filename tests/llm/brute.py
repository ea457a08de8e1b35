"""Plain single-process versions of the operators, for tables of a few hundred rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeated_words(docs, k=20):
    """{doc_id: (n_words, n_removed, digest)}"""
    seen, gone, cut = set(), defaultdict(set), {}
    for doc, text in sorted(docs.items()):
        cut[doc] = words(text)
        for i in range(len(cut[doc]) - k + 1):
            run = tuple(cut[doc][i : i + k])
            if run in seen:
                gone[doc].update(range(i, i + k))
            seen.add(run)
    return {
        d: (len(w), len(gone[d]), sha(" ".join(x for i, x in enumerate(w) if i not in gone[d]))) for d, w in cut.items()
    }


def secrets(text):
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [
        (m.start(), 0, m.end()) for m in re.finditer(pattern, text or "", re.IGNORECASE | re.ASCII) if len(m[2]) >= 12
    ]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def line_key(line):
    return line.strip(BLANKS).translate(ASCII_LOWER)


def common_lines(docs, min_docs=10):
    """{doc_id: (n_lines, n_dropped, digest)}, {doc_id: kept text}"""
    where = defaultdict(set)
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            where[line_key(line)].add(doc)
    out, kept = {}, {}
    for doc, text in docs.items():
        lines = (text or "").split("\n")
        stay = [x for x in lines if not line_key(x) or len(where[line_key(x)]) < min_docs]
        kept[doc] = "\n".join(stay)
        out[doc] = (len(lines), len(lines) - len(stay), sha(kept[doc]))
    return out, kept


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, digest, contaminated)}"""
    def cut(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    runs = defaultdict(set)
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            runs[tuple(w[i : i + n])].add(str(item))
    sizes = {len(r) for r in runs}
    out = {}
    for doc, text in docs.items():
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in runs:
                    hit.update(range(i, i + n))
                    found |= runs[tuple(w[i : i + n])]
        bad = bool(hit) and 20 * len(hit) >= len(w)
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bad)
    return out


def roots(ids, links):
    up = {x: x for x in ids}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in ids}


def shingles(text, n=2):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_copies(docs, n=2):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t, n) for d, t in docs.items()}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids) for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b]))
        and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {d: (len(sets[d]), c) for d, c in roots(ids, links).items()}


def near_vectors(rows, threshold=0.93):
    """{vec_id: (n_links, component_id)} of (vec_id, label, vector)."""
    unit = {}
    for vec_id, label, vector in rows:
        if label is not None and vector and None not in vector and np.isfinite(vector).all() and any(vector):
            x = np.array(vector, float) / np.abs(vector).max()
            unit[vec_id] = (label, x / np.linalg.norm(x))
    ids, links, counts = sorted(unit), [], Counter()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, x), (lb, y) = unit[a], unit[b]
            if la == lb and len(x) == len(y) and float(x @ y) >= threshold:
                links.append((a, b))
                counts.update((a, b))
    found = roots([r[0] for r in rows], links)
    return {v: (counts[v], c) for v, c in found.items()}


def text_scores(docs, prior=4.0):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score, score)}"""
    tokens = {d: words(lower(t)) + [None] for d, t in docs.items()}
    train = [d for d in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    one = Counter(w for d in train for w in tokens[d])
    total, distinct = sum(one.values()), len(one)
    pairs, before = Counter(), Counter()
    for d in train:
        for a, b in zip([0, *tokens[d]], tokens[d]):
            pairs[a, b] += 1
            before[a] += 1

    def share(w):
        return (one[w] + 0.5) / (total + 0.5 * (distinct + 1))

    out = {}
    for d, own in tokens.items():
        full = sum(math.log10((pairs[a, b] + prior * share(b)) / (before[a] + prior)) for a, b in zip([0, *own], own))
        base = sum(math.log10(share(w)) for w in own)
        out[d] = (len(own), sum(one[w] > 0 for w in own), total, base, full)
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns for m in re.finditer(p, text or "") if valid(k, m[0])]
