"""Plain, slow versions of the contracts' columns, written apart from the operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def spans_text(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in spans))


def licenses(text):
    words = PLAIN_WORD.findall(low(text))
    hits = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"),
                          ("mit license", "mit")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def secrets(text):
    text, found = text or "", []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k)
                   for k in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            found.append(("assign", *m.span()))
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    n = Counter(k for k, _, _ in found)
    return n["assign"], n["access"], n["hex"], sha(spans_text(found, ["assign", "access", "hex"]))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    text, found = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    kinds = ["email", "ip", "card", "phone"]
    n = Counter(k for k, _, _ in found)
    return (*(n[k] for k in kinds), sha(spans_text(found, kinds)))


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)})
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if SPACE_WORD.search(x):
            dup += x in seen
            seen.add(x)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, repeat,
            len(words) < 50 or 100 * repeat > 50 * len(words))


def fingerprint(text):
    words = SPACE_WORD.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, most=3):
    """rows of (id, text) -> (fingerprints, a number for each row's group)."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, f in enumerate(distinct):
        for g in distinct[:i]:
            if (f ^ g).bit_count() <= most:
                root[find(f)] = find(g)
    return prints, [find(f) for f in prints]


def components(rows, most=3):
    """rows of (id, text) -> list of (id, hex fingerprint, component)."""
    prints, of = groups(rows, most)
    ids = defaultdict(list)
    for (i, _), g in zip(rows, of):
        if i is not None:
            ids[g].append(i)
    return [(i, f"{f:016x}", min(ids[g], default=None)) for (i, _), f, g in zip(rows, prints, of)]


def contamination(rows, items, window=10):
    wanted = defaultdict(set)
    for item, text in items:
        words = PLAIN_WORD.findall(low(text))
        if words:
            for i in range(max(1, len(words) - window + 1)):
                wanted[tuple(words[i:i + window])] |= set() if item is None else {str(item)}
    sizes = {len(p) for p in wanted}
    out = []
    for ident, text in rows:
        words, hit, found = PLAIN_WORD.findall(low(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                got = wanted.get(tuple(words[i:i + n]))
                if got is not None:
                    found |= got
                    hit |= set(range(i, i + n))
        out.append((ident, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """{source: words} -> {source: target}, by resharing round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, budget = {s: 0.0 for s in names}, set(names), share * sum(sizes.values())
    while free and budget > 1e-9:
        total = sum(weight[s] for s in free)
        full = {s for s in free if budget * weight[s] / total >= most * sizes[s]}
        if not full:
            for s in free:
                target[s] = budget * weight[s] / total
            break
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
        free -= full
    assert all(math.isfinite(x) for x in target.values())
    return target
