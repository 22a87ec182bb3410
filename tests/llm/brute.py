"""Plain single-process versions of what the text queries compute."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def secrets(text):
    text = text or ""
    out = []
    letters = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "")
    names = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(letters + "(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    n = [sum(k == i for _, k, _ in out) for i in range(3)]
    return (*n, sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out))))


def contamination(texts, items):
    words = lambda t: ITEM_WORD.findall((t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            n = min(13, len(w))
            for a in range(len(w) - n + 1):
                wins[tuple(w[a : a + n])].add(i)
    sizes = {len(w) for w in wins}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[a : a + n]))) is not None:
                    hit.update(range(a, a + n))
                    found |= own
        found.discard(None)
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def quality(text):
    text = text or ""
    w = WS.findall(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    at = defaultdict(list)
    for a in range(len(w) - 7):
        at[tuple(w[a : a + 8])].append(a)
    rep = {x for s in at.values() if len(s) > 1 for a in s for x in range(a, a + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def fingerprint(text):
    w = WS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[a : a + 3]) for a in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    fp = {i: fingerprint(t) for i, t in rows}
    parent = {f: f for f in fp.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(sorted(parent), np.uint64)
    for x in u:
        for y in u[np.bitwise_count(u ^ x) <= 2]:
            parent[root(int(x))] = root(int(y))
    least = {}
    for i, f in fp.items():
        r = root(f)
        least[r] = min(least.get(r, i), i)
    return {i: (f"{f:016x}", least[root(f)]) for i, f in fp.items()}


def line_dedup(texts, min_docs=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    df = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not key(x) or df[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def guess_cost(v, costs):
    """The cheapest of all segmentations, each segment priced by its definition; costs: the module with the prices."""
    low, n = v.lower(), len(v)
    plain = low.translate(costs.LEET)

    def segment(a, e):
        k = e - a
        out = [sum(map(costs.brute_cost, v[a:e]))]
        if (c := costs.word_cost_of(v, low, plain, a, e, costs.WORD_COST)) is not None:
            out.append(c)
        if k >= 3 and len(set(low[a:e])) == 1:
            out.append(costs.brute_cost(v[a]) + costs.repeat_cost(k))
        if k >= 3 and all(pair in costs.NEXT for pair in zip(low[a:e], low[a + 1 : e])):
            out.append(costs.walk_cost(k))
        if costs.DATE.fullmatch(v, a, e):
            out.append(costs.date_cost(k))
        for p in range(2, a + 1):  # copies of the block that ends at a, itself no repeat
            if k % p == 0 and (low[a - p : a] * 2).find(low[a - p : a], 1) == p and all(low[x] == low[x - p] for x in range(a, e)):
                out.append(costs.repeat_cost(k // p + 1))
        return min(out) + costs.SEGMENT

    best = [0.0]
    for e in range(1, n + 1):
        best.append(min(best[a] + segment(a, e) for a in range(e)))
    return best[n]


def license_units(text, units, k=5, share=0.8):
    """Places and names of all windows that hold `share` of a unit's shingles: {unit: {first words}}."""
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))
    out = defaultdict(set)
    grams = lambda w: {tuple(x.encode() for x in w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    for u, (_, size, own) in enumerate(units):
        for a in range(max(1, len(words) - size + 1)):
            if len(grams(words[a : a + size]) & own) >= share * len(own):
                out[u].add(a)
    return out
