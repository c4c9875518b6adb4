"""Plain definitions that the operators are held against."""

import re

import xxhash

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PIECE = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return _WORD.findall((t or "").translate(_LOWER))


def pieces(t):
    return _PIECE.findall(t or "")


def contamination(docs, items, n=10):
    """docs, items: lists of (id, text)."""
    wins = []
    for i, t in items:
        w = words(t)
        if w:
            k = min(n, len(w))
            wins += [(i, tuple(w[a : a + k])) for a in range(len(w) - k + 1)]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[a : a + 3]) for a in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits=3):
    """Smallest member of each value's component."""
    up = list(range(len(prints)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(prints))]


def rule_base(t):
    w = pieces(t)
    text = t or ""
    lines = [x for x in text.split("\n") if _PIECE.search(x)]
    grams = [tuple(w[a : a + 3]) for a in range(len(w) - 2)]
    again = {g for g in grams if grams.count(g) > 1}
    rep = {p for a, g in enumerate(grams) if g in again for p in range(a, a + 3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))


def phrase_places(t, phrases):
    w, out = words(t), []
    for p, label in phrases.items():
        q = p.split()
        out += [(a, label) for a in range(len(w) - len(q) + 1) if w[a : a + len(q)] == q]
    return len(w), out
