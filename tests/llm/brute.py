"""Plain answers for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE.findall(text or "")


def plain(text):
    return PLAIN.findall(lower(text))


def license_base(text):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    w, starts, labels = plain(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_base(text):
    found = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def substrings(rows, size=50):
    first = {}
    for doc, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1 if doc is not None else 0):
            p = tuple(w[k : k + size])
            first[p] = min(first.get(p, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1 if doc is not None else 0):
            if first[tuple(w[k : k + size])] < doc:
                gone |= set(range(k, k + size))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def leaks(rows, items, size=10):
    patterns = defaultdict(set)
    for item, text in items:
        w = plain(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in rows:
        w, hit, held = plain(text), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in patterns:
                    hit |= set(range(k, k + n))
                    held |= patterns[p]
        ids = sorted(str(i) for i in held if i is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def quality(text):
    w, gone = words(text), set()
    five = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    for k in range(len(w) - 4):
        if five[tuple(w[k : k + 5])] > 1:
            gone |= set(range(k, k + 5))
    lines = [line for line in (text or "").split("\n") if words(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 10 or 100 * len(gone) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(gone), failed


def simhash(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows, radius=3, survivors=False):
    prints = sorted({simhash(t) for _, t in rows})
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= radius:
                group[root(p)] = root(q)
    smallest = {}
    for doc, text in rows:
        g = root(simhash(text))
        if doc is not None:
            smallest[g] = min(doc, smallest.get(g, doc))
    if survivors:
        return [smallest.get(g) for g in {root(p) for p in prints}]
    return [(doc, f"{simhash(t):016x}", smallest.get(root(simhash(t)))) for doc, t in rows]
