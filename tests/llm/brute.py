"""Plain Python versions of the operators' definitions, for small inputs."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(fold(text))


def licenses(text):
    w = words(text)
    found = []
    for phrase, label in (
        ("mit license", "mit"),
        ("apache license", "apache"),
        ("general public license", "gpl"),
    ):
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    labels = ",".join(sorted({k for _, k in found}))
    return len(w), len(found), min(at, default=None), max(at, default=None), labels


def luhn(digits):
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def pii(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def windows(text, n=10):
    w = words(text)
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def hits(text, items):
    """``items``: window -> item ids."""
    w = words(text)
    hit, found = set(), set()
    for k in {len(x) for x in items}:
        for i in range(len(w) - k + 1):
            ids = items.get(tuple(w[i : i + k]))
            if ids:
                hit.update(range(i, i + k))
                found |= ids
    return len(w), hit, found


def simhash(text):
    w = SPACED.findall(fold(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=2):
    """Component number of each fingerprint by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def word_shingles(text, length=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + length]) for i in range(max(len(w) - length + 1, 1))} if w else set()


def similar_kept(texts):
    """Smallest number of each class of texts that are equal or 0.8-similar, by all pairs."""
    sets = [word_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or (
                min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))
                and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            ):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in range(len(texts))})
