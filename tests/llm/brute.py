"""Plain versions of the operators for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLACK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def repeat_runs(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(hashlib.md5(b[i : i + length]).digest() for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        runs = []
        for i in range(len(b) - length + 1):
            if seen[hashlib.md5(b[i : i + length]).digest()] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + length
                else:
                    runs.append([i, i + length])
        out.append((b, runs))
    return out


def cut(raw, runs):
    at, kept = 0, b""
    for a, b in runs:
        kept += raw[at:a]
        at = b
    return kept + raw[at:]


def repeats(rows, length=200):
    out = []
    for (doc_id, _), (raw, runs) in zip(rows, repeat_runs([t for _, t in rows], length)):
        out.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
    return sorted(out, key=repr)


def whole_characters(text, length_runs):
    """Text without the characters all of whose bytes are in the runs."""
    inside = set()
    for a, b in length_runs:
        inside.update(range(a, b))
    out, at = [], 0
    for c in text or "":
        size = len(c.encode())
        if not all(i in inside for i in range(at, at + size)):
            out.append(c)
        at += size
    return "".join(out)


def contamination(rows, items, window=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + window]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        words = WORD.findall(lower(text))
        hit, found = [0] * len(words), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if ids := windows.get(tuple(words[k : k + n])):
                    found |= ids
                    hit[k : k + n] = [1] * n
        out.append((doc_id, len(words), sum(hit), sorted(found)))
    return sorted(out, key=repr)


def simhash(text):
    import xxhash

    words = BLACK.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(rows, most=2):
    prints = [simhash(t) for _, t in rows]
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(root)
    for n, p in enumerate(distinct):
        for q in distinct[n + 1 :]:
            if (p ^ q).bit_count() <= most:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[find(p)] = min(least.get(find(p), doc_id), doc_id)
    return sorted(((i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints)), key=repr)
