"""Plain versions of the operators, for small tables."""
import re
from itertools import combinations

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    words = SPACED.findall(lower(text))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_components(docs, percent):
    """doc_id -> smallest reachable id; docs: {id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def without_repeats(rows, size=13):
    """(id, kept words, all words) for each (id, text) row."""
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for at in range(len(w) - size + 1):
            key = tuple(w[at:at + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - size + 1):
            if i is not None and first[tuple(w[at:at + size])] < i:
                gone.update(range(at, at + size))
        out.append((i, [x for at, x in enumerate(w) if at not in gone], w))
    return out


def hits(text, items, size=13):
    """(words, hit word positions, items found) of a text; items: [(id, text)]."""
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = ALNUM.findall(lower(t))
        n = min(size, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == w[at:at + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return words, hit, found
