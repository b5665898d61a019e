"""Plain Python versions of the operators, and small texts to try them on."""

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def texts(seed=1, n=40, words=60, vocabulary=40):
    """Random texts with copies, near copies, shared passages, odd ones and nulls."""
    rnd = random.Random(seed)
    names = [f"w{i}" if i % 7 else f"Ä{i}é" for i in range(vocabulary)]
    passage = [rnd.choice(names) for _ in range(25)]
    out = []
    for i in range(n):
        own = [rnd.choice(names) for _ in range(rnd.randrange(words))]
        if i % 5 == 1:
            own[len(own) // 2:len(own) // 2] = passage
        out.append(rnd.choice([" ", "  ", "\n", "\t"]).join(own))
    for i in range(n // 4):
        out.append(out[i * 2])
        near = out[i * 2 + 1].split(" ")
        if len(near) > 1:
            near[rnd.randrange(len(near))] = "edit"
        out.append(" ".join(near))
    return [*out, None, "", " ", "\n\n", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "a b\nb c\nc d\na b\nb c\nc d", " ".join(passage * 4)]


def contamination(docs, items, window=10):
    tests = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if w else 0):
            tests[tuple(w[p:p + n])].add(str(item))
    out = []
    for key, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in {len(t) for t in tests}:
            for p in range(len(w) - n + 1):
                if (t := tuple(w[p:p + n])) in tests:
                    hit |= set(range(p, p + n))
                    found |= tests[t]
        out.append((key, len(w), len(hit), sorted(found)))
    return out


def near(docs, percent=75):
    sets = []
    for _, text in docs:
        w = SPACE.findall(lower(text))
        sets.append({tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(docs)]


def passages(docs, edge):
    first = {}
    for key, text in docs:
        w = SPACE.findall(text or "")
        for p in range(len(w) - edge + 1):
            t = tuple(w[p:p + edge])
            first[t] = min(first.get(t, key), key)
    out = []
    for key, text in docs:
        w = SPACE.findall(text or "")
        gone = {q for p in range(len(w) - edge + 1) if first[tuple(w[p:p + edge])] < key for q in range(p, p + edge)}
        out.append((key, len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone))))
    return out


def substrings(docs, length):
    data = [(text or "").encode() for _, text in docs]
    count = Counter(b[p:p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(docs, data, strict=True):
        gone = {q for p in range(len(b) - length + 1) if count[b[p:p + length]] > 1 for q in range(p, p + length)}
        spans = sum(q - 1 not in gone for q in gone)
        out.append((key, len(b), len(gone), spans, sha(bytes(x for q, x in enumerate(b) if q not in gone))))
    return out


def lines(docs):
    first = {}
    for key, text in sorted(docs, key=lambda d: d[0]):
        ls = (text or "").split("\n")
        for p in range(len(ls) - 2):
            first.setdefault(tuple(ls[p:p + 3]), (key, p))
    out = []
    for key, text in docs:
        ls = (text or "").split("\n")
        gone = {q for p in range(len(ls) - 2) if first[tuple(ls[p:p + 3])] != (key, p) for q in range(p, p + 3)}
        out.append((key, None if text is None else "\n".join(x for q, x in enumerate(ls) if q not in gone), len(ls), len(gone)))
    return out
