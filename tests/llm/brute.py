"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = str.maketrans(UPPER, LOWER)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k:k + n])].add("" if i is None else str(i))
    out = Counter()
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d, len(w), len(hit), len(found), sha, bool(hit)] += 1
    return out


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def near_classes(docs, threshold=0.8):
    """(doc_id, class_id, n_links) of every row, over all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return Counter((d, low.get(root(i)), links[i]) for i, (d, _) in enumerate(docs))


def base_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    repeat = len({k + j for k in range(len(w) - 4) if win[tuple(w[k:k + 5])] > 1 for j in range(5)})
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            repeat, len(w) < 10 or 100 * repeat > 20 * len(w))


BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_licences(text):
    w, at, labels = words(text), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def all_licences(text, templates, cover):
    """Labels, score and alignments by comparing every template at every place."""
    w, labels, score, at = words(text), set(), 0.0, []
    for t in templates:
        n, key = len(t["words"]), range(t["key_at"], t["key_at"] + t["key_n"])
        for start in range(-n, len(w)):
            same = [0 <= start + i < len(w) and w[start + i] == x for i, x in enumerate(t["words"])]
            share = sum(same) / n
            if all(same[i] for i in key) and share >= (1 if t["base"] else cover):
                labels.add(t["label"])
                score = max(score, share)
                at.append((t["label"], start, start + n - 1, share))
    return ",".join(sorted(labels)), score, sorted(at)
