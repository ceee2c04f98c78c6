"""Plain-Python statements of the operators' rules, for small tables."""

import hashlib
import math
import re
from collections import Counter

import xxhash

SPACE_WORD, ALNUM_WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(rows, window=35):
    """(doc_id, text) to {doc_id: (n_words, n_removed, kept_sha256)}; ids are distinct."""
    words = {i: SPACE_WORD.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contamination(rows, items, window=13):
    def split(t):
        return ALNUM_WORD.findall((t or "").translate(LOWER))

    wins = {}
    for item, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(found), sha(",".join(found)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def fingerprint(text, shingle=3):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits=3):
    """{id: fingerprint} to {id: smallest id reachable}."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def mixing_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """{source: words} to {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else unit * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    return target


MASK = 2**64 - 1


def spread(x):
    """The mixer of 64-bit hashes."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(word: bytes) -> int:
    total, power = 0, 1
    for b in word:
        total = (total + b * power) & MASK
        power = power * 0x9E3779B97F4A7C15 & MASK
    return spread((total + 1) & MASK)


def logistic(z):
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def toxicity_score(text, model, prefixes=(4, 5, 6)):
    """The logistic of bias and the weights of what a text has of words and their beginnings, by bytes."""
    found = set()
    for w in ALNUM_WORD.findall((text or "").translate(LOWER)):
        w = w.encode()
        found.add(word_hash(w))
        found |= {spread((word_hash(w[:n]) + n) & MASK) for n in prefixes if len(w) >= n}
    weight = dict(zip(model.chosen.tolist(), model.weights.tolist(), strict=True))
    return logistic(model.bias + sum(weight[f] for f in found if f in weight))


def symbols(text):
    """Letters, lower-cased; each run of others that follows a letter is one boundary, as is the end after a letter. Symbols are 16 bits of the code point."""
    out, before = [], False
    for c in text.lower() + "\n":
        if c.isalpha():
            out.append((ord(c) ^ (ord(c) >> 16) * 40503) & 0xFFFF)
        elif before:
            out.append(0)
        before = c.isalpha()
    return out


class KneserNey:
    """Interpolated Kneser-Ney of four symbols from a language's texts, by the book."""

    def __init__(self, texts, size):
        grams = Counter()
        for t in texts:
            s = [0, 0, 0, *symbols(t)]
            grams.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
        self.levels, self.size = [], size
        for order in (4, 3, 2, 1):
            once, twice = (sum(n == k for n in grams.values()) for k in (1, 2))
            discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
            total, follow = Counter(), Counter()
            for g, n in grams.items():
                total[g[:-1]] += n
                follow[g[:-1]] += 1
            self.levels.append((order, grams, total, follow, discount))
            grams = Counter(g[1:] for g in grams)  # continuations: a sequence counts once for each symbol before it

    def probability(self, gram, level=0):
        if level == 4:
            return 1 / self.size
        _, grams, total, follow, discount = self.levels[level]
        lower = self.probability(gram[1:], level + 1)
        if not total[gram[:-1]]:
            return lower
        return (max(0.0, grams[gram] - discount if gram in grams else 0.0) + discount * follow[gram[:-1]] * lower) / total[gram[:-1]]

    def entropy(self, text):
        s = [0, 0, 0, *symbols(text)]
        return -sum(math.log(self.probability(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) / (len(s) - 3)


def quality_score(text, chars, model, buckets):
    """A factorisation machine with all pairs of features written out, over plain counts of a text."""
    raw = (text or "").encode()
    words = [w.encode() for w in ALNUM_WORD.findall((text or "").translate(LOWER))]
    count = Counter(word_hash(w) >> 52 for w in words)
    norm = math.sqrt(sum(n * n for n in count.values()))
    x = {b: n / norm for b, n in count.items()}
    kind = lambda b: 3 if b in b"\t\n\v\f\r " else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 5 if b >= 128 else 4
    size, lines, n = max(1, len(raw)), raw.count(b"\n") + 1, max(1, len(words))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    stats = [math.log1p(len(raw)), *(sum(kind(b) == k for b in raw) / size for k in range(6))]
    stats += [sum(a == b and kind(b) == 4 for a, b in zip(raw, raw[1:], strict=False)) / size, math.log(size / lines), mean]
    stats += [math.sqrt(max(0.0, sum(v * v for v in lengths) / n - mean**2)), sum(v >= 15 for v in lengths) / n, sum(v <= 2 for v in lengths) / n]
    stats += [len(count) / n, norm**2 / n**2, raw.count(b"|") / size, math.log1p(len(words)), math.log1p(max(0, chars)) if chars is not None else 0.0]
    for k, v in enumerate(stats):
        z = ((v if raw else 0.0) - model.centre[k]) / model.spread[k]
        x[buckets + k] = max(-4.0, min(4.0, z))
    pairs = sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for i in x for j in x if i < j)
    return logistic(model.bias + sum(model.weights[i] * v for i, v in x.items()) + pairs)


def components(nodes, edges):
    """The smallest node that each node reaches."""
    near: dict = {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    root: dict = {}
    for n in sorted(nodes):
        todo = [] if n in root else [n]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += near[x]
    return root
