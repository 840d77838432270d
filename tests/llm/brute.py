"""Plain versions of the operators, for small tables. They share no code with them."""

import hashlib
import re

import numpy as np

SPACE = re.compile(r"[ \t-\r]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def roots(n, links):
    """The smallest member of each one's component."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def similar_pairs(sets, threshold=0.8):
    """Pairs of sets with a Jaccard similarity of ``threshold`` or more, by a matrix of all against all."""
    names = {x: k for k, x in enumerate({x for s in sets for x in s})}
    m = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[x] for x in s]] = 1
    size = m.sum(1)
    both = m @ m.T
    alike = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    return [(i, j) for i, j in np.argwhere(alike).tolist() if i < j]


def character_shingles(line, n=5):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def fuzzy_lines(docs):
    """{row index: numbers of removed lines} of rows (id, text)."""
    distinct, at = {}, []
    for row, (i, t) in enumerate(docs):
        for k, raw in enumerate(t.split("\n") if t is not None else []):
            line = raw.strip(" ").lower()
            if words(line):
                at.append(((float("inf") if i is None else i, t), k, distinct.setdefault(line, len(distinct)), row))
    root = roots(len(distinct), similar_pairs([character_shingles(x) for x in distinct]))
    first, gone = {}, {}
    for place, k, line, _ in at:
        c = root[line]
        first[c] = min(first.get(c, (place, k)), (place, k))
    for place, k, line, row in at:
        if (place, k) != first[root[line]]:
            gone.setdefault(row, []).append(k)
    return gone


def without_lines(docs):
    gone = fuzzy_lines(docs)
    cut = lambda t, g: t if t is None or not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
    return [(i, cut(t, set(gone.get(r, ())))) for r, (i, t) in enumerate(docs)]


def fingerprint(text):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_pairs(prints, bits=4):
    x = np.array(prints, np.uint64)
    return [(i, j) for i, j in np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits).tolist() if i < j]


def word_shingles(text, n=5):
    w = words((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def without_near_copies(docs):
    """Of each group the row with the smallest id."""
    pairs = near_pairs([fingerprint(t) for _, t in docs])
    some = [k for k, (_, t) in enumerate(docs) if words(t)]
    pairs += [(some[a], some[b]) for a, b in similar_pairs([word_shingles(docs[k][1]) for k in some])]
    root = roots(len(docs), pairs)
    best = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            best[root[k]] = min(best.get(root[k], i), i)
    return [(i, t) for k, (i, t) in enumerate(docs) if i is None or best[root[k]] == i]


def repeats(docs, span=50):
    """(id, bytes, removed, spans, kept) of rows (id, text)."""
    first = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for i, t in data:
        for p in range(len(t) - span + 1):
            w = t[p : p + span]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = True
        kept = np.frombuffer(t, np.uint8)[~gone[: len(t)]].tobytes()
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def item_words(text):
    return words("".join(" " if c in PUNCTUATION else c.lower() if c.isascii() else c for c in text or ""))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def leaks(text, item, full=0.75, part=0.55, window=64):
    """Whether the item is in any region of the text, at each place."""
    t, w = item_words(text), item_words(item)
    if not w:
        return False
    wide = window + 2 * len(w)
    for at in range(0, max(1, len(t) - wide + 1 + wide // 4), max(1, wide // 4)):
        region = t[at : at + wide]
        share = common(w, region) / len(w)
        if (share == 1) if len(w) < 8 else share >= full or share >= part and common(w[-5:], region) == len(w[-5:]):
            return True
    return False


def language_model(rows, steps=40):
    """Log10 probabilities of (training, deleted, text) rows: bigrams, unigrams and a uniform share, weights by context bucket, EM without cells."""
    from collections import Counter

    tokens = [[*words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), 0] for _, _, t in rows]  # 0: the end

    def counts(use):
        uni, bi = Counter(), Counter()
        for (train, deleted, _), tk in zip(rows, tokens, strict=True):
            if use(train, deleted):
                uni.update(tk)
                bi.update(zip([0, *tk[:-1]], tk, strict=True))  # the start occurs as often as the end
        return uni, bi

    def bucket(n):
        return n.bit_length()

    uni, bi = counts(lambda train, deleted: train and not deleted)
    n, v = sum(uni.values()), len(uni)
    held = [(bucket(uni[a]), bi[a, b] / max(uni[a], 1), uni[b] / max(n, 1)) for (train, deleted, _), tk in zip(rows, tokens, strict=True) if train and deleted for a, b in zip([0, *tk[:-1]], tk, strict=True)]
    weights = {}
    for k in {h[0] for h in held} | {None}:
        p = np.array([(x, y, 1 / (v + 1)) for c, x, y in held if k is None or c == k]).reshape(-1, 3)
        w = np.full(3, 1 / 3)
        for _ in range(steps if len(p) else 0):
            share = w * p
            w = (share / share.sum(1, keepdims=True)).mean(0)
        weights[k] = w
    uni, bi = counts(lambda train, deleted: train)
    n, v = sum(uni.values()), len(uni)
    out = []
    for tk in tokens:
        total = 0.0
        for a, b in zip([0, *tk[:-1]], tk, strict=True):
            w = np.maximum(weights.get(bucket(uni[a]), weights[None]), 1e-6)
            if not uni[a]:
                w = np.array([0, w[1], w[2]])
            w = w / w.sum()
            total += np.log10(w[0] * bi[a, b] / max(uni[a], 1) + w[1] * uni[b] / n + w[2] / (v + 1))
        out.append(total)
    return out
