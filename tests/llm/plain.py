"""The pipeline's stages by their definitions, in plain Python over lists: nothing here is shared with the operators but their constants."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash

from peptora.llm import packing, quality, resemblance, toxicity

U64 = (1 << 64) - 1


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def sampled(docs, labels, modulus, held):
    """doc_id to (text, label), for samples that no bound cuts. docs: (doc_id, text); labels: (doc_id, 0, 1 or None)."""
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and fold(i, modulus) != held:
            known[i] = max(known.get(i, 0), y)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    return {i: (min(texts[i]), y) for i, y in known.items() if i in texts}


# Quality: hashed grams, FTRL weight by weight


def grams(text):
    tokens = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20]+", (text or "").encode())
    one = [xxhash.xxh3_64_intdigest(t) for t in tokens]
    two = [(a * 0x9E3779B97F4A7C15 & U64 ^ b) * 0xD6E8FEB86659FD93 & U64 for a, b in zip(one, one[1:])]
    n = Counter(x >> 64 - quality.BITS for x in one + two)
    size = math.sqrt(sum(n.values()))
    return {k: math.sqrt(v) / size for k, v in n.items()}


def ftrl(rows):
    """Weights by slot (None: the intercept) after EPOCHS passes."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        l1 = 0.0 if k is None else quality.L1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in rows:
            x = {**x, None: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                n[k] += g * g
    return {k: weight(k) for k in list(z)}


def quality_scores(docs, labels):
    rows = sampled(docs, labels, quality.MODULUS, quality.HELD)
    shards = [[] for _ in range(quality.SHARDS)]
    for i in sorted(rows, key=lambda i: xxhash.xxh3_64_intdigest(str(i))):
        shards[struct.unpack("<q", xxhash.xxh64_digest(struct.pack("<q", i), 42)[::-1])[0] % quality.SHARDS].append((grams(rows[i][0]), rows[i][1]))
    weights = Counter()
    for s in shards:
        for k, w in ftrl(s).items():
            weights[k] += w / quality.SHARDS
    return [1 / (1 + math.exp(-(weights[None] + sum(weights[k] * v for k, v in grams(t).items())))) for _, t in docs]


# Toxicity: counts of expressions by class, those that tell, and their discounted and backed-off chances


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def minima(text):
    w = words(text)
    h = [xxhash.xxh3_64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))]
    turns = [(k * 0x9E3779B97F4A7C15 & U64) | 1 for k in range(1, 2 * toxicity.MINIMA, 2)]
    return [(at, min((x ^ x >> 29) * t & U64 for x in h)) for at, t in enumerate(turns)]


def toxic_evidence(rows):
    """The function from a text to its evidence, learnt from (text, label)."""
    n, d, docs = (Counter(), Counter()), (Counter(), Counter()), Counter(y for _, y in rows)
    pairs = set()
    for t, y in rows:
        w = words(t)
        found = Counter(w) + Counter(x[:k] + "*" for x in w for k in toxicity.BEGINNINGS if len(x) > k) + Counter(map(" ".join, zip(w, w[1:])))
        n[y].update(found)
        d[y].update(found.keys())
        pairs |= set(zip(w, w[1:]))
    every = n[0].keys() | n[1].keys()
    if not docs[0] or not docs[1]:
        return lambda t: 0.0
    share = docs[1] / (docs[0] + docs[1])
    bar = math.log(len(every) / toxicity.RISK)

    def tells(e):
        q, both = d[1][e] / (d[0][e] + d[1][e]), d[0][e] + d[1][e]
        bent = (q * math.log(q / share) if q else 0) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0)
        times = (d[1][e] + 0.5) * docs[0] / ((d[0][e] + 0.5) * docs[1])
        return both * bent > bar and (times >= toxicity.RATIO or times <= 1 / toxicity.RATIO)

    seen = {e: (n[0][e], n[1][e]) for e in every if tells(e)}
    single = [e for e in every if " " not in e and "*" not in e]
    size = [sum(n[c][e] for e in single) for c in (0, 1)]
    kinds, types, after = len(single), len(pairs), Counter(b for _, b in pairs)
    shared = lambda e: (after[e] + 1) / (types + kinds + 1)
    own = {e: seen[e] for e in seen if " " not in e and "*" not in e}
    for e in sorted((e for e in seen if "*" in e), key=len, reverse=True):
        under = [x for w, x in own.items() if w.rstrip("*").startswith(e[:-1]) and len(w) > len(e[:-1])]
        left = tuple(max(seen[e][c] - sum(x[c] for x in under), 0.0) for c in (0, 1))
        if sum(left) >= 5 and max(left) >= toxicity.RATIO * min(left):
            own[e] = left
    kept = {e: [max(x[c] - toxicity.DISCOUNT, 0.0) / size[c] for c in (0, 1)] for e, x in own.items()}
    free = [max(1 - sum(p[c] for p in kept.values()), 1e-9) for c in (0, 1)]
    chance = lambda e, c: kept[e][c] + free[c] * shared(e)
    plain = math.log(free[1] / free[0])

    def value(w):
        for e in (w, *(w[:k] + "*" for k in toxicity.BEGINNINGS if len(w) > k)):
            if e in kept:
                return math.log(chance(e, 1) / chance(e, 0))
        return plain

    told = {e for e in seen if " " in e and all(value(w) == plain for w in e.split(" "))}
    head = {e.split(" ")[0] for e in told}
    part = lambda e, c: max(seen[e][c] - toxicity.DISCOUNT, 0.0) / max(n[c][e.split(" ")[0]], 1)
    rest = {h: [max(1 - sum(part(e, c) for e in told if e.split(" ")[0] == h), 1e-9) for c in (0, 1)] for h in head}

    def evidence(text):
        w = words(text)
        total = sum(map(value, w))
        for h, x in zip(w, w[1:]):
            e = f"{h} {x}"
            if e in told:
                p = [part(e, c) + rest[h][c] * free[c] * shared(e) for c in (0, 1)]
                total += math.log(p[1] / p[0]) - value(x)
            elif h in head:
                total += math.log(rest[h][1] / rest[h][0])
        return total / len(w) if w else 0.0

    return evidence


def toxic_scores(docs, labels):
    rows = sampled(docs, labels, toxicity.MODULUS, toxicity.HELD)
    marks = defaultdict(list)
    for i, (t, _) in rows.items():
        for m in minima(t):
            marks[m].append(i)
    copies = {i for ids in marks.values() for i in ids if i > min(ids)}
    rows = {i: x for i, x in rows.items() if i not in copies}
    evidence = toxic_evidence([x for i, x in rows.items() if fold(i, toxicity.MODULUS) != toxicity.TUNING])
    tuning = sorted((evidence(t), y) for i, (t, y) in rows.items() if fold(i, toxicity.MODULUS) == toxicity.TUNING)
    xs = [x for x, _ in tuning]
    edges = [xs[0] - 1, *xs, xs[-1] + 1]
    wrong = lambda k: sum(y == 1 for _, y in tuning[:k]) + sum(y == 0 for _, y in tuning[k:])
    at = min((k for k in range(len(xs) + 1) if edges[k] < edges[k + 1]), key=lambda k: (wrong(k), k))
    threshold = (edges[at] + edges[at + 1]) / 2
    above = [x for x in xs if x > threshold]
    scale = max(1e-4, (float(np.median(above)) - threshold) / 4) if above else 1e-4
    return [1 / (1 + math.exp(-max(-500, min(500, (evidence(t) - threshold) / scale)))) for _, t in docs]


# Near copies, repeated passages, packing


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_of_copies(docs):
    """Places of the rows that stay: of texts connected by a Jaccard index of LEAST the row with the least doc_id, null last."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in docs:
        w = ascii_words(low(t))
        sets.append({tuple(w[k : k + resemblance.WIDTH]) for k in range(max(1, len(w) - resemblance.WIDTH + 1))} if w else {()})
    root = list(range(len(docs)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i, j in combinations(range(len(docs)), 2):
        if len(sets[i] & sets[j]) >= resemblance.LEAST * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    best = {}
    for k, (i, _) in enumerate(docs):
        rank = (i is None, i or 0)
        if find(k) not in best or rank < best[find(k)][0]:
            best[find(k)] = (rank, k)
    return sorted(k for _, k in best.values())


def without_repeats(docs, window=50):
    """The texts: words of windows that a smaller doc_id has too go; a text without any stays to the byte."""
    first = {}
    for i, t in docs:
        w = ascii_words(t)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = ascii_words(t)
        gone = {x for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for x in range(k, k + window)}
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone) if gone else t)
    return out


def pieces(docs):
    """Counter of (doc_id, piece, start, length, ids_crc32)."""
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(packing.public_vocabulary()), Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), packing.CAPACITY):
            part = ids[at : at + packing.CAPACITY]
            out[i, at // packing.CAPACITY, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def best_fit_decreasing(lengths, capacity=packing.CAPACITY):
    """How many sequences best-fit decreasing makes, piece by piece."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            k = min(fits, key=room.__getitem__)
            room[k] -= n
        else:
            room.append(capacity - n)
    return len(room)
