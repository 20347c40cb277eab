"""Plain versions of what the operators compute."""

import itertools
import math
import re
import zlib

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"


def shingle_sets(rows, words):
    sets = []
    for t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return sets


def components(n, linked):
    of = list(range(n))
    for i in range(n):
        for j in range(i):
            if of[i] != of[j] and linked(i, j):
                x, y = of[i], of[j]
                of = [min(x, y) if c in (x, y) else c for c in of]
    return of


def classes(rows, words, percent):
    """Sets, and for each row the least row of its component."""
    sets = shingle_sets(rows, words)
    return sets, components(len(rows), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))


def ngram_hash(chars):
    """The number of a character n-gram, as the toxicity model hashes it."""
    h = ord(chars[0])
    for c in chars[1:]:
        h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & 0xFFFFFFFF
    h = ((h ^ h >> 15) * 0x85EBCA6B + len(chars) * 0x27D4EB2F) & 0xFFFFFFFF
    return h >> 10


def ngrams(text):
    t = " " + " ".join((text or "").lower().split()) + " "
    return {ngram_hash(t[i : i + n]) for n in (3, 4, 5, 6) for i in range(len(t) - n + 1)}


def toxicity_score(text, model):
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + np.exp(-(sum(weight.get(h, 0.0) for h in ngrams(text)) + model.intercept)))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def quality_counts(t):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = t or ""
    w, seen, dup = re.findall(WORD, t), set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k : k + 8]), []).append(k)
    repeated = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def best_labels(field, features):
    """The likeliest labels of one chain, by dynamic programming over plain numbers; equal scores go to content."""
    score = (features @ np.array(field.weights) + field.intercept).tolist()
    paths = {0: (0.0, [0]), 1: (score[0], [1])}
    for s in score[1:]:
        new = {}
        for y in (0, 1):
            value, _, labels = max((paths[x][0] + field.transitions[x][y], x, paths[x][1]) for x in (0, 1))
            new[y] = value + s * y, [*labels, y]
        paths = new
    return max((paths[y][0], y, paths[y][1]) for y in (0, 1))[2]


def chain_loss(field, features, labels, l2=1.0):
    """Penalised negative log-likelihood of one chain by summing over all labellings."""
    score = features @ np.array(field.weights) + field.intercept
    value = lambda y: sum(s * a for s, a in zip(score, y, strict=True)) + sum(field.transitions[a][b] for a, b in itertools.pairwise(y))
    norm = np.logaddexp.reduce([value(y) for y in itertools.product((0, 1), repeat=len(score))])
    x = np.concatenate([field.weights, [field.intercept], np.ravel(field.transitions)])
    return norm - value(labels) + l2 / 2 * (x @ x)


def best_fit_bound(lengths, capacity):
    """Sequences of plain best fit, longest first."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def kept_lines(rows, least_chars, least_docs):
    """For rows (id, text): lines, lines dropped and the text that stays. A null id is a document below all others."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    below = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(below(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least_chars or len(holders[key(x)]) < least_docs or max(holders[key(x)]) == below(i)]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def ranked(docs, items, k):
    """The k best (score, id) of docs (id, text) for each of items (id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, words(t)) for i, t in docs if words(t)]
    all_docs, all_terms = len(own), sum(len(w) for _, w in own)
    df = {}
    for _, w in own:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = {}
    for i, ts in asked.items():
        found = []
        for d, w in own:
            m = 50 + 50 * len(w) * all_docs // all_terms
            s = sum(math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in ts if t in w)
            if s:
                found.append((-s, d is None, d or 0))
        out[i] = [(-s, None if null else d) for s, null, d in sorted(found)[:k]]
    return out
