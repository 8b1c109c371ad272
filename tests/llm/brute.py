"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from tickloom.llm import pieces, rules

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
SPACES = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact(docs):
    """{doc_id: (keep_id, group_size, digest)} of {doc_id: text}."""
    groups = defaultdict(list)
    for i, text in docs.items():
        groups[(text or "").translate(LOWER)].append(i)
    return {
        i: (max(ids), len(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items()
        for i in ids
    }


def shingles(text, size):
    own = words((text or "").translate(LOWER))
    size = min(size, len(own))
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()


def near(docs, size, percent):
    """{doc_id: component}."""
    sets = {i: shingles(text, size) for i, text in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in docs}


def metrics(text):
    text = text or ""
    own = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    grams = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(8)}
    return {
        "n_words": len(own),
        "word_chars": sum(map(len, own)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "n_lines": len(lines),
        "n_stop_words": sum(w in set(rules.STOP_WORDS) for w in own),
        "n_exclaim": text.count("!"),
    }


def passes(text):
    m = metrics(text)
    n = m["n_words"]
    return not (
        n < 20
        or 100 * m["n_repeat_words"] > 30 * n
        or not 2 * n <= m["word_chars"] <= 20 * n
        or m["n_symbols"] > 0.1 * n
        or m["n_exclaim"] > 0.5 * n
        or m["n_stop_words"] < 0.02 * n
        or m["n_dup_lines"] > 0.5 * m["n_lines"]
    )


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} of {source: size}, by resharing until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        open_ -= full
    return out


def mix(docs, seed=7):
    """{doc_id: copies} of {doc_id: (text, source)}."""
    sizes = {i: len(words(text)) for i, (text, _) in docs.items()}
    total = Counter()
    for i, (_, source) in docs.items():
        total[source] += sizes[i]
    goal, out = targets(total), {}
    for source in total:
        key = f"{seed}:" + ("" if source is None else f"={source}")
        offset = int(hashlib.md5(key.encode()).hexdigest()[:5], 16) / (1 << 20)
        rate = goal[source] / total[source] if total[source] else 0.0
        own = [i for i, (_, s) in docs.items() if s == source]
        own.sort(key=lambda i: (sizes[i], hashlib.md5(str(i).encode()).hexdigest(), i))
        for k, i in enumerate(own):
            out[i] = math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset)
    return out


def viterbi(text, vocabulary):
    """Ids of the cheapest segmentation, by one table over the whole text."""
    if not text:
        return []
    text = text.replace(pieces.MARK, pieces.LITERAL_MARK).replace(" ", pieces.MARK)
    text = (pieces.MARK if vocabulary.prefix else "") + text
    best, back = [0] + [None] * len(text), [None] * (len(text) + 1)

    def offer(end, cost, start, ids):
        if best[end] is None or cost < best[end]:
            best[end], back[end] = cost, (start, ids)

    for i in range(len(text)):
        follow, single = vocabulary.trie, False
        for end in range(i + 1, len(text) + 1):
            if text[end - 1] not in follow:
                break
            piece, follow = follow[text[end - 1]]
            if piece:
                single = single or end == i + 1
                offer(end, best[i] + piece[0], i, list(piece[1]))
        if not single:
            offer(i + 1, best[i] + vocabulary.unknown_cost, i, vocabulary.spelled(text[i]))
    out, place = [], len(text)
    while place:
        place, ids = back[place]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def repeats(docs, window=50):
    """{doc_id: (spans, kept bytes)}."""
    data = {i: (text or "").encode() for i, text in docs.items()}
    first = {}
    for i in sorted(data):
        for k in range(len(data[i]) - window + 1):
            first.setdefault(data[i][k : k + window], i)
    out = {}
    for i, body in data.items():
        gone = set()
        for k in range(len(body) - window + 1):
            if first[body[k : k + window]] < i:
                gone.update(range(k, k + window))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out[i] = ([tuple(s) for s in spans], bytes(b for k, b in enumerate(body) if k not in gone))
    return out


def kneser_ney(trained, asked, order=4):
    """{n-gram: probability} of the asked n-grams (tuples of UTF-16 units), and a text's n-grams."""
    counts = {order: Counter(trained)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, table in counts.items():
        n = [sum(c == j for c in table.values()) for j in (1, 2, 3, 4)]
        if not all(n):
            cuts[k] = [0.5, 0.75, 0.9]
        else:
            y = n[0] / (n[0] + 2 * n[1])
            cuts[k] = [min(max(j + 1 - (j + 2) * y * n[j + 1] / n[j], 0), j + 1) for j in (0, 1, 2)]
    totals, masses = defaultdict(float), defaultdict(float)
    for k, table in counts.items():
        for g, c in table.items():
            totals[g[:-1]] += c
            masses[g[:-1]] += cuts[k][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        lower = p(g[1:])
        if g[:-1] not in totals or not totals[g[:-1]]:
            return lower
        c = counts[len(g)].get(g, 0)
        own = max(c - cuts[len(g)][min(c, 3) - 1], 0) if c else 0
        return own / totals[g[:-1]] + masses[g[:-1]] / totals[g[:-1]] * lower

    return {g: p(g) for g in set(asked)}


def grams(text, order=4):
    data = ("\n" * (order - 1) + text).encode("utf-16-le")
    units = [int.from_bytes(data[i : i + 2], "little") for i in range(0, len(data), 2)]
    return [tuple(units[i : i + order]) for i in range(len(units) - order + 1)]
