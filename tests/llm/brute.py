"""Brute-force versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lowered(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_groups(rows, percent=85):
    """{doc_id: (n_shingles, component, kept)} of (doc_id, text)."""
    sets = defaultdict(list)
    for d, t in rows:
        sets[d].append(shingle_set(t))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    items = [(d, s) for d, many in sets.items() for s in many if s]
    for i, (a, s) in enumerate(items):
        for b, t in items[:i]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(many[0]), root(d), root(d) == d) for d, many in sets.items()}


def without_repeats(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, sha256)] of (doc_id, text)."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, sha256(rest).hexdigest()))
    return sorted(out, key=str)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return [len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)]


def water_fill(sizes, weights, cap):
    """Targets by clamping and dealing out anew until nothing is above."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i] + 1e-9]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


def greedy(symbols, tokens, longest=None):
    """Longest-match token count, -1 if there is none; ``longest`` is the length
    of the longest token, if known."""
    longest = longest or len(symbols)
    at = n = 0
    while at < len(symbols):
        end = next((j for j in range(min(len(symbols), at + longest), at, -1) if symbols[at:j] in tokens), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def kneser_ney_bits(docs, turn_of, spell, most=40.0):
    """{doc: mean bits per word} of {doc: (language, words)}, each under the
    counts of all other documents: interpolated modified Kneser-Ney of order 3
    over the spelling, with discounts for each language and turn of middle words."""
    grams = {d: [((("<", "<", *w)[i : i + 3]), lang) for i in range(len(w))] for d, (lang, w) in docs.items()}
    count = Counter((lang, g) for x in grams.values() for g, lang in x)
    kinds = Counter((lang, g[1:]) for lang, g in count)

    def cuts(values):
        n1, n2, n3, n4 = (sum(v == k for v in values) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return [0, 0.5, 1, 1.5]
        y = n1 / (n1 + 2 * n2)
        return [0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]))]

    def cut_of(table, middle):
        groups = defaultdict(list)
        for (lang, g), n in table.items():
            groups[lang, turn_of(lang, g[middle])].append(n)
        return {k: cuts(v) for k, v in groups.items()}

    cut_3, cut_2 = cut_of(count, 1), cut_of(kinds, 0)
    out = {}
    for d, own_grams in grams.items():
        own = Counter(own_grams)
        bits = 0.0
        for (g, lang), n in own.items():
            turn = lang, turn_of(lang, g[1])
            alone = int(count[lang, g] == n)
            p = 2.0 ** -spell(g[2])
            for table, gram, less, cut in (({k[1]: v for k, v in kinds.items() if k[0] == lang}, g[1:], {g[1:]: alone}, cut_2[turn]), ({k[1]: v for k, v in count.items() if k[0] == lang}, g, {k[0]: v for k, v in own.items()}, cut_3[turn])):
                peers = {k: v for k, v in table.items() if k[:-1] == gram[:-1]}
                rest = {k: v - less.get(k, 0) for k, v in peers.items()}
                total = sum(rest.values())
                if total > 0:
                    mass = sum(cut[min(v, 3)] for k, v in peers.items() if k != gram) + cut[min(max(rest[gram], 0), 3)]
                    p = min((rest[gram] - cut[min(rest[gram], 3)]) / total + min(mass / total, 1) * p, 1)
            bits += n * min(-math.log2(max(p, 1e-30)), most)
        if own:
            out[d] = bits / sum(own.values())
    return out
