"""Plain forms of the corpus operators for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 1 << 63


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(i):
    return LAST if i is None else i


def jaccard(docs, k, num, den):
    """(set size, smallest id reachable, links) for rows [(doc_id, text)]."""
    sets = []
    for _, text in docs:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent, links = list(range(len(docs))), [0] * len(docs)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i in range(len(docs)):
        least[root(i)] = min(least.get(root(i), LAST), order(docs[i][0]))
    return [(len(s), None if least[root(i)] == LAST else least[root(i)], links[i]) for i, s in enumerate(sets)]


def substrings(docs, window):
    first = {}
    for i, text in docs:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (LAST + 1, 0)), (order(i), s))
    out = []
    for i, text in docs:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                gone |= set(range(s, s + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def suffixes(docs, length):
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first.get(b[s : s + length], LAST + 1), order(i))
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < order(i):
                gone[s : s + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def lines(docs, t, least=None):
    """least: words that make a run of fewer than t lines count."""
    runs = lambda x: [(s, tuple(x[s : s + n])) for n in range(1, t + 1) for s in range(len(x) - n + 1) if n == t or least and sum(len(words(y)) for y in x[s : s + n]) >= least]
    split = [text.split("\n") if text is not None else [] for _, text in docs]
    first = {}
    for (i, _), x in zip(docs, split, strict=True):
        for s, run in runs(x):
            first[run] = min(first.get(run, (LAST + 1, 0)), (order(i), s))
    out = []
    for (i, text), x in zip(docs, split, strict=True):
        gone = {s + k for s, run in runs(x) if first[run] < (order(i), s) for k in range(len(run))}
        out.append((len(x), len(gone), None if text is None else "\n".join(y for k, y in enumerate(x) if k not in gone)))
    return out


def contamination(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    tokens = lambda t: re.findall(pattern, (t or "").translate(LOWER))
    wins = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        for s in range(max(1, len(w) - k + 1)) if w else ():
            wins[tuple(w[s : s + k])].add(str(item))
    out = []
    for _, text in docs:
        w = tokens(text)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_valid(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def pii(text):
    return [(k, m.start(), m.end()) for k in PII for m in re.finditer(PII[k], text or "") if pii_valid(k, m[0])]


def statistics(text):
    w = words(text)
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
    covered = {p for s in range(len(w) - 7) if grams[tuple(w[s : s + 8])] > 1 for p in range(s, s + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def viterbi(unit, table, longest, worst):
    """Pieces of a unit: the highest sum of scores, of these the longest last piece; unknown characters score worst."""
    best = [(0.0, 0)]
    for e in range(1, len(unit) + 1):
        options = [(best[e - n][0] + table.get(unit[e - n : e], worst), n) for n in range(1, min(e, longest) + 1) if n == 1 or unit[e - n : e] in table]
        best.append(max(options))
    out, e = [], len(unit)
    while e:
        out.append(unit[e - best[e][1] : e])
        e -= best[e][1]
    return out[::-1]


def merge(unit, place):
    """Pieces of a unit: again and again the two neighbours whose join comes first, of equal ones the leftmost."""
    parts = list(unit)
    while True:
        found = min(((place[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in place), default=None)
        if found is None:
            return parts
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def kneser_ney(docs, order):
    """{(text, lang): mean surprise of a byte by order} of a modified Kneser-Ney model over all rows (text, lang)."""
    stream = lambda t: b" " * (order - 1) + b"".join(w.encode() + b" " for w in words(t))
    out = {}
    for lang in {x for _, x in docs}:
        streams = [stream(t) for t, x in docs if x == lang and words(t)]
        counts = [Counter(s[i - order + 1 : i + 1] for s in streams for i in range(order - 1, len(s)))]
        for k in range(order - 1, 0, -1):
            counts.append(Counter(g[1:] for g in counts[-1]))
        counts.reverse()
        levels = []
        for c in counts:
            t = [sum(n == i for n in c.values()) for i in range(5)]
            cut = [0.0, 0.5, 1.0, 1.5]
            if t[1] and t[2] and t[3]:
                y = t[1] / (t[1] + 2 * t[2])
                cut[1:] = [max(0.05, min(i - (i + 1) * y * t[i + 1] / t[i], i - 0.05)) for i in (1, 2, 3)]
            total, held = Counter(), Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                held[g[:-1]] += cut[min(n, 3)]
            levels.append((c, cut, total, held))

        def prob(g):
            if not g:
                return 1 / 256
            c, cut, total, held = levels[len(g) - 1]
            return (c[g] - cut[min(c[g], 3)]) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * prob(g[1:])

        for t, x in docs:
            if x == lang and words(t) and (t, x) not in out:
                s = stream(t)
                out[t, x] = [-sum(math.log(prob(s[i - k + 1 : i + 1])) for i in range(order - 1, len(s))) / (len(s) - order + 1) for k in range(1, order + 1)]
    return out
