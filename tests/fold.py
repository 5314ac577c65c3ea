"""Plain line-by-line forms of the stages, as a second opinion for random texts.  A line is [text, decision]."""

import re
from datetime import datetime, timedelta


def cost(s):
    return max(1, (len(s) + 3) // 4)


def protect(lines, patterns, resurrect=True):
    for x in lines:
        if x[1] == "KEEP" or (resurrect and x[1] == "COMPRESS"):
            if any(re.search(p, x[0]) for p in patterns):
                x[1] = "PROTECT"


def strip_lines(lines, patterns, keep=()):
    protect(lines, keep, False)
    for x in lines:
        if x[1] == "KEEP" and any(re.search(p, x[0]) for p in patterns):
            x[1] = "COMPRESS"
    return lines


def dedup(lines, show=False):
    anchor, times = None, {}
    for i, x in enumerate(lines):
        if x[1] == "COMPRESS":
            continue
        if x[1] == "KEEP" and anchor is not None and lines[anchor][0] == x[0]:
            x[1] = "COMPRESS"
            times[anchor] = times.get(anchor, 1) + 1
        else:
            anchor = i
    if show:
        for i, n in times.items():
            if lines[i][1] == "KEEP":
                lines[i][0] += f" (×{n})"
    return lines


def runs(lines, member, joins=lambda a, b, first: True):
    out, current = [], []
    for i, x in enumerate(lines):
        if x[1] == "KEEP" and member(x[0]):
            if current and not joins(lines[current[-1]][0], x[0], lines[current[0]][0]):
                out.append(current)
                current = []
            current.append(i)
        elif current:
            out.append(current)
            current = []
    return out + [current] if current else out


def group_run(lines, pattern, least=2, exact=False):
    for r in runs(lines, lambda s: re.search(pattern, s), (lambda a, b, f: b == f) if exact else (lambda a, b, f: True)):
        if len(r) >= least:
            lines[r[0]][0] += f" (×{len(r)})"
            for i in r[1:]:
                lines[i][1] = "COMPRESS"
    return lines


def group_location(lines, pattern, location, least=2, everywhere=False):
    def key(s):
        m = re.search(location, s)
        return (s[: m.start(1)] + s[m.end(1) :], m[1]) if m else (s, s)

    if everywhere:
        found = {}
        for i, x in enumerate(lines):
            if x[1] == "KEEP" and re.search(pattern, x[0]):
                found.setdefault(key(x[0])[0], []).append(i)
        groups = list(found.values())
    else:
        groups = runs(lines, lambda s: re.search(pattern, s), lambda a, b, f: key(a)[0] == key(b)[0])
    told = {}
    for g in groups:
        if len(g) >= least:
            told[g[0]] = f"({len(g) - 1} more with the same message at: {', '.join(key(lines[i][0])[1] for i in g[1:])})"
            for i in g[1:]:
                lines[i][1] = "COMPRESS"
    out = []
    for i, x in enumerate(lines):
        out.append(x)
        if i in told:
            out.append([told[i], "KEEP"])
    return out


def collapse(lines, around):
    for r in runs(lines, lambda s: True):
        middle = r[around : len(r) - around]
        told = f"... {len(middle)} unchanged lines omitted ..."
        if middle and cost(told) < sum(cost(lines[i][0]) for i in middle):
            lines[middle[0]][0] = told
            for i in middle[1:]:
                lines[i][1] = "COMPRESS"
    return lines


def budget(lines, limit, strategy):
    if sum(cost(x[0]) for x in lines if x[1] != "COMPRESS") <= limit:
        return lines

    def greedy(order, left):
        kept = set()
        for i in order:
            if lines[i][1] == "KEEP" and cost(lines[i][0]) <= left:
                left -= cost(lines[i][0])
                kept.add(i)
        return kept

    forward = range(len(lines))
    half = max(1, limit // 2)
    kept = {"head": lambda: greedy(forward, limit), "tail": lambda: greedy(reversed(forward), limit), "both": lambda: greedy(forward, half) | greedy(reversed(forward), half)}[strategy]()
    for i, x in enumerate(lines):
        if x[1] == "KEEP" and i not in kept:
            x[1] = "COMPRESS"
    return lines


def numbers(lines):
    whole = re.compile(r"\d+")
    for r in runs(lines, whole.fullmatch, lambda a, b, f: len(a) == len(b) and int(b) == int(a) + 1):
        text = f"{lines[r[0]][0]}-{lines[r[-1]][0]}"
        if len(r) > 1 and cost(text) < sum(cost(lines[i][0]) for i in r):
            lines[r[0]][0] = text
            for i in r[1:]:
                lines[i][1] = "COMPRESS"
    return lines


def moment(s):
    m = re.match(r"(\d{4}-\d\d-\d\d )?(\d\d):(\d\d):(\d\d)(?=[ \t]|$)", s)
    if not m:
        return None
    try:
        day = datetime.strptime((m[1] or "2000-01-01 ").strip(), "%Y-%m-%d")
    except ValueError:
        return None
    h, mi, sec = int(m[2]), int(m[3]), int(m[4])
    if h > 23 or mi > 59 or sec > 59:
        return None
    return bool(m[1]), day + timedelta(hours=h, minutes=mi, seconds=sec), m.end()


def deltas(lines):
    def joins(a, b, _):
        x, y = moment(a), moment(b)
        return x[0] == y[0] and y[1] >= x[1]

    for r in runs(lines, moment, joins):
        new = []
        for a, b in zip(r, r[1:], strict=False):
            gap = int((moment(lines[b][0])[1] - moment(lines[a][0])[1]).total_seconds())
            told = "0s" if not gap else f"{gap // 3600}h" if gap % 3600 == 0 else f"{gap // 60}m" if gap % 60 == 0 else f"{gap}s"
            new.append(f"+{told}{lines[b][0][moment(lines[b][0])[2] :]}")
        if sum(map(cost, new)) < sum(cost(lines[i][0]) for i in r[1:]):
            for i, t in zip(r[1:], new, strict=True):
                lines[i][0] = t
    return lines


def paths(lines, pattern, separator="/"):
    heads, strips = {}, {}
    for r in runs(lines, lambda s: re.search(pattern, s)):
        texts = [lines[i][0] for i in r]
        k = 0
        while len(r) > 1 and all(len(t) > k and t[k] == texts[0][k] for t in texts):
            k += 1
        prefix = texts[0][:k]
        prefix = prefix[: prefix.rfind(separator) + len(separator)] if separator in prefix else ""
        head = f"{prefix} ({len(r)} entries):"
        if prefix and cost(head) + sum(cost(t[len(prefix) :]) for t in texts) < sum(map(cost, texts)):
            heads[r[0]] = head
            strips |= {i: len(prefix) for i in r}
    out = []
    for i, (text, decision) in enumerate(lines):
        if i in heads:
            out.append([heads[i], "KEEP"])
        out.append([text[strips.get(i, 0) :], decision])
    return out


def padding(lines, pattern, gaps=0):
    for x in lines:
        if x[1] == "KEEP" and re.search(pattern, x[0]):
            new = re.sub(r"(?<=\S) {2,}(?=\S)", " ", x[0], count=gaps)
            if cost(new) < cost(x[0]):
                x[0] = new
    return lines
