"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPACE.split(folded) if w]


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def groups(rows):
    """(id, size, component, kept) of every (id, text)."""
    sets = [(i, set(shingles(t))) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    found = [(i, len(s), None if i is None else find(i)) for i, s in sets]
    return [(i, n, c, i == c) for i, n, c in found]


def passages(rows, items):
    """The best window of every document and item of five words and more."""
    out = {}
    for doc, text in rows:
        s = shingles(text)
        for item, t in items:
            bag = Counter(shingles(t))
            size = sum(bag.values())
            if len(words(t)) < 5 or not s:
                continue
            for at in range(max(0, len(s) - size) + 1):
                window = Counter(s[at : at + size])
                common = sum((bag & window).values())
                value = common / (size + sum(window.values()) - common)
                if 100 * value >= 75 and value > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (value, at)
    return {(d, i, at, v) for (d, i), (v, at) in out.items()}


def base_spans(text):
    """The four base kinds by their stated expressions."""
    found = []
    for order, (kind, expression) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        )
    ):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = 0
                for k, d in enumerate(digits[::-1]):
                    v = int(d) * (1 + k % 2)
                    total += v // 10 + v % 10
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]
