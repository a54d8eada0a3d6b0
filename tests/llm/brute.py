"""Brute-force versions of text operators, in plain Python."""

import re
from collections import Counter

import numpy as np

from harrow.llm import decontaminate, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def kept_by_quality(text):
    t = text or ""
    ws, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
    covered = {k + j for k in range(len(ws) - 4) if grams[tuple(ws[k : k + 5])] > 1 for j in range(5)}
    if len(ws) < 10 or 100 * len(covered) > 20 * len(ws):
        return False
    of = {
        "mean_word_length": sum(map(len, ws)) / len(ws),
        "symbol_ratio": sum(t.count(c) for c in "#*$%&|<>") / len(ws),
        "stop_word_ratio": (sum(w.lower() in quality.STOP_WORDS for w in ws) + 1) / len(ws),
        "dup_line_ratio": (len(lines) - len(set(lines))) / max(1, len(lines)),
    }
    return all(of[r.ratio] >= r.bound if r.least else of[r.ratio] <= r.bound for r in quality.RULES)


def shingles(text):
    w = WORD.findall(low(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts):
    """The number of the first linked text for each text, over all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def leaks(text, item):
    """Whether some stretch of the item (the whole, if short) is equal in four of five tokens along some diagonal."""
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, b = tokens(text), tokens(item)
    n = min(len(b), decontaminate.STRETCH)
    for shift in range(-len(b) + 1, len(d)) if b else ():
        same = [0 <= shift + j < len(d) and d[shift + j] == x for j, x in enumerate(b)]
        if any(sum(same[s : s + n]) >= decontaminate.SHARE * n for s in range(len(b) - n + 1)):
            return True
    return False


def base_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def digits(t):
    return re.sub("[^0-9]", "", t)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def octets(c):
    return all(re.fullmatch("0|[1-9][0-9]{0,2}", x) and int(x) <= 255 for x in re.split("[.,]", c))


def wordy(c):
    return 5 * len(re.sub(pii.WORDY, "", c)) <= 3 * len(c)


def changing(c):
    return 6 * len(re.findall(pii.CHANGES, c)) >= len(c)


def described(kind, c, left, right):
    d = digits(c)
    return {
        "plus": c[:1] == "+", "space": " " in c, "hyphen": "-" in c, "dot": "." in c, "bracket": "[" in c or "(" in c, "spaced_at": " @" in c or "@ " in c, "digits_9_15": 9 <= len(d) <= 15,
        "first_card_digit": c[:1] in "3456", "checksum": kind == 2 and luhn(d), "octets": kind == 1 and octets(c), "area": kind == 3 and bool(re.match("[2-9][0-9]{2}[2-9]", d[-10:])), "comma": "," in c, "slash": "/" in c,
        "separators": sum(x in "_/-" for x in c) >= 3, "both": kind == 4 and bool(re.search("[0-9]", c) and re.search("[A-Za-z]", c)), "wordy": kind == 4 and wordy(c), "changing": kind == 4 and changing(c),
        "address": kind == 4 and bool(re.search(pii.IN_ADDRESS, left) or re.search(pii.BEFORE_NAME, right) or re.search("^//|^/[a-z]{2,8}/", c)),
        "assigned": bool(re.search(pii.ASSIGNED, left)),
        "glued": bool(re.search(r"[^\W_]$|[_/-]$", left) or re.search(r"^[^\W_]|^[_@/=-]", right)), "hint": bool(re.search(pii.HINTS, left)),
    }


def label(kind, c, left):
    address = re.sub(r" ?(?:\[dot\]|\(dot\)) ?", ".", re.sub(r" ?(?:@|\[at\]|\(at\)) ?", "@", c.lower()))
    d = digits(c)
    return (
        bool(re.fullmatch(r"[a-z0-9][a-z0-9._%+-]*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}", address)) and " @" not in c and "@ " not in c,
        octets(c) if kind == 1 and ("," not in c or re.search(pii.HINTS, left)) else False,
        13 <= len(d) <= 19 and d[:1] in "3456" and luhn(d),
        9 <= len(d) <= 15 and bool(re.match("[2-9][0-9]{2}[2-9]", d[-10:])),
        bool(re.search("[A-Za-z0-9]{16}", c) and re.search("[0-9]", c) and re.search("[A-Za-z]", c)) and len(set(c)) >= 10 and not wordy(c) and not re.search(pii.IN_ADDRESS, left) and (changing(c) or bool(re.search(pii.ASSIGNED, left))),
    )[kind]


def candidates(t):
    """(kind, start, end, text, left, right) of every proposed span."""
    for kind, name in enumerate(pii.KINDS):
        for m in re.finditer(pii.LOOSE[name], t):
            a, b = m.span()
            yield kind, a, b, m[0], t[max(0, a - pii.CONTEXT) : a], t[b : b + pii.CONTEXT]


def all_spans(texts, models):
    """Base and added spans of each text, given the trained trees."""
    out = []
    for t in texts:
        base = base_spans(t or "")
        more = []
        for kind, a, b, c, left, right in candidates(t or ""):
            if kind in models and not any(x <= a and b <= y for _, x, y in base):
                f = described(kind, c, left, right)
                model, least = models[kind]
                if model.predict(np.array([[f[k] for k in pii.FEATURES]]))[0] >= least:
                    more.append((kind, a, b))
        out.append(sorted(base + more))
    return out


def redacted(t, spans):
    out, at = "", 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += t[at:a] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, b)
    return out + t[at:]
