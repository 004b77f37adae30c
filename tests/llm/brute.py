"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    words = PLAIN.findall((text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def near_duplicates(docs, percent=75):
    """doc_id -> (n_shingles, component_id, kept)"""
    sets = {d: shingles(t) for d, t in docs}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for o in where[x]:
                if o < d:
                    shared[o] += 1
        for o, i in shared.items():
            if 100 * i >= percent * (len(s) + len(sets[o]) - i):
                a, b = sorted((top(d), top(o)))
                parent[b] = a
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = PLAIN.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if PLAIN.search(line):
            dup += line in seen
            seen.add(line)
    where = defaultdict(list)
    for i in range(len(words) - 4):
        where[tuple(words[i:i + 5])].append(i)
    hit = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def quality_rules(docs, least, share, left):
    """docs: (doc_id, text, host); doc_id -> (*base, base_failed, kept). Signatures are those of equal texts only."""
    norm = lambda line: tuple(w.translate(FOLD) for w in PLAIN.findall(line))
    hosts, holders = defaultdict(set), defaultdict(set)
    for d, t, h in docs:
        hosts[h].add(t or "")
        for line in set(map(norm, (t or "").split("\n"))) - {()}:
            holders[h, line].add(t)
    above = {x for x, s in holders.items() if len(s) >= least and len(s) > share * len(hosts[x[0]])}
    out = {}
    for d, t, h in docs:
        base = quality_base(t)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        gone = sum(len(x) for x in map(norm, (t or "").split("\n")) if (h, x) in above)
        rest = base[0] - gone
        out[d] = (*base, failed, not failed and not (gone and (rest < 10 or rest < left * base[0])))
    return out


def spans(text, kinds):
    """kinds: (kind, pattern, test of the match); spans in order of kind, then start."""
    out = []
    for kind, pattern, good in kinds:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if good(m)]
    return out


def sha(parts):
    import hashlib

    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in parts).encode()).hexdigest()


SECRETS = [("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            lambda m: len(m[2]) >= 6),
           ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def secrets(text):
    """n_assign, n_access, n_hex, base_sha256"""
    found = spans(text, SECRETS)
    order = {"assign": 0, "access": 1, "hex": 2}
    found.sort(key=lambda s: (s[1], order[s[0]]))
    return (*(sum(k == s[0] for s in found) for k in order), sha(found))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def only(m):
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15)]


def personal(text):
    """n_email, n_ip, n_card, n_phone, base_sha256"""
    found = spans(text, PERSONAL)
    return (*(sum(k == s[0] for s in found) for k, _, _ in PERSONAL), sha(found))


def mix_targets(docs):
    """docs: (doc_id, text, source); source -> (size, target)"""
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += len(PLAIN.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        rest = [s for s in order if s not in full]
        target = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        above = {s for s in rest if target[s] > 3 * size[s]}
        if not above:
            return {s: (size[s], target[s]) for s in order}
        full |= above


def repeats(docs, match=100):
    """docs: (doc_id, text); doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    import hashlib

    seen, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - match + 1):
            w = raw[i:i + match]
            if w in seen:
                gone[i:i + match] = b"\1" * match
            else:
                seen[w] = 1
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def decontaminate(docs, items, window=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    import hashlib

    spans = defaultdict(set)
    for i, t in items:
        w = ITEM.findall((t or "").translate(FOLD))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            spans[tuple(w[p:p + n])].add(i)
    out = {}
    for d, t in docs:
        w = ITEM.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for n in {len(s) for s in spans}:
            for p in range(len(w) - n + 1):
                if (s := tuple(w[p:p + n])) in spans:
                    hit |= set(range(p, p + n))
                    found |= spans[s]
        ids = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def kneser_ney(texts, order):
    """Discounted probabilities of seen n-grams and weights of histories, by order."""
    fold = lambda c: "\x03" if c in "0123456789" else " " if c in "\t\n\x0b\x0c\r" else c
    full = defaultdict(int)
    for t in texts:
        s = "\x01" * (order - 1) + "".join(map(fold, t)) + "\x02"
        for i in range(order - 1, len(s)):
            full[s[i - order + 1:i + 1]] += 1
    counts = {order: dict(full)}
    for n in range(order - 1, 0, -1):
        lower = defaultdict(int)
        for g in counts[n + 1]:
            lower[g[1:]] += 1
        counts[n] = dict(lower)
    out = {}
    for n, table in counts.items():
        times = [sum(c == i for c in table.values()) for i in range(5)]
        y = times[1] / (times[1] + 2 * times[2]) if times[1] + 2 * times[2] else 0
        d = [0] + [min(i, max(0.0, i - (i + 1) * y * times[i + 1] / times[i])) if times[i] and times[1] else 0.5 for i in (1, 2, 3)]
        total, off = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3)]
        out["seen", n] = [(c - d[min(c, 3)]) / total[g[:-1]] for g, c in table.items()]
        out["weight", n] = [off[h] / total[h] for h in total]
    return out


def pipeline(rows, items):
    """Documents after the four stages before mixing; no line is above the limits in small tables."""
    good = quality_rules(rows, 20, 0.05, 0.3)
    kept = [r for r in rows if good[r[0]][-1]]
    near = near_duplicates([r[:2] for r in kept])
    kept = [r for r in kept if near[r[0]][2]]
    dirty = decontaminate([r[:2] for r in kept], items)
    kept = [r for r in kept if not dirty[r[0]][4]]
    order = {"assign": 0, "access": 1, "hex": 2}
    out = []
    for d, t, s in kept:
        for _, a, b in sorted(spans(t, SECRETS), key=lambda x: (-x[1], order[x[0]])):
            t = t[:a] + "[SECRET]" + t[b:]
        out.append((d, t, s))
    return out
