"""Plain versions of the operators' contracts."""

import hashlib
import re
import string
from collections import defaultdict

import xxhash

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, span=13):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(span, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                if (g := tuple(w[j : j + m])) in windows:
                    hit.update(range(j, j + m))
                    found |= windows[g]
        n = len(hit)
        out.append((d, len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    return out


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOW).encode())
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Least id reachable from each id. linked(i, j) for positions."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in k) for k in ("password", "passwd", "secret", "token", "api", "apikey")).replace("|[aA][pP][iI]|", "|[aA][pP][iI]_?[kK][eE][yY]|")
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    t = text or ""
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    s.sort()
    line = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in s)
    return (*[sum(x[1] == k for x in s) for k in range(3)], sha(line), s)


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    line = ",".join(f"{['email', 'ip', 'card', 'phone'][k]}:{a}:{b}" for a, k, b in out)
    return (*[sum(x[1] == k for x in out) for k in range(4)], sha(line))
