"""The contracts once more in plain Python, for comparison on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter


def words(text):
    return (text or "").encode().split()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """doc_id -> smallest id reachable over links."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def item_words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())


def contamination(text, items):
    """n_words, n_hit, ids found."""
    w, hit, found = item_words(text), set(), set()
    for item, body in items:
        b = item_words(body)
        n = min(13, len(b))
        known = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in known:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v, d: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v, d: 14 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v, d: 10 <= len(d) <= 15),
}


def personal(text):
    """(start, kind number, end, kind) by start, then kind."""
    out = []
    for no, (kind, (pattern, good)) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            if good(m[0], re.sub("[^0-9]", "", m[0])):
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    at = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(at)
    covered = {i + k for i, x in enumerate(at) if n[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def copies(rows):
    """(doc_id, text) -> doc_id, keep_id, group_size, digest per row."""
    held = {}
    for i, t in rows:
        held.setdefault(t or "", []).append(i)
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in held.items()}
    return [(i, last[t or ""], len(held[t or ""]), sha(t or "")) for i, t in rows]


def search(docs, items, top=10):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, Counter(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    held = {}
    for item, t in items:
        held.setdefault(item, set()).update(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
    out = []
    for item, terms in held.items():
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if t in b
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return out


def manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof, folded root, verified, in tree order."""

    def leaf(fields):
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def tree(hashes):
        """Root, and per leaf its (left, right) siblings level by level."""
        paths, owner = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for i, at in enumerate(owner):
                first = at - at % 8
                paths[i].append(("".join(hashes[first:at]), "".join(hashes[at + 1 : first + 8])))
            hashes = [sha("".join(hashes[k : k + 8])) for k in range(0, len(hashes), 8)]
            owner = [at // 8 for at in owner]
        return hashes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append(r)
    order = sorted(groups)
    made = []
    for g in order:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((ordered, *tree([leaf(r) for r in ordered])))
    if not made:
        return []
    root, tops = tree([m[1] for m in made])
    out = []
    for (ordered, subroot, paths), top in zip(made, tops):
        for r, path in zip(ordered, paths):
            h, whole = leaf(r), path + top
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for a, b in whole:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in whole)), h, h == root))
    return out
