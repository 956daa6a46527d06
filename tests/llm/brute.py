"""Plain versions of the operators' results, row by row, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, size: int) -> frozenset:
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORDS.findall(t)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_components(rows: list[tuple], size: int, share: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) of all rows (doc_id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    posting = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posting[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        counts = Counter(j for x in s for j in posting[x] if j > i)
        for j, c in counts.items():
            if 100 * c >= share * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)]


def repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by looking up every string of ``length`` bytes."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen: Counter = Counter(raw[i:i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def exact(rows: list[tuple]) -> list[tuple]:
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    members = defaultdict(list)
    for (d, _), n in zip(rows, norm):
        members[n].append(d)
    return [(d, min(members[n]), len(members[n]), d == min(members[n]), hashlib.sha256(n.encode()).hexdigest()) for (d, _), n in zip(rows, norm)]


def targets(sizes: dict, weights=(5, 2, 1), cap=3.0) -> dict:
    """Reshare by weight until none is above ``cap`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        new = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full |= new


def _h(*values: str) -> str:
    return hashlib.sha256("".join(values).encode()).hexdigest()


def _level(nodes: list[str], arity: int) -> list[str]:
    return [_h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]


def merkle(rows: list[tuple], tampered: set, arity: int = 2) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: _h(*map(field, (d, s, lang, n, t)))
    trees = defaultdict(list)
    for row in rows:
        d, t, lang, s, n = row
        changed = leaf(d, t, lang, s, None if n is None else n + 1) if d in tampered else None
        trees[(lang is not None, (lang or "").encode())].append((d is not None, d or 0, leaf(*row), changed or leaf(*row), d))
    names = sorted(trees)

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append(_level(levels[-1], arity))
        return levels

    own = {k: climb([x[2] for x in sorted(trees[k])]) for k in names}
    top = climb([own[k][-1][0] for k in names])
    out = []
    for i, k in enumerate(names):
        for rank, (_, _, plain, changed, d) in enumerate(sorted(trees[k])):
            others, x = [], changed
            for levels, r in ((own[k], rank), (top, i)):
                for nodes in levels[:-1]:
                    run = nodes[r // arity * arity:r // arity * arity + arity]
                    rest = run[:r % arity] + run[r % arity + 1:]
                    others += rest
                    x = _h(*run[:r % arity], x, *run[r % arity + 1:])
                    r //= arity
            out.append((d, plain, own[k][-1][0], top[-1][0], _h(*others), x, x == top[-1][0]))
    return out


def windows(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_words, removed spans, kept text) of rows (doc_id, text); null ids are the largest."""
    order = lambda d: (d is None, d or 0)
    docs = [(d, WORDS.findall(t or "")) for d, t in rows]
    first: dict = {}
    for d, w in docs:
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            first[key] = min(first.get(key, order(d)), order(d))
    out = []
    for d, w in docs:
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < order(d):
                gone[i:i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((d, len(w), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def audit(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    """All columns of the filter audit, document by document, of rows (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    order = lambda d: (d is None, d or 0)
    first: dict = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", order(d)), order(d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    docs = defaultdict(list)
    for d, t, lang in rows:
        w, t = WORDS.findall(t or ""), t or ""
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": first[t] < order(d)}
        docs[lang or ""].append((d, {f for f, x in fails.items() if x}))
    out = []
    for part, held in docs.items():
        steps, total = [], Counter()
        for o in permutations("ABCDE"):
            left = held
            for k, f in enumerate(o):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in held if f in x[1]]
                total[f] += len(gone)
                steps.append(("".join(o), k + 1, f, len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in held),
                              sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out += [(part, o, k, *rest, total[f]) for o, k, f, *rest in steps]
    return out
