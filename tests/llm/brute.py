"""Plain versions of the operators, for small inputs: no hashing, no pruning, all pairs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size):
    ws = words_of(lower(text))
    if len(ws) < size:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def shingle_set_exact(text, size):
    """The same without lower case."""
    ws = words_of(text)
    if len(ws) < size:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def near_duplicates(rows, size, percent=80):
    """rows: (doc_id, text) with unique ids -> {doc_id: (n, component, kept)}."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = set()
    for group in holders.values():
        for n, a in enumerate(group):
            for b in group[n + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def substring_dedup(rows, window=50):
    """rows: (doc_id, text) -> list of (doc_id, words, kept words)."""
    low = {}
    split = [(i, words_of(t)) for i, t in rows]
    for i, ws in split:
        for p in range(len(ws) - window + 1):
            k = tuple(ws[p : p + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - window + 1):
            if low[tuple(ws[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(ws), [w for k, w in enumerate(ws) if k not in gone]))
    return out


def line_dedup(rows, size=3, words=8):
    """rows: (doc_id, text), unique ids -> {doc_id: text}."""

    def runs(dense):
        for p in range(len(dense)):
            for n in range(1, size + 1):
                run = tuple(x for _, x in dense[p : p + n])
                if len(run) == n and (n == size or sum(len(re.split(" +", x)) for x in run) >= words):
                    yield p, run

    first, dense = {}, {}
    for i, text in sorted(rows):
        lines = [(n, x.strip(" ")) for n, x in enumerate((text or "").split("\n"))] if text is not None else []
        dense[i] = [(n, x) for n, x in lines if x]
        for p, run in runs(dense[i]):
            first.setdefault(run, (i, p))
    out = {}
    for i, text in rows:
        gone = set()
        for p, run in runs(dense[i]):
            d, q = first[run]
            if d < i or p - q >= len(run):
                gone.update(n for n, _ in dense[i][p : p + len(run)])
        out[i] = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    return out


def edited(rows):
    """rows: (doc_id, text) -> {doc_id: (n_chars, sha256 of the edited text, edited text)}."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, t) in enumerate(rows):
        k = len(t) // 4
        e = t[: len(t) - k] + rows[(n + 1) % len(rows)][1][:k]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), e)
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def periodic_runs(ws):
    """All (start, length, period) by start, then period, by trying every period at every place."""
    found = {}
    for q in range(1, len(ws) // 4 + 1):
        s = 0
        while s + q < len(ws):
            e = s
            while e + q < len(ws) and ws[e] == ws[e + q]:
                e += 1
            if e > s and e - s + q >= max(6, 4 * q):
                found.setdefault((s, e + q), q)  # the least period comes first
            s = max(e, s) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def fields_digest(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_path(digests, place):
    """(root, [(siblings before, siblings after)] from the leaf's level up)."""
    path = []
    while len(digests) > 1:
        low = place // 16 * 16
        run = digests[low : low + 16]
        path.append((run[: place - low], run[place - low + 1 :]))
        digests = [_h(digests[i : i + 16]) for i in range(0, len(digests), 16)]
        place //= 16
    return digests[0], path


def merkle(rows, tampered):
    """rows: (doc_id, source, lang, n_chars, text) -> [(doc_id, leaf, subroot, root, proof, folded)]; tampered: text or nothing by id."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, fields_digest(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
    subroots = [merkle_path([x[2] for x in groups[s]], 0)[0] for s in order]
    out = []
    for i, s in enumerate(order):
        root, above = merkle_path(subroots, i)
        for j, (_, _, leaf, r) in enumerate(groups[s]):
            subroot, path = merkle_path([x[2] for x in groups[s]], j)
            text = tampered(r)
            folded = leaf if text is None else fields_digest((*r[:4], text))
            for before, after in path + above:
                folded = _h([*before, folded, *after])
            out.append((r[0], leaf, subroot, root, _h([d for b, a in path + above for d in b + a]), folded))
    return out
