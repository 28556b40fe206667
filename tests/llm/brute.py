"""Plain Python versions of what the operators must return."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import xxhash


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def contamination(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def fingerprint(t, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    s = [" ".join(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=3):
    """Smallest doc_id reachable for each row ``(doc_id, fingerprint)``."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    v = np.array([f for _, f in fps], np.uint64)
    for a in range(len(v)):
        for b in np.flatnonzero(np.bitwise_count(v[a + 1:] ^ v[a]) <= radius) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(fps))]


def substrings(rows, n=50):
    first = {}
    for i, t in sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda x: x[0]):
        for k in range(len(t) - n + 1):
            first.setdefault(t[k:k + n], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1 if i is not None else 0):
            if first[b[k:k + n]] < i:
                gone[k:k + n] = b"\1" * n
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    five = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    often = {x for x in five if five.count(x) > 1}
    at = {k + j for k, x in enumerate(five) if x in often for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at))


def variants(rows):
    """``word, form, root, n, n_near, form_n`` from every edit of every word."""
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    letters, form, near = sorted({c for w in words for c in w}), {}, {}

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
        return a != b and len(b) - len(a) < 2 and a[i + (len(a) == len(b)):] == b[i + 1:]

    for w, n in words.items():
        if len(w) < 50:
            edits = {w[:i] + w[i + 1:] for i in range(len(w))}
            for c in letters:
                edits |= {w[:i] + c + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1)}
            near[w] = [e for e in edits if e in words and e != w]
        else:
            near[w] = [e for e in words if one_edit(w, e)]
        best = min(near[w], key=lambda e: (-words[e], e), default=None)
        if best and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return [(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()]


def alignment(rows, a, b, a_bytes, b_bytes):
    """Rows of op12: two sweeps over token ends, every pair compared by its ranges."""
    found, count = [], collections.Counter()
    for i, t in rows:
        ids = (a(" " + t), b(t)) if t else ([], [])
        spelled = [[x(k) for k in side] for x, side in zip((a_bytes, b_bytes), ids)]
        if not t or any(b"".join(s) != (" " + t).encode() for s in spelled):
            found.append((i, None))
            continue
        ends = [list(itertools.accumulate(map(len, s))) for s in spelled]
        links = []
        for k, (x, e) in enumerate(zip(ids[0], ends[0])):
            for y, f, s in zip(ids[1], ends[1], spelled[1]):
                if f > e - len(spelled[0][k]) and f - len(s) < e:
                    links.append((x, y))
        groups, at = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(x) for x, e in zip(side, end) if at < e <= cut) for side, end in zip(ids, ends)))
            at = cut
        count.update(set(links))
        found.append((i, (len(ids[0]), len(ids[1]), len(groups), links, sha(";".join(groups)))))
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else
            (i, *f[:3], len(f[3]), sum(count[x] == top[x[0]] for x in f[3]), sum(count[x] for x in f[3]), f[4])
            for i, f in found]
