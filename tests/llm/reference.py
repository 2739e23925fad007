"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    found.sort(key=lambda s: (s[1], order[s[0]]))
    n = [sum(s[0] == k for s in found) for k in order]
    return (*n, sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)))


KINDS = ["assign", "access", "hex", "weak_assign", "weak_access", "user", "endpoint"]
USER = re.compile(ASSIGN.pattern.replace("password|passwd|secret|token|api_?key", "user_?name|user|login|account|client_id|access_key_id"), re.ASCII)
ENDPOINT = re.compile(r"""(?i:(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+)""", re.ASCII)


def linked(text, scope=200):
    """All spans, and the weak ones with their partners, by trying every pair."""
    found = [(m.start(), m.end(), 0 if len(m[2]) >= 12 else 3) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1 if len(m[0]) >= 18 else 4) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 8]
    found += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 5) for m in USER.finditer(text) if len(m[2]) >= 3]
    found += [(m.start(), m.end(), 6) for m in ENDPOINT.finditer(text)]
    show = lambda s, e, k: f"{KINDS[k]}:{s}:{e}"

    def partner(s, e, kinds):
        near = [(s - y, 0, -x, -k, (x, y, k)) for x, y, k in found if k in kinds and y <= s and s - y <= scope]
        near += [(x - e, 1, y, k, (x, y, k)) for x, y, k in found if k in kinds and x >= e and x - e <= scope]
        return show(*min(near)[4]) if near else None

    spans, links = [], []
    for s, e, k in sorted(found, key=lambda f: (f[0], f[2], f[1])):
        needs = {3: [(1, 4, 5)], 4: [(0, 2, 3)], 5: [(0, 2, 3)], 6: [(0, 2, 3), (1, 4, 5)]}.get(k, [])
        parts = [partner(s, e, kinds) for kinds in needs]
        if None in parts:
            continue
        spans.append(show(s, e, k))
        if needs:
            links.append(show(s, e, k) + ">" + "+".join(parts))
    return ",".join(spans), ",".join(links)


def substring(rows, window=50):
    owner = {}
    key = lambda d: (d is None, d or 0)
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            owner[k] = min(owner.get(k, key(d)), key(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def exact(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = [None] * len(rows)
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out[m[3]] = (rows[m[3]][0], rows[best[3]][0], len(members), m[3] == best[3] or None, sha(text))
    return out


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def simhash(rows, radius=4):
    fps = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    roots = closure(len(fps), links)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, roots)]


def mixed(x):
    """splitmix64's finaliser."""
    m = 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def wide_fingerprint(text, shingle=5, bits=512):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    counts = np.zeros(bits, int)
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        word = [h] + [mixed((h + i * 0x9E3779B97F4A7C15) % 2**64) for i in range(1, bits // 64)]
        counts += np.unpackbits(np.array(word, "<u8").view(np.uint8), bitorder="little")
    return int.from_bytes(np.packbits(2 * counts > len(s), bitorder="little").tobytes(), "little")


def wide_groups(texts, radius, similarity=0.8):
    """Which texts are joined by links: fingerprints of at most radius different bits, and shingles as similar as that."""
    fps = [wide_fingerprint(t) for t in texts]
    near = lambda i, j: fps[i] == fps[j] or (fps[i] ^ fps[j]).bit_count() <= radius and jaccard(texts[i] or "", texts[j] or "") >= similarity
    return closure(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if near(i, j)])


def jaccard(a, b, shingle=5):
    x, y = ({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (t.encode().lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def mix(rows, share=1.5, limit=2, seed="mix"):
    """rows (doc_id, source, words) -> (size, source_size, target, copies) each, by sums in order of size within a source."""
    total = defaultdict(int)
    for _, s, n in rows:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, goal = {}, set(order), share * sum(total.values())
    while free:
        level = goal / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > limit * total[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s], goal = float(limit * total[s]), goal - limit * total[s]
        free -= over
    place, out = defaultdict(int), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][2], rows[i][0] is None, rows[i][0] or 0)):
        _, s, n = rows[i]
        u = int(hashlib.md5(f"{seed}:{'n' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        place[s] += 1
        each = target[s] / total[s] if total[s] else 0.0
        copies = int(np.floor(each * place[s] + u) - np.floor(each * (place[s] - 1) + u))
        out[i] = (n, total[s], target[s], copies)
    return out


def vectors(rows, least=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, i in enumerate(ok):
        for j in ok[:n]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links.append((i, j))
    roots = closure(len(rows), links)
    degree = [0] * len(rows)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    ids = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            ids[r] = min(ids.get(r, d), d)
    return [(d, n, ids.get(r), d is not None and d == ids.get(r)) for (d, _), n, r in zip(rows, degree, roots)]
