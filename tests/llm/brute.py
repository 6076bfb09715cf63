"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]+")
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def repeats(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (doc_id, _), r in zip(rows, raw):
        gone = [False] * (len(r) + 1)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(r)))
        out.append((doc_id, len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return out


def base_secrets(text):
    spans = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        spans += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = Counter(s[2] for s in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)))


def targets(sizes, weights, share=1.5, repeat=2):
    """Round by round: what exceeds a source's bound is shared again by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] > repeat * sizes[i]}
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = repeat * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def exact(rows):
    groups = defaultdict(list)
    norm = [BLANK.sub(" ", t or "") for _, t in rows]
    for n, ((doc_id, _), text) in enumerate(zip(rows, norm)):
        groups[text].append((doc_id is None, doc_id or 0, doc_id))
    return [(doc_id, min(groups[text])[2], len(groups[text]), sha(text)) for (doc_id, _), text in zip(rows, norm)]


def contaminated(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        for g in [tuple(w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)] if w else []:
            wins[g].add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w = word.findall((text or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for size in {len(g) for g in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit[k : k + size] = [True] * size
                    found |= wins[tuple(w[k : k + size])]
        out.append((doc_id, len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return out


def shingle_set(text, size=5):
    w = NOT_BLANK.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(items, links):
    """item to the least item reachable."""
    parent = {i: i for i in items}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in items}


def near_rows(rows, percent=75):
    """Set of each row, and pairs of rows whose sets are near."""
    sets = [shingle_set(t) for _, t in rows]
    holders, links = defaultdict(list), []
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        links += [(j, i) for j, common in shared.items() if 100 * common >= percent * (len(s) + len(sets[j]) - common)]
        for g in s:
            holders[g].append(i)
    return sets, links


def near(rows, percent=75):
    """Per row: doc_id, set size, least doc_id reachable; rows of one doc_id are one document."""
    sets, links = near_rows(rows, percent)
    tops = groups({i for i, _ in rows}, [(rows[a][0], rows[b][0]) for a, b in links])
    return [(i, len(s), tops[i]) for (i, _), s in zip(rows, sets)]


def kept(rows, percent=75):
    """doc_ids that stay: one row per group of near texts, and each distinct row without words."""
    sets, links = near_rows(rows, percent)
    tops = groups(range(len(rows)), links)
    least = defaultdict(list)
    for n, top in tops.items():
        least[top if sets[n] else ("alone", *rows[n])].append(rows[n][0])
    return sorted(min(ids) for ids in least.values())


def variants(rows, typo=31, least=7, factor=10):
    """word to (form, root, n, n_near, form_n)."""
    total = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % typo == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    n = {w: c for w, c in total.items() if len(w) >= least and c >= 2}
    holders = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holders[w[:i] + "?" + w[i + 1 :]].add(w)
            holders[w[:i] + w[i + 1 :]].add(w)
        holders[w].add(w)
    near = defaultdict(set)
    for key, words in holders.items():
        for a in words:
            near[a] |= {b for b in words if b != a and (key in (a, b) or "?" in key)}
    form = {}
    for w in n:
        best = min(((-n[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= factor * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def merkle(rows, tampered):
    """rows are (doc_id, source, lang, n_chars, text); one result per row, by leaf order."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(cell, r)))
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))

    def grow(nodes, paths):
        """The root; every path gets (before, after) per level."""
        members = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            above, joined = [], []
            for start in range(0, len(nodes), 8):
                run = nodes[start : start + 8]
                for k in range(len(run)):
                    for m in members[start + k]:
                        paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
                above.append(sha("".join(run)))
                joined.append([m for group in members[start : start + 8] for m in group])
            nodes, members = above, joined
        return nodes[0]

    tops, done = [], []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        order = sorted(trees[lang], key=lambda x: x[:3])
        paths = [[] for _ in order]
        tops.append(grow([x[2] for x in order], paths))
        done.append((order, paths))
    ends = [[] for _ in tops]
    root = grow(tops, ends) if tops else None
    out = []
    for (order, paths), end, top in zip(done, ends, tops):
        for (_, _, own, r), path in zip(order, paths):
            node = leaf((*r[:4], r[4].translate(LOWER))) if tampered(r[0]) and r[4] is not None else own
            for before, after in path + end:
                node = sha(before + node + after)
            out.append((r[0], own, top, root, sha("".join(a + b for a, b in path + end)), node, node == root))
    return out


def warc(rows):
    groups = defaultdict(list)
    for page_id, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = []
    for data, ids in groups.items():
        first = max(ids, key=lambda i: (i is not None, i or 0))
        ids.remove(first)
        digest = b32encode(hashlib.sha1(data).digest()).decode()
        out += [(first, len(data), digest, "response", None)] + [(i, len(data), digest, "revisit", first) for i in ids]
    return out
