"""Plain versions of the corpus operators over Python lists, to test against."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# languages


def buckets(text, n_buckets, orders, mix):
    """Buckets of the text's character n-grams; runs of other characters than letters are one blank, also at both ends."""
    chars = []
    for c in f" {text or ''} ":
        if c.isalpha():
            low = c.lower()
            chars.append(ord(low) if len(low) == 1 else ord(c))
        elif not chars or chars[-1] != 32:
            chars.append(32)
    out = []
    for k in range(1, orders + 1):
        for i in range(len(chars) - k + 1):
            h = k * 0x27D4EB2F & 0xFFFFFFFF
            for j in range(k):
                h = (h ^ chars[i + j]) * int(mix[j]) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % n_buckets)
    return out


def languages(docs, learned, n_buckets, orders, mix, smoothing):
    """{doc_id: (language, posterior)} of (doc_id, text, lang); ``learned`` tells ids that are learned from."""
    grams = {i: buckets(t, n_buckets, orders, mix) for i, t, _ in docs}
    counts, rows = defaultdict(Counter), Counter()
    for i, t, lang in docs:
        if lang is not None and t is not None and learned(i):
            counts[lang].update(grams[i])
            rows[lang] += 1
    names, out = sorted(rows), {}
    for i, t, _ in docs:
        if not names or not any(c.isalpha() for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        logs = []
        for k in names:
            total = counts[k].total() + smoothing * n_buckets
            logs.append(math.log((rows[k] + 1) / (rows.total() + len(names))) + sum(n * math.log((counts[k][b] + smoothing) / total) for b, n in Counter(grams[i]).items()))
        best = max(range(len(names)), key=lambda j: (logs[j], -j))
        out[i] = (names[best], 1 / sum(math.exp(x - logs[best]) for x in logs))
    return out


# quality


def statistics(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, found = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            found |= {i, i + 1, i + 2}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_stops": sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" for x in lines), "n_repeat_words": len(found),
    }


def votes(s):
    n, lines = s["n_words"], s["n_lines"]

    def vote(bad, good):
        return -1 if bad else 1 if good else 0

    chars = s["word_chars"]
    return (
        vote(chars < 3 * n or chars > 7 * n, 4 * n <= chars <= 6 * n),
        vote(10 * s["n_symbols"] > n, 100 * s["n_symbols"] <= n),
        vote(10 * s["n_dup_lines"] > 3 * lines, lines >= 3 and s["n_dup_lines"] == 0),
        vote(100 * s["n_repeat_words"] > 20 * n, 100 * s["n_repeat_words"] <= 5 * n),
        vote(10 * s["n_stops"] < 7 * lines, 100 * s["n_stops"] >= 98 * lines),
    )


def quality_kept(texts, rounds, start, weight):
    """(base_failed, kept) of each text."""
    stats = [statistics(t) for t in texts]
    patterns = Counter(map(votes, stats))
    good = start["good"]
    theta = [{(k, v): start[k + {-1: "n", 1: "p"}[v]] for k in "gb" for v in (-1, 1)} for _ in range(5)]

    def chance(t, k, v):
        return t[k, v] if v else 1 - t[k, -1] - t[k, 1]

    def posterior(vs):
        odds = math.log(good) - math.log(1 - good) + sum(math.log(chance(t, "g", v)) - math.log(chance(t, "b", v)) for t, v in zip(theta, vs))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        q = {vs: posterior(vs) for vs in patterns}
        total = {"g": sum(n * q[vs] for vs, n in patterns.items()), "b": sum(n * (1 - q[vs]) for vs, n in patterns.items())}
        good = (total["g"] + weight * start["good"]) / (sum(patterns.values()) + weight)
        theta = [{(k, v): (sum(n * (q[vs] if k == "g" else 1 - q[vs]) for vs, n in patterns.items() if vs[i] == v) + weight * start[k + {-1: "n", 1: "p"}[v]]) / (total[k] + weight) for k in "gb" for v in (-1, 1)} for i in range(5)]
    failed = [s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"] for s in stats]
    return [(f, not f and posterior(votes(s)) >= 0.5) for f, s in zip(failed, stats)]


# line dedup


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def line_dedup(docs, min_chars=30):
    """{doc_id: (numbers of the removed lines, text)}; ids are distinct. Lines with a word take part, from ``min_chars`` on
    also with one edit."""
    docs = sorted(docs, key=lambda d: d[0])
    first, by_size = {}, defaultdict(list)
    for i, (_, text) in enumerate(docs):
        for no, line in enumerate((text or "").split("\n")):
            if WORD.search(line) and line not in first:
                first[line] = (i, no)
                by_size[len(line)].append(line)
    near = {x for x in first if len(x) >= min_chars and any(len(y) >= min_chars and first[y] < first[x] and one_edit(x, y) for n in (-1, 0, 1) for y in by_size[len(x) + n])}
    out = {}
    for i, (doc_id, text) in enumerate(docs):
        lines = (text or "").split("\n")
        gone = [no for no, x in enumerate(lines) if WORD.search(x) and (x in near or first[x] != (i, no))]
        out[doc_id] = (gone, text if not gone else "\n".join(x for no, x in enumerate(lines) if no not in gone))
    return out


# near-duplicates


def fingerprint(text, shingle=3):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def groups(marks):
    """{doc_id: (fingerprint, component_id)} of {doc_id: fingerprint}."""
    ids, head = sorted(marks), {i: i for i in marks}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: (marks[i], find(i)) for i in ids}


def similar(docs, shingle=5, percent=80):
    """Ids of the first document of each group; ids are distinct. Groups connect equal words or similar shingle sets."""
    docs, post, head, equal = sorted(docs), defaultdict(list), {}, {}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    sets = {}
    for i, t in docs:
        w, head[i] = WORD.findall(lower(t)), i
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        common = Counter(m for s in sets[i] for m in post[s])
        near = [m for m, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[m]) - n)]
        near.append(equal.setdefault(tuple(w), i))
        for s in sets[i]:
            post[s].append(i)
        for m in near:
            x, y = sorted((find(i), find(m)))
            head[y] = x
    return [i for i, _ in docs if find(i) == i]


# decontamination


def tokens(text, edge, number, number_words, units):
    """(value, kind) of each token: L literal, N number, U unit, P name."""
    out, starts = [], True
    for line in (text or "").split("\n"):
        starts = True
        for raw in re.split(r"[ \t\r]", line):
            core = edge.sub("", raw)
            if core:
                low = core.lower()
                kind = "N" if number.fullmatch(core) or low in number_words else "U" if low in units else "P" if core[0].isupper() and not starts else "L"
                out.append((low, kind))
                starts = False
            if raw[-1:] and raw[-1] in ".!?:;":
                starts = True
    return out


def one_to_one(pairs):
    pairs = set(pairs)
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def template_matches(docs, items, most=10, least=6, **rules):
    """{doc_id: (items found, most tokens that one item covers)}."""
    own = {}
    for item_id, text in sorted(items):
        if text is not None and text not in own.values():
            own[item_id] = text
    own = {i: tokens(t, **rules) for i, t in own.items()}

    def template(window):
        return tuple(t if t[1] == "L" else t[1] for t in window) if len(window) >= least and 2 * sum(k == "L" for _, k in window) >= len(window) else None

    def exact(window):
        return tuple(v for v, _ in window)

    index = {template: defaultdict(list), exact: defaultdict(list)}
    for i, t in own.items():
        size = min(len(t), most)
        for a in range(len(t) - size + 1) if size else ():
            for way in index:
                if (key := way(t[a : a + size])) is not None:
                    index[way][size, key].append((i, a))
    out, sizes = {}, {min(len(t), most) for t in own.values()} - {0}
    for doc_id, text in docs:
        t, runs = tokens(text, **rules), defaultdict(list)
        for size in sizes:
            for b in range(len(t) - size + 1):
                window = t[b : b + size]
                for way in index:
                    for i, a in index[way].get((size, way(window)), ()):
                        pairs = [(x, y) for x, y in zip(own[i][a : a + size], window) if x[1] != "L"] if way is template else []
                        if one_to_one(pairs):
                            runs[i, size, way, b - a].append((a, pairs))
        best = Counter()
        for (i, size, _, _), found in runs.items():
            found.sort(key=lambda x: x[0])
            stretch = [found[0]]
            for x in [*found[1:], None]:
                if x is None or x[0] > stretch[-1][0] + 1:
                    if one_to_one(p for _, pairs in stretch for p in pairs):
                        best[i] = max(best[i], stretch[-1][0] - stretch[0][0] + size)
                    stretch = []
                stretch.append(x)
        out[doc_id] = (sorted(best), max(best.values(), default=0))
    return out


# repeats


def repeats(texts, length=400):
    """(bytes removed, runs, what stays) of each text."""
    bodies = [(t or "").encode() for t in texts]
    times = Counter(xxhash.xxh3_64_intdigest(b[i : i + length]) for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[xxhash.xxh3_64_intdigest(b[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


# archives


def archive(pages, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to) of each page."""
    bodies = [(i, (h or "").encode()) for i, h in pages]
    largest = {}
    for i, b in bodies:
        if i is not None:
            largest[b] = max(largest.get(b, i), i)
    out = []
    for i, b in bodies:
        revisit = i is not None and len(b) >= min_bytes and i < largest[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", largest[b] if revisit else None))
    return out


# language model


def unigrams(docs, held):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}; ``held`` tells ids that aren't learned from."""
    own = {i: WORD.findall(lower(t)) + [" end"] for i, t in docs}
    counts = Counter(w for i, ws in own.items() if not held(i) for w in ws)
    n, v = counts.total(), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in own.items()}


def bigrams(docs, held, level, strength):
    """{doc_id: score} by the formula; ``level(first, second, count)`` gives the level of a pair that was seen count times."""
    own = {i: [" start", *WORD.findall(lower(t)), " end"] for i, t in docs}
    counts = Counter(w for i, ws in own.items() if not held(i) for w in ws)
    pairs = Counter(p for i, ws in own.items() if not held(i) for p in zip(ws, ws[1:]))
    n, v = counts.total() - counts[" start"], len(counts) - (" start" in counts)
    out = {}
    for i, ws in own.items():
        out[i] = 0.0
        for a, b in zip(ws, ws[1:]):
            share, at = (counts[b] + 0.5) / (n + 0.5 * (v + 1)), level(a, b, pairs[a, b])
            pair = at if at < 2 else 1.4 * 2 ** (at - 1)
            out[i] += math.log10((pair + strength * share) / (max(counts[a], pair) + strength))
    return out
