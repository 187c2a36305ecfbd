"""Plain versions of the operators' contracts, to hold the queries against."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

WS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def shingle_set(text, k=5):
    w = WS.findall(ascii_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs):
    """doc_id -> (n_shingles, component_id) over all pairs."""
    sets = {}
    for i, t in docs:
        sets[i] = shingle_set(t)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    ids = sorted(sets, key=lambda i: len(sets[i]))
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if len(sets[j]) * 80 > 100 * len(sets[i]):
                break
            if sets[i]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def join_rows(docs):
    """For each row: doc_id, n_shingles, component_id, n_links, n_texts_linked; rows of an id are one node, rows without one stand apart."""
    sets = [shingle_set(t) for _, t in docs]
    link = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    up = {i: i for i, _ in docs if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, _), a in zip(docs, sets, strict=True):
        for (j, _), b in zip(docs, sets, strict=True):
            if i is not None and j is not None and link(a, b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    out = []
    for k, ((i, _), a) in enumerate(zip(docs, sets, strict=True)):
        near = [m for m, (j, _) in enumerate(docs) if m != k and j is not None and link(a, sets[m])]
        same = [root(docs[m][0]) for m in near if sets[m] == a]
        known = i is not None or same
        texts = {sets[m] for m in near} - {a} if known else set()
        out.append((i, len(a), root(i) if i is not None else min(same, default=None), len(near) if known else 0, len(texts)))
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    t = text or ""
    w = WS.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WS.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(tri)
    covered = {i + d for i, x in enumerate(tri) if many[x] > 1 for d in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    """n_words, n_base, first, last, labels"""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    at, labels = [], set()
    for p, label in PHRASES.items():
        q = p.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def merkle(docs):
    """doc_id -> n_chars, edited_sha256"""
    rows = sorted((i, t or "") for i, t in docs)
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = (len(t), sha(t[: len(t) - half] + after[:half]))
    return out


def merkle_tree(text):
    """root hash; sections, each (hash, paragraphs), each (hash, leaves), each (hash, length)"""
    t, sections = text or "", []
    for s in re.split(r"\n[ \t\r]*\n", t):
        paragraphs = []
        for p in s.split("\n"):
            leaves = [(sha(x), len(x)) for x in re.split(r"(?<=[.!?\n]) ", p)]
            paragraphs.append((sha("".join(h for h, _ in leaves)), leaves))
        sections.append((sha("".join(h for h, _ in paragraphs)), paragraphs))
    return sha("".join(h for h, _ in sections) + "".join(re.findall(r"\n[ \t\r]*\n", t))), sections


def tree_likeness(a, b):
    """By descent: equal nodes count whole, unequal ones are opened; each hash once, by the length of its leaves."""
    size = lambda x: x[1] if isinstance(x[1], int) else sum(map(size, x[1]))
    equal, x, y = 0, a, b
    for depth in range(3):
        common = {h for h, _ in x} & {h for h, _ in y}
        equal += sum({n[0]: size(n) for n in x if n[0] in common}.values())
        x, y = ([n for n in z if n[0] not in common] for z in (x, y))
        if depth < 2:
            x, y = ([c for n in z for c in n[1]] for z in (x, y))
    rest = sum(sum({n[0]: size(n) for n in z}.values()) for z in (x, y))
    return 2 * equal / (2 * equal + rest) if equal or rest else 1.0


def chat(rows):
    """conv_id -> n_turns, turns_sha256, loss_chars, loss_sha256"""
    convs = {}
    for c, n, role, text in [*rows, (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]:
        convs.setdefault(c, []).append((n, role, text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def water_fill(sizes, weights, epochs, max_repeat):
    """Targets by weight; none above ``max_repeat`` times its size, the excess dealt again by weight."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), epochs * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > max_repeat * sizes[i]]
        for i in full or open_:
            target[i] = float(max_repeat * sizes[i]) if full else left * weights[i] / weight
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


def mix(rows, weights, epochs, max_repeat, block_words, min_blocks, buckets):
    """rows: (doc_id, source, size, key), keys all different -> key: words taken. Word by word, slot by slot."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    streams = {s: [k for _, k, n in sorted((r[3] % buckets, r[3], r[2]) for r in rows if r[1] == s) for _ in range(n)] for s in names}
    target = dict(zip(names, water_fill([len(streams[s]) for s in names], [weights[i % len(weights)] for i in range(len(names))], epochs, max_repeat)))
    blocks = {s: min(len(x), max(min_blocks, -(-len(x) // block_words))) for s, x in streams.items()}
    quota = {s: -int(-(target[s] * blocks[s] / len(x)) // 1) if x else 0 for s, x in streams.items()}
    live = [s for s in names if quota[s]]
    drawn = [s for s in live for _ in range(quota[s])]
    rank, taken = dict.fromkeys(live, 0), dict.fromkeys((r[3] for r in rows), 0)
    for k in range(2 * len(drawn) + 64 * len(live)):
        s = drawn[int(k * ((5**0.5 - 1) / 2) % 1 * len(drawn))]
        if rank[s] < quota[s]:
            turn, block = divmod(rank[s], blocks[s])
            for place, key in enumerate(streams[s]):
                if place * blocks[s] // len(streams[s]) == block and turn * len(streams[s]) + place < int(target[s]):
                    taken[key] += 1
        rank[s] += 1
    return taken


def toxicity_score(text, part, bias, slope, offset, window, buckets, shortest, longest):
    """The strongest window's mean over words of the mean over their n-grams' parts, on the score's curve; by plain loops."""
    words, best = re.findall(r"\w+", (text or "").lower()), bias
    means = []
    for w in words:
        x = f"<{w}>"
        grams = [x] + [x[i : i + n] for n in range(shortest, longest + 1) for i in range(len(x) - n + 1)]
        means.append(sum(float(part[zlib.crc32(g.encode()) % buckets]) for g in grams) / len(grams))
    width = min(window, len(words))
    if words:
        best = max(bias + sum(means[i : i + width]) / width for i in range(len(words) - width + 1))
    return 1 / (1 + math.exp(-min(60, max(-60, slope * best + offset))))


def ngrams(text):
    """Counts of 1- to 3-grams of letters, marks on them and word ends."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    kept = " " + " ".join(kept.split(" ")) + " "
    kept = re.sub(" +", " ", kept)
    return Counter(g for n in (1, 2, 3) for g in (kept[i : i + n] for i in range(len(kept) - n + 1)) if g != " ")


def rank_order(counts, size):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}


def language(text, profiles, size):
    """The language of the least out-of-place distance, the first by name at a tie; und without a letter."""
    if not any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()):
        return "und"
    mine = rank_order(ngrams(text), size)
    distance = lambda p: sum(abs(k - p[g]) if g in p else size for g, k in mine.items())
    return min(sorted(profiles), key=lambda lang: distance(profiles[lang]))
