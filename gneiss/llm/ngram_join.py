"""N-gram Jaccard join by signature trees: components and numbers of its links.

Texts are sets of hashed 5-word shingles; two link at ``overlap >= 0.8 * union`` (parameters).
Nothing is sampled away: every pair of different sets at the threshold ends in one component.

1. Equal sets collapse to a class, named by its smallest doc_id. A class is one node of all that follows.
2. Near copies are tied early: classes that share a minimum under one of a few hash orders are compared
   with the first class of their group (a star, linear in the group) and linked classes get a
   common label. This only saves work.
3. The top of the trees is a routing level: sets that reach the threshold share a token among the
   first ``n - ceil(0.8 n) + 1`` in any fixed order. The order puts tokens that are frequent in a
   bounded sample last, the rest by hash. A group of sets under one such token, in which more than
   one label is left, gets a signature tree: leaves are bitmaps of the sets, inner nodes hold their
   OR and the range of sizes. The dual traversal drops a pair of nodes if their sizes can't match,
   if the common bits can't reach the needed overlap, or if all their sets already have one label.
   Groups above ``group_rows`` are cut into blocks: only sets outside the group's largest label
   meet all others, block by block, so no task holds a group.
4. Surviving pairs are verified on the full sets, and the links' components are found by label
   propagation with pointer jumping over written tables. A group with many more surviving pairs than sets first
   has each set's likeliest pairs verified, by the signatures' overlap; it meets again with the labels that come of them, and
   with more pairs a set, until none is held back.
5. Links lie within components, so the number of each document's links comes from signature trees over
   the classes of each component, compared whole and verified token by token in the same task, which returns
   counts, not pairs. Components above ``block_rows`` classes or ``block_tokens`` tokens are cut into blocks that meet
   two by two: a task holds two blocks, and a component of m classes costs up to the square of m / block_rows tasks,
   as many as its links need.

Hashes have 64 bits (classes 128). Tables between the steps lie in the shared folder.

Defined results: null text or no words: an empty set, linked with nothing; fewer than ``k`` words:
one shingle of them all; repeated rows: one class. Rows that share a doc_id are one node, whatever their texts: they tie
the classes of their texts together and have one component_id; n_shingles, class_id and n_links are those of each
row's own text. A null doc_id is in no component (null, unless an equal text has an id) and counts for no other row's links.
Empty table: empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch
from gneiss.shipping import ship


@dataclass(frozen=True)
class JoinParams:
    k: int = 5
    #: threshold = num / den
    num: int = 4
    den: int = 5
    #: documents looked at to find frequent tokens; it changes the order of tokens, never the result
    sample_docs: int = 4000
    sample_hits: int = 3
    orders: int = 3
    group_rows: int = 64
    block_rows: int = 1024
    #: pairs a set that a group may propose in one round, in the first round; it grows from round to round
    few: int = 2
    more: int = 8
    #: tokens of a component's block, in the count of links
    block_tokens: int = 2_000_000
    fan_out: int = 4


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, words split by ASCII white space."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h)
    if n < k:
        return mixed(np.array([(h * ODD[32 : 32 + n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = h[: n - k + 1] * ODD[0]
    for j in range(1, k):
        out = out + h[j : n - k + 1 + j] * ODD[j]
    return np.unique(mixed(out))


def prefix_length(n: int, p: JoinParams) -> int:
    return n - -(-n * p.num // p.den) + 1


def bit_count(n: int) -> int:
    """Bits of a set's signature: a power of two, about four to eight a token."""
    return max(64, 1 << (4 * n - 1).bit_length())


def signature(tokens: np.ndarray) -> bytes:
    m = bit_count(len(tokens))
    bits = np.zeros(m, np.uint8)
    bits[(tokens % np.uint64(m)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(signature_bytes: bytes, words: int) -> np.ndarray:
    """A signature OR-folded to ``words`` 64-bit words; places are taken modulo a power of two, so folding keeps its meaning."""
    a = np.frombuffer(signature_bytes, np.uint64)
    return a if len(a) == words else np.bitwise_or.reduce(a.reshape(-1, words), axis=0)


class SignatureTree:
    """Levels of nodes, from single sets up: OR-combined bits, size range, slack and label of each node.

    slack: the largest number of a set's tokens that fell on an occupied bit; label -1: several.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, fan_out: int):
        self.fan_out = fan_out
        slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, slack, labels)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, s, l = self.levels[-1]
            at = np.arange(0, len(b), fan_out)
            low, high = np.minimum.reduceat(l, at), np.maximum.reduceat(l, at)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(s, at), np.where(low == high, low, -1)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node of ``level`` its nodes one level below: (row of ``nodes``, child)."""
        below = len(self.levels[level - 1][0])
        c = nodes[:, None] * self.fan_out + np.arange(self.fan_out)
        ok = c < below
        return np.nonzero(ok)[0], c[ok]


def may_match(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, p: JoinParams, leaf: bool) -> np.ndarray:
    """Which pairs of nodes can hold a pair of sets at the threshold with different labels."""
    xb, xlo, xhi, xs, xl = x
    yb, ylo, yhi, ys, yl = y
    ok = (p.den * xhi[i] >= p.num * ylo[j]) & (p.den * yhi[j] >= p.num * xlo[i]) & ~((xl[i] == yl[j]) & (xl[i] >= 0))
    at = np.nonzero(ok)[0]
    i, j = i[at], j[at]
    if leaf:
        a, b = xb[i], yb[j]
        best = np.minimum(xlo[i] - np.bitwise_count(a & ~b).sum(axis=1), ylo[j] - np.bitwise_count(b & ~a).sum(axis=1))
    else:
        best = np.bitwise_count(xb[i] & yb[j]).sum(axis=1).astype(np.int64) + np.minimum(xs[i], ys[j])
    ok[at] = best.astype(np.int64) * (p.num + p.den) >= p.num * (xlo[i] + ylo[j])
    return ok


def dual(x: SignatureTree, y: SignatureTree, p: JoinParams, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of x, of y) that no bound excludes. Pairs of nodes wait on a stack, in chunks of bounded size."""
    out_i, out_j = [], []
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        a, b, i, j = stack.pop()
        if len(i) > chunk:
            stack += [(a, b, i[s : s + chunk], j[s : s + chunk]) for s in range(0, len(i), chunk)]
            continue
        ok = may_match(x.levels[a], y.levels[b], i, j, p, a == 0 and b == 0)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if a == 0 and b == 0:
            out_i.append(i)
            out_j.append(j)
        elif a >= b:
            row, child = x.children(a, i)
            stack.append((a - 1, b, child, j[row]))
        else:
            row, child = y.children(b, j)
            stack.append((a, b - 1, i[row], child))
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def scored_pairs(sid: np.ndarray, n: np.ndarray, label: np.ndarray, bits: list, left: np.ndarray, right: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (smaller id, larger id) between the left and the right rows of one group, and how alike their signatures are.

    Sets are met by size class (powers of two): a set's partners lie in its own class or the next.
    """
    cls = np.frexp(n.astype(np.float64))[1]
    out_a, out_b, out_s = [], [], []
    for c in np.unique(cls):
        here = (cls == c) | (cls == c + 1)
        words = bit_count(int(n[cls == c].min())) // 64
        rows = np.nonzero(here)[0]
        rows = rows[np.lexsort((label[rows], n[rows]))]
        sides = [rows[left[rows]], rows[right[rows]]]
        if not all(len(s) for s in sides):
            continue
        trees = [SignatureTree(np.stack([fold(bits[r], words) for r in s]), n[s], label[s], p.fan_out) for s in sides]
        i, j = dual(*trees, p)
        a, b = sides[0][i], sides[1][j]
        ok = (sid[a] != sid[b]) & ((cls[a] == c) | (cls[b] == c))
        x, y, i, j, a, b = trees[0].levels[0][0], trees[1].levels[0][0], i[ok], j[ok], a[ok], b[ok]
        common = [np.bitwise_count(x[i[k : k + 8192]] & y[j[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), 8192)]
        out_a.append(sid[a])
        out_b.append(sid[b])
        out_s.append(np.concatenate([np.empty(0, np.int64), *common]) / (n[a] + n[b]))
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b), np.concatenate(out_s)


def group_pairs(sid: np.ndarray, n: np.ndarray, label: np.ndarray, bits: list, left: np.ndarray, right: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``scored_pairs``."""
    return scored_pairs(sid, n, label, bits, left, right, p)[:2]


def likeliest(a: np.ndarray, b: np.ndarray, score: np.ndarray, few: int) -> np.ndarray:
    """Which pairs are among the ``few`` of the best score of one of their sets; ties by the other set's number."""
    one, other, at = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.arange(len(a)), 2)
    order = np.lexsort((other, -np.tile(score, 2), one))
    start = np.nonzero(np.diff(one[order], prepend=-1))[0]
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    out = np.zeros(len(a), bool)
    out[at[order[place < few]]] = True
    return out


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[k] and b[k]; ``a`` is sorted."""
    size = np.array([len(x) for x in sets], np.int64)
    start = np.cumsum(size) - size
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(int(flat.max()) + 1, np.uint8), np.zeros(len(a), np.int64)
    edge = np.concatenate([np.nonzero(np.diff(a, prepend=-1))[0], [len(a)]])
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        mine = flat[start[a[s]] : start[a[s]] + size[a[s]]]
        mark[mine] = 1
        # the sets on the other side, some at a time
        for k in range(s, e, 256):
            other = b[k : min(e, k + 256)]
            n = size[other]
            at = np.cumsum(n) - n
            token = np.repeat(start[other] - at, n) + np.arange(n.sum())
            out[k : k + len(other)] = np.add.reduceat(mark[flat[token]].astype(np.int64), at)
        mark[mine] = 0
    return out


def linked(sets: list[np.ndarray], rows: np.ndarray, left: np.ndarray, right: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """For each of some different sets, none empty: how many sets it links with, and how many rows those stand for. Pairs of a left and a right set count, each once."""
    n, at = np.array([len(x) for x in sets], np.int64), np.arange(len(sets))
    a, b = group_pairs(at, n, at, [signature(x) for x in sets], left, right, p)
    a, b = np.divmod(np.unique(a * len(sets) + b), len(sets))
    if len(a):
        ok = overlaps(sets, a, b) * (p.num + p.den) >= p.num * (n[a] + n[b])
        a, b = a[ok], b[ok]
    both, other = np.concatenate([a, b]), np.concatenate([b, a])
    return np.bincount(both, minlength=len(sets)), np.bincount(both, rows[other], minlength=len(sets)).astype(np.int64)


#: The columns that name a group, or two blocks of one.
KEYS = ["g1", "g2", "g3"]


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of frames that are sorted by ``keys``, whole ones a frame at a time."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        if not len(f):
            continue
        k = f[keys].to_numpy()
        same = (k == k[-1]).all(axis=1)
        cut = len(f) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = f.iloc[cut:].reset_index(drop=True)
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def component_labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): each linked node with the smallest node it reaches. ``links``: a, b."""
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(now, both["b"] == now["v"]).groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, now["v"] == near["a"]).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("v").alias("w"), F.col("label").alias("far"))
        new = step.join(jump, step["label"] == jump["w"], "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        new = scratch.keep(new, "labels")
        changed = new.where("label <> old").limit(1).count()
        scratch.drop(now)
        now = new
        if not changed:
            scratch.drop(both)
            return now.select("v", "label")


class NgramJoin:
    """The join over ``documents`` (doc_id, text); ``components()`` gives its result."""

    def __init__(self, documents: DataFrame, params: JoinParams = JoinParams()):
        # a hash of the text tells rows of equal id apart
        self.docs, self.p = documents.select("doc_id", "text", F.xxhash64("text").alias("key")), params
        self.spark, self.scratch = documents.sparkSession, Scratch(documents.sparkSession)
        ship(self.spark)

    def frequent(self) -> np.ndarray:
        """Sorted hashes of the tokens found in ``sample_hits`` or more different sets of a sample of about ``sample_docs`` documents."""
        p, k = self.p, self.p.k
        count = self.docs.select("doc_id").count()
        if not count:
            return np.empty(0, np.uint64)
        share = min(1.0, p.sample_docs / count)

        def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                sets = [shingles(t, k) for t in f["text"]]
                if sets:
                    yield pd.DataFrame({"token": np.concatenate(sets).view(np.int64), "set": np.concatenate([np.full(len(s), s.sum(dtype=np.uint64) if len(s) else 0, np.uint64) for s in sets]).view(np.int64)})

        chosen = self.docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
        rows = chosen.mapInPandas(tokens, "token bigint, set bigint").distinct().groupBy("token").count().where(F.col("count") >= p.sample_hits)
        found = rows.select("token").toPandas()["token"].to_numpy(np.int64)
        return np.sort(found.view(np.uint64))

    def sets(self) -> DataFrame:
        p = self.p
        frequent = self.spark.sparkContext.broadcast(self.frequent())

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from hashlib import blake2b

            often = frequent.value
            for f in frames:
                out = []
                for t in f["text"]:
                    s = shingles(t, p.k)
                    n = len(s)
                    if not n:
                        out.append((0, None, None, None, None, None))
                        continue
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        known = often[at] == s
                        ordered, light = np.concatenate([s[~known], s[known]]), int(n - known.sum())
                    else:
                        ordered, light = s, n
                    length = prefix_length(n, p)
                    first = ordered[:length].view(np.int64)
                    mins = np.array([(s * ODD[40 + o]).min() for o in range(p.orders)], np.uint64).view(np.int64)
                    out.append((n, blake2b(s.tobytes(), digest_size=16).digest(), mins, first[:light], first[light:], signature(s)))
                frame = pd.DataFrame(out, columns=["n", "digest", "mins", "light", "heavy", "bits"])
                frame.insert(0, "doc_id", f["doc_id"].to_numpy())
                frame.insert(1, "key", f["key"].to_numpy())
                yield frame

        sets = self.docs.mapInPandas(rows, "doc_id bigint, key bigint, n bigint, digest binary, mins array<bigint>, light array<bigint>, heavy array<bigint>, bits binary")
        # the number of a row names its class, if the row is the class's first; it is fixed once the table is written
        return sets.withColumn("row", F.monotonically_increasing_id())

    def texts(self, classes: DataFrame, sets: DataFrame) -> DataFrame:
        """``classes`` (sid and other columns) with the text of each; repeated rows may give it more than once."""
        where = classes.join(sets.select(F.col("row").alias("sid"), "doc_id", "key"), "sid")
        return self.docs.join(where, ["doc_id", "key"])

    def verified(self, pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold, compared token by token."""
        p, k = self.p, self.p.k
        sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"sid": f["sid"], "set": [shingles(t, k).view(np.int64) for t in f["text"]]})

        full = self.scratch.keep(self.texts(sids, sets).select("sid", "text").mapInPandas(rows, "sid bigint, set array<bigint>"), f"sets-{label}")
        a = full.select(F.col("sid").alias("a"), F.col("set").alias("sa"))
        b = full.select(F.col("sid").alias("b"), F.col("set").alias("sb"))
        both = pairs.join(a, "a").join(b, "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        links = self.scratch.keep(both.where(shared * (p.num + p.den) >= p.num * (F.size("sa") + F.size("sb"))).select("a", "b"), f"links-{label}")
        self.scratch.drop(full)
        return links

    def sizes_fit(self, x: str, y: str):
        return (F.col(x) * self.p.den >= F.col(y) * self.p.num) & (F.col(y) * self.p.den >= F.col(x) * self.p.num)

    def stars(self, reps: DataFrame) -> DataFrame:
        """Pairs of a set and the smallest id among those that share a minimum with it."""
        each = reps.select("sid", "n", F.posexplode("mins").alias("o", "m"))
        lead = each.groupBy("o", "m").agg(F.min(F.struct("sid", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
        pairs = each.join(lead, ["o", "m"]).select(F.col("lead.sid").alias("a"), F.col("sid").alias("b"), F.col("lead.n").alias("na"), "n")
        return pairs.where((F.col("a") < F.col("b")) & self.sizes_fit("na", "n")).select("a", "b").distinct()

    def groups(self, reps: DataFrame) -> DataFrame:
        """The rows of the trees: group (g1, g2, g3), sid, n, label, left, right."""
        p = self.p
        per = W.partitionBy("token")
        light = reps.select("sid", "n", "label", F.explode("light").alias("token"))
        light = light.withColumns({"c": F.count("*").over(per), "lo": F.min("label").over(per), "hi": F.max("label").over(per)}).where("lo < hi")
        # frequent tokens: one task would get a whole group, so they are counted first; there are no more of them than the sample found
        heavy = reps.select("sid", "n", "label", F.explode("heavy").alias("token"))
        counts = heavy.groupBy("token").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        heavy = heavy.join(F.broadcast(counts), "token")
        rows = self.scratch.keep(light.select("token", "sid", "n", "label", "c").unionByName(heavy.select("token", "sid", "n", "label", "c")), "routed")
        self.routed = rows
        small = rows.where(F.col("c") <= p.group_rows).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("sid", "n", "label"))).alias("members"))
        small = small.groupBy("members").agg(F.min("token").alias("g1"))
        small = small.select("g1", F.lit(-1).alias("g2"), F.lit(-1).alias("g3"), F.explode("members").alias("m"), F.lit(True).alias("left"), F.lit(True).alias("right")).select("g1", "g2", "g3", "m.*", "left", "right")
        large = rows.where(F.col("c") > p.group_rows)
        most = large.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("most"))
        large = large.join(most, "token").withColumns({"outside": F.col("label") != F.col("most.label"), "blocks": F.ceil(F.col("c") / p.block_rows).cast("int"), "out_blocks": F.ceil((F.col("c") - F.col("most.k")) / p.block_rows).cast("int")})
        own, out = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("out_blocks")).cast("int")
        left = large.select(F.col("token").alias("g1"), own.alias("g2"), F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("g3"), "sid", "n", "label", F.lit(True).alias("left"), F.lit(False).alias("right"))
        right = large.where("outside").select(F.col("token").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g2"), out.alias("g3"), "sid", "n", "label", F.lit(False).alias("left"), F.lit(True).alias("right"))
        return small.unionByName(left).unionByName(right)

    def candidates(self, groups: DataFrame, sets: DataFrame, few: int) -> DataFrame:
        """Pairs (a, b) of the groups. A group of many more pairs than sets gives the likeliest ``few`` of each set, and a row with its keys and no pair."""
        p, keys = self.p, KEYS
        bits = sets.select(F.col("row").alias("sid"), "bits").join(groups.select("sid").distinct(), "sid", "left_semi")
        rows = groups.join(bits, "sid").repartition(*keys).sortWithinPartitions(*keys)

        def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in runs(frames, keys):
                k = f[keys].to_numpy()
                at = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1, [len(f)]])
                sid, n, label = (f[c].to_numpy(np.int64) for c in ("sid", "n", "label"))
                left, right, bits = f["left"].to_numpy(bool), f["right"].to_numpy(bool), f["bits"].tolist()
                found, rest = [], []
                for s, e in zip(at[:-1], at[1:], strict=True):
                    a, b, score = scored_pairs(sid[s:e], n[s:e], label[s:e], bits[s:e], left[s:e], right[s:e], p)
                    if len(a) > max(p.more, few) * (e - s):
                        some = likeliest(a, b, score, few)
                        rest.append(s)
                        a, b = a[some], b[some]
                    found.append((a, b))
                a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates().assign(**{c: None for c in keys}).astype("Int64")
                if rest:
                    yield f.loc[rest, keys].assign(a=None, b=None)[["a", "b", *keys]].astype("Int64")

        return rows.mapInPandas(pairs, "a bigint, b bigint, g1 bigint, g2 bigint, g3 bigint")

    def late_links(self, reps: DataFrame, labels: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
        """All links that are needed beside ``links`` to tie each component together.

        A group of many sets that are no near copies of each other, but of one among them, has as many candidates as pairs; the
        likeliest pairs of each set come first, and tie most of it. A group that held pairs back is looked at again with the new labels,
        and may propose ``more`` times as many pairs each round, until it holds none back.
        """
        p, scratch, few = self.p, self.scratch, self.p.few
        routed = reps.join(labels, reps["sid"] == labels["v"], "left").select("sid", "n", F.coalesce("label", "sid").alias("label"), "light", "heavy")
        groups = scratch.keep(self.groups(routed), "groups")
        while True:
            found = scratch.keep(self.candidates(groups, sets, few), "pairs")
            scratch.tidy()
            links = links.unionByName(self.verified(found.where("a is not null").select("a", "b").distinct(), sets, "late"))
            rest = found.where("a is null").select(*KEYS).distinct()
            if not rest.limit(1).count():
                scratch.drop(found, groups)
                return links
            now = component_labels(links, scratch)
            again = groups.join(rest, KEYS, "left_semi").join(now.select(F.col("v").alias("sid"), F.col("label").alias("new")), "sid", "left")
            again = scratch.keep(again.withColumn("label", F.coalesce("new", "label")).drop("new"), "groups")
            scratch.drop(found, groups)
            groups, few = again, few * p.more

    def ties(self, sets: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
        """Pairs of classes that an id ties together as its rows have both texts."""
        of = sets.join(repeated, "doc_id", "left_semi").join(classes, "digest").select("doc_id", "sid")
        first = of.groupBy("doc_id").agg(F.min("sid").alias("a"))
        return of.join(first, "doc_id").where("a <> sid").select("a", F.col("sid").alias("b")).distinct()

    def link_counts(self, label: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
        """(sid, texts, rows): how many classes each linked class links with, and how many rows those have."""
        p, keys = self.p, ["g1", "g2", "g3"]
        own = label.select(F.col("v").alias("sid"), "label").join(classes.select("sid", "rows"), "sid").join(sets.select(F.col("row").alias("sid"), "n"), "sid")
        size = own.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / p.block_rows), F.ceil(F.sum("n") / p.block_tokens)).cast("int").alias("blocks"))
        own = own.join(size, "label").select("sid", "rows", "label", "blocks", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("block"))
        each = self.texts(own, sets).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select(
            F.col("label").alias("g1"), F.least("block", "other").alias("g2"), F.greatest("block", "other").alias("g3"),
            "sid", "rows", (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"), "text",
        ).repartition(*keys).sortWithinPartitions(*keys)

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in runs(frames, keys):
                k = f[keys].to_numpy()
                at = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1, [len(f)]])
                for s, e in zip(at[:-1], at[1:], strict=True):
                    g = f.iloc[s:e].drop_duplicates("sid")
                    sets = [shingles(t, p.k) for t in g["text"]]
                    texts, rows = linked(sets, g["rows"].to_numpy(np.int64), g["left"].to_numpy(bool), g["right"].to_numpy(bool), p)
                    yield pd.DataFrame({"sid": g["sid"].to_numpy(np.int64), "texts": texts, "rows": rows})

        return each.mapInPandas(count, "sid bigint, texts bigint, rows bigint").groupBy("sid").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("linked_rows"))

    def components(self, counts: bool = True) -> DataFrame:
        """One row a document: doc_id, n_shingles, component_id, class_id; with ``counts`` also n_links (other rows that it links with, copies
        included) and n_texts_linked (other classes that it links with)."""
        scratch = self.scratch
        sets = scratch.keep(self.sets(), "sets")
        known = sets.where("n > 0 and doc_id is not null")
        classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("lead"), F.count("*").alias("rows"))
        classes = scratch.keep(classes.select("digest", F.col("lead.doc_id").alias("rep"), F.col("lead.row").alias("sid"), "rows"), "classes")
        reps = sets.join(classes.select(F.col("sid").alias("row")), "row", "left_semi").withColumnRenamed("row", "sid")
        early = scratch.keep(self.stars(reps.select("sid", "n", "mins")), "stars")
        links = self.verified(early, sets, "early")
        labels = component_labels(links, scratch)
        scratch.tidy()
        links = self.late_links(reps, labels, links, sets)
        scratch.drop(early, self.routed)
        scratch.tidy()
        repeated = scratch.keep(sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
        some = repeated.limit(1).count() > 0
        # of the components by links alone come the counts; ids that repeat tie components together
        label = component_labels(links, scratch)
        scratch.tidy()
        tied = component_labels(links.unionByName(self.ties(sets, classes, repeated)), scratch) if some else label
        names = classes.select(F.col("sid").alias("v"), "rep")
        least = tied.join(names, "v").groupBy("label").agg(F.min("rep").alias("least"))
        named = tied.join(least, "label").select(F.col("v").alias("sid"), "least")
        classes = classes.join(named, "sid", "left")
        if counts:
            classes = classes.join(scratch.keep(self.link_counts(label, sets, classes), "counts"), "sid", "left")
            scratch.tidy()
        out = sets.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
        itself = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.lit(1))
        more = {
            "n_links": F.when(F.col("rows").isNull(), F.lit(0)).otherwise(F.col("rows") - itself + F.coalesce("linked_rows", F.lit(0))).cast("bigint"),
            "n_texts_linked": F.coalesce("texts", F.lit(0)).cast("bigint"),
        } if counts else {}
        out = out.withColumns({"component_id": F.coalesce("least", "rep", "doc_id"), "class_id": F.coalesce("rep", "doc_id"), **more})
        out = out.select("doc_id", "n_shingles", "component_id", "class_id", *more)
        if some:
            # a row without words has its id's component too
            of_id = out.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("of_id"))
            out = out.join(of_id, out["doc_id"] == of_id["id"], "left").withColumn("component_id", F.coalesce("of_id", "component_id")).drop("id", "of_id")
        return out


def ngram_components(documents: DataFrame, params: JoinParams = JoinParams(), counts: bool = False) -> DataFrame:
    return NgramJoin(documents, params).components(counts)


def op3_ngram_join(documents: DataFrame) -> DataFrame:
    return ngram_components(documents, counts=True)
