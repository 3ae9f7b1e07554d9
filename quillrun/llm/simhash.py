"""Near-duplicate groups by SimHash and a Gray-order hierarchical index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, materialize

BITS = 128
#: Fingerprints within so many bits are near duplicates.
DISTANCE = 20
#: The search finds a pair at DISTANCE bits with probability RECALL, at any number of fingerprints; nearer ones more surely.
RECALL = 0.99
#: Fingerprints that a bucket of a table should hold by chance.
BUCKET = 512
#: Fingerprints of a leaf of the hierarchy, and nodes of an upper node.
LEAF, FAN = 32, 8
_WORD = re.compile(r"\w+")
#: Words remembered by a worker, and the longest word that is.
REMEMBERED, LONG = 300_000, 64
CHUNK_ROWS = 200_000
PAIRS = 1 << 22


class Fingerprinter:
    """text -> 128 bits. Features are the lowered words, weighted by the root of
    their count and by length (short words are mostly function words, which all
    texts share), so that the weights need no corpus and fingerprints stay
    comparable as the corpus grows. Bits are the words' MD5. Weights are integers:
    sums are exact."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.rows: list[bytes] = []
        self.bits = np.zeros((0, BITS), np.int8)
        self.base = np.zeros(0)

    def _learn(self, words: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.__init__()
        new = list(words - self.ids.keys())
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
            raw = np.frombuffer(b"".join([md5(w.encode(), usedforsecurity=False).digest() for w in new]), np.uint8).reshape(-1, BITS // 8)
            self.bits = np.concatenate([self.bits, np.unpackbits(raw, axis=1).astype(np.int8) * 2 - 1])
            self.base = np.concatenate([self.base, [min(1.0, (len(w) / 8) ** 2) for w in new]])

    def _forget_long(self, words: set[str]) -> None:
        """Texts without spaces are words of any length, which aren't kept."""
        if any(len(w) > LONG for w in words):
            self.__init__()

    def prints(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n x 2 of uint64, and which rows have a fingerprint. Null and blank texts
        have none; a text without words is one feature as a whole."""
        counts = []
        for t in texts:
            t = (t or "").strip()
            counts.append(Counter(_WORD.findall(t.lower())) or (Counter([t]) if t else Counter()))
        there = set().union(*counts)
        self._learn(there)
        out = np.zeros((len(texts), 2), np.uint64)
        some = np.array([bool(c) for c in counts], bool)
        at, k = np.flatnonzero(some), 0
        while k < len(at):
            size, last = 0, k
            while last < len(at) and (last == k or size + len(counts[at[last]]) < 20_000):
                size += len(counts[at[last]])
                last += 1
            part = [counts[i] for i in at[k:last]]
            ids = np.fromiter((self.ids[w] for c in part for w in c), np.int64, size)
            n = np.fromiter((v for c in part for v in c.values()), np.float64, size)
            weight = np.maximum(np.floor(256 * np.sqrt(n) * self.base[ids] + 0.5), 1).astype(np.int32)
            starts = np.cumsum([0, *(len(c) for c in part[:-1])])
            sums = np.add.reduceat(self.bits[ids] * weight[:, None], starts, axis=0)
            out[at[k:last]] = np.packbits(sums > 0, axis=1).view(">u8").astype(np.uint64)
            k = last
        self._forget_long(there)
        return out, some


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Ranks of 128-bit words (n x 2) in the reflected Gray order."""
    r = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    odd = (r[:, 0] & np.uint64(1)).astype(bool)
    r[odd, 1] = ~r[odd, 1]
    return r


def gray_word(ranks: np.ndarray) -> np.ndarray:
    """The inverse of ``gray_rank``."""
    w = ranks ^ (ranks >> np.uint64(1))
    w[:, 1] ^= (ranks[:, 0] & np.uint64(1)) << np.uint64(63)
    return w


def _near(prints: np.ndarray, starts: np.ndarray, distance: int, skip: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of the pairs i < j within a group (groups begin at ``starts``; each in
    Gray order) whose words differ in at most ``distance`` bits.

    Runs of LEAF neighbours in Gray order, which share many bits, form a node: the
    mask of the bits all of them share and those bits' values. Runs of FAN nodes
    form upper nodes, up to one root a group. From pairs of roots the search goes
    down: a pair of nodes is dropped, with all under it, when the bits both have
    fixed already differ in too many places. All pairs of a level are compared at
    once. ``skip(begin, end, a, b)`` says which pairs of leaves need no comparison."""
    n = len(prints)
    sizes = np.diff(np.append(starts, n))
    levels = []  # from the leaves up: (first child, end of children, mask, value)
    low_and, low_or, first, group_sizes, wide = prints, prints, starts, sizes, LEAF
    while True:
        runs = -(-group_sizes // wide)
        begin = np.repeat(first, runs) + wide * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
        end = np.minimum(begin + wide, np.repeat(first + group_sizes, runs))
        low_and = np.bitwise_and.reduceat(low_and, begin, axis=0)
        low_or = np.bitwise_or.reduceat(low_or, begin, axis=0)
        levels.append((begin, end, ~(low_and ^ low_or), low_and))
        if len(begin) == len(starts):
            break
        first, group_sizes, wide = np.cumsum(runs) - runs, runs, FAN
    high, low = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
    lane = np.arange(LEAF)
    roots = np.arange(len(starts))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        begin, end, _, _ = levels[level]
        if level == 0:
            most = PAIRS // LEAF**2
            if len(a) > most:  # the pairs first in Gray order are compared first
                stack += [(0, a[most:], b[most:]), (0, a[:most], b[:most])]
                continue
            if skip is not None:
                need = ~skip(begin, end, a, b)
                a, b = a[need], b[need]
            i, j = begin[a][:, None] + lane, begin[b][:, None] + lane
            i_in, j_in = i < end[a][:, None], j < end[b][:, None]
            i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
            d = np.bitwise_count(high[i][:, :, None] ^ high[j][:, None, :])
            d += np.bitwise_count(low[i][:, :, None] ^ low[j][:, None, :])
            p, x, y = np.nonzero(d <= distance)
            i, j, ok = i[p, x], j[p, y], i_in[p, x] & j_in[p, y]
            ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
            continue
        wides = end[b] - begin[b]
        total = (end[a] - begin[a]) * wides
        if total.sum() > PAIRS and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        which = np.repeat(np.arange(len(a)), total)
        k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
        i = begin[a][which] + k // wides[which]
        j = begin[b][which] + k % wides[which]
        ok = i <= j
        i, j = i[ok], j[ok]
        _, _, mask, value = levels[level - 1]
        apart = np.bitwise_count((value[i] ^ value[j]) & mask[i] & mask[j]).sum(axis=1, dtype=np.int32)
        ok = apart <= distance
        if ok.any():
            i, j = i[ok], j[ok]
            order = np.argsort(j - i, kind="stable")
            stack.append((level - 1, i[order], j[order]))


def near_pairs(prints: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that ``_near`` finds."""
    found = [(np.zeros(0, np.int64),) * 2, *_near(prints, starts, distance)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; a label is the least index of its component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label[:] = up


def linked(prints: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the least index of its component of near pairs. Pairs of
    leaves that are all in one component already aren't compared, which changes no
    component: so a large cluster costs few comparisons, and no pairs are held."""
    label = np.arange(len(prints))

    def skip(begin, end, a, b):
        least, most = np.minimum.reduceat(label, begin), np.maximum.reduceat(label, begin)
        return (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])

    for i, j in _near(prints, starts, distance, skip):
        _join(label, i, j)
    return label


def plan(n: int, design: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """Key bits and tables for n fingerprints: keys long enough that buckets stay of
    about BUCKET at any n, tables enough that two fingerprints ``design`` bits
    apart share a key with probability ``recall``."""
    bits = min(40, max(0, math.ceil(math.log2(max(n, 1) / BUCKET))))
    same = (1 - design / BITS) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - same))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hi, lo``: Gray ranks of the fingerprint, null where there is none."""

    def start():
        make = Fingerprinter()

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            words, some = make.prints(b.column(1).to_pylist())
            ranks = gray_rank(words).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(ranks[:, c], mask=~some) for c in (0, 1))], ["doc_id", "hi", "lo"])

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), start, f"doc_id {kind}, hi bigint, lo bigint")


def _search(distinct: DataFrame, bits: int, tables: int, distance: int) -> DataFrame:
    """Edges ``u, v`` (v < u) that connect near fingerprints of ``distinct`` (hi, lo, rep)."""
    positions = np.stack([np.random.default_rng([11, t]).permutation(BITS)[:bits] for t in range(tables)])

    def keyed():
        powers = (1 << np.arange(bits)).astype(np.int64)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            ranks = np.stack([b.column(c).to_numpy() for c in (0, 1)], axis=1)
            words = gray_word(ranks.view(np.uint64))
            bit = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 16), axis=1)
            keys = np.concatenate([(t << bits) + bit[:, p].astype(np.int64) @ powers for t, p in enumerate(positions)])
            cols = [np.tile(b.column(c).to_numpy(), tables) for c in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, *cols)], ["key", "hi", "lo", "rep"])

        return each

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def edges(key, hi, lo, rep):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            many = np.repeat(sizes > 1, sizes)
            if not many.any():
                return None
            hi, lo, rep, sizes = hi[many], lo[many], rep[many], sizes[sizes > 1]
            words = gray_word(np.stack([hi, lo], axis=1).view(np.uint64))
            root = linked(words, np.cumsum(sizes) - sizes, distance)
            label = rep.copy()
            np.minimum.at(label, root, rep)  # the least id of each component
            label = label[root]
            other = label != rep
            if not other.any():
                return None
            uv = np.unique(np.stack([rep[other], label[other]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            rest = cols
            if len(cols[0]) > CHUNK_ROWS and (cut := int(np.searchsorted(cols[0], cols[0][-1]))):
                if (out := edges(*(c[:cut] for c in cols))) is not None:
                    yield out
                rest = [c[cut:] for c in cols]
        if rest is not None and len(rest[0]) and (out := edges(*rest)) is not None:
            yield out

    rows = map_batches(distinct.select("hi", "lo", "rep"), keyed, "key bigint, hi bigint, lo bigint, rep bigint")
    bound_batches(distinct.sparkSession)
    sorted_ = rows.repartition("key").sortWithinPartitions("key", "hi", "lo")
    return sorted_.mapInArrow(join, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, root`` of every node of ``edges`` (u, v; v < u) that isn't the least of
    its component: large-star and small-star rounds until nothing changes. Each
    round is written to the shared folder. Least neighbours are aggregated and
    joined back, so that a hub can be split as a skewed join."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = materialize(edges.select("u", "v"), "edges")
    now, before = state(e), None
    while now != before and now[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now, before = state(e), now
    return e.select("u", F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, *, distance: int = DISTANCE, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, group_id`` of every document: the least id of the group it is in.

    A group is a connected component of the pairs of fingerprints at most
    ``distance`` of 128 bits apart. Equal fingerprints are folded first, so a hot
    text costs one row. Candidates meet on sampled bits, in tables whose number and
    key length follow the number of fingerprints (``plan``), so that a pair at the
    very ``distance`` is found with probability ``recall`` at any number; each
    table's keys are shuffled once, sorted by key and Gray rank, and searched by a
    hierarchy of masked patterns (``_near``) without a cap. Only fingerprints and
    ids are shuffled, never texts.

    Null ids have no row. An id that repeats has one row; its least fingerprint
    counts. A document of null or blank text stands alone. Ties go to the least id.
    An empty table gives none; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col).where("doc_id is not null"), "prints")
    one = F.min(F.struct(F.col("hi").isNull(), "hi", "lo"))
    prints = prints.groupBy("doc_id").agg(one.alias("p")).select("doc_id", "p.hi", "p.lo")
    own = prints.where("hi is not null")
    distinct = materialize(own.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "distinct")
    bits, tables = plan(distinct.count(), distance, recall)
    roots = components(_search(distinct, bits, tables, distance))
    rooted = distinct.join(roots, F.col("rep") == F.col("u"), "left").select("hi", "lo", F.coalesce("root", "rep").alias("group_id"))
    grouped = own.join(rooted, ["hi", "lo"]).select("doc_id", "group_id")
    return grouped.union(prints.where("hi is null").select("doc_id", F.col("doc_id").alias("group_id")))


def kept_with_members(groups: DataFrame, *, most: int = 10_000) -> DataFrame:
    """``doc_id, members``: each document that stays and the ids of its group, its
    own among them. A group of over ``most`` has several rows, parted by hash, so
    that no row grows with the data."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / most))
    parted = groups.join(sizes, "group_id").withColumn("part", part)
    return parted.groupBy("group_id", "part").agg(F.array_sort(F.collect_list("doc_id")).alias("members")).select(F.col("group_id").alias("doc_id"), "members")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names: one of
    each group, and every row without an id. Of an id that repeats one row stays:
    the one of least text, then of least other columns (as strings). Documents of
    null or blank text stay. The plan is the same at any size: texts are shuffled
    once, by id, beside the ids that stay, and aren't sorted."""
    groups = materialize(near_duplicates(docs.select("doc_id", "text"), **options), "groups")
    stay = groups.where("doc_id = group_id").select(F.col("doc_id").alias("key"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key, text = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    kept = rows.join(stay.hint("shuffle_hash"), rows[key] == stay["key"], "left_semi")
    unnamed = rows.where(F.col(key).isNull())
    many = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.col(key).alias("many")), "repeated")
    if not many.isEmpty():
        again = kept.join(many, kept[key] == many["many"], "left_semi")
        least = F.min_by(F.struct(*names), F.struct(text, *(F.to_json(F.struct(n)) for n in names)))
        first = again.groupBy(key).agg(least.alias("r")).select(*(F.col(f"r.{n}").alias(n) for n in names))
        kept = kept.join(many, kept[key] == many["many"], "left_anti").union(first)
    return kept.union(unnamed).toDF(*docs.columns)


def oracle(distance: int = DISTANCE) -> str:
    """``kept_with_members`` of the near duplicates of documents as DuckDB SQL, where
    no group is over ``most`` and all ids differ: all pairs of fingerprints are compared."""
    sums = ", ".join(f"sum(CASE WHEN (w{b // 32} >> {31 - b % 32}) & 1 = 1 THEN wt ELSE -wt END) AS s{b}" for b in range(BITS))
    words = ", ".join(" + ".join(f"(s{32 * k + i} > 0)::BIGINT * {1 << (31 - i)}" for i in range(32)) + f" AS p{k}" for k in range(4))
    apart = " + ".join(f"bit_count(xor(a.p{k}, b.p{k}))" for k in range(4))
    return f"""WITH RECURSIVE t AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS whole FROM documents),
    f AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [whole] END) AS w FROM t WHERE whole <> '') GROUP BY doc_id, w),
    h AS MATERIALIZED (SELECT doc_id, {', '.join(f"('0x' || substr(md5(w), {8 * k + 1}, 8))::BIGINT AS w{k}" for k in range(4))},
      greatest(floor(256 * sqrt(n) * least(1.0::DOUBLE, pow(length(w) / 8::DOUBLE, 2)) + 0.5), 1)::BIGINT AS wt FROM f),
    p AS (SELECT doc_id, {words} FROM (SELECT doc_id, {sums} FROM h GROUP BY doc_id)),
    d AS MATERIALIZED (SELECT min(doc_id) AS rep, p0, p1, p2, p3 FROM p GROUP BY p0, p1, p2, p3),
    e AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM d a JOIN d b ON a.rep <> b.rep AND {apart} <= {distance}),
    r(rep, root) AS (SELECT rep, rep FROM d UNION SELECT e.v, r.root FROM r JOIN e ON r.rep = e.u),
    c AS (SELECT rep, min(root) AS root FROM r GROUP BY rep),
    g AS (SELECT p.doc_id, c.root FROM p JOIN d USING (p0, p1, p2, p3) JOIN c ON c.rep = d.rep
      UNION ALL SELECT doc_id, doc_id FROM t WHERE whole = '')
    SELECT root AS doc_id, list_sort(list(doc_id)) AS members FROM g GROUP BY root"""
