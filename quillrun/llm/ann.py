"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize

#: Hash functions a table, tables, probes a table, and slot width in root-mean-square lengths.
FUNCTIONS, TABLES, PROBES, WIDTH = 7, 6, 400, 2.0
#: Vectors that a coarse cell should hold; how cells are cut changes no result.
CELL = 6000
#: A cell of more members or queries than these is split into parts.
MEMBERS, ASKING = 24_000, 8192
#: Queries, and distances, that a task works on at a time.
QUERIES, PAIRS = 4096, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def probe_template(m: int, most: int) -> np.ndarray:
    """The ``most`` perturbation sets likeliest to succeed, as rows of 0/1 over the
    2m slot borders in order of their distance, by the expected scores of borders
    drawn uniformly; the first row perturbs nothing. The j-th nearest border and
    the (2m + 1 - j)-th are of one function, so no set has both."""
    j = np.arange(1, 2 * m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = 2 * m + 1 - j
    far = 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    score = np.where(j <= m, near, far)
    rows = [np.zeros(2 * m, np.float32)]
    heap = [(score[0], (1,))]
    while heap and len(rows) < most:
        s, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last < 2 * m:
            heapq.heappush(heap, (s - score[last - 1] + score[last], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (s + score[last], (*chosen, last + 1)))
        if all(2 * m + 1 - x not in chosen for x in chosen):
            row = np.zeros(2 * m, np.float32)
            row[np.array(chosen) - 1] = 1
            rows.append(row)
    return np.stack(rows)


def _mix(codes: np.ndarray, salt: int) -> np.ndarray:
    """Slots (..., n) folded to one 64-bit code; a collision only adds candidates."""
    h = np.full(codes.shape[:-1], salt, np.uint64)
    for i in range(codes.shape[-1]):
        h = (h ^ codes[..., i].astype(np.int64).view(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@dataclass(frozen=True)
class Hashes:
    dimensions: int
    scale: float
    coarse: int
    functions: int = FUNCTIONS
    tables: int = TABLES
    probes: int = PROBES
    width: float = WIDTH
    seed: int = 5

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        shape = self.tables, self.dimensions, self.functions
        object.__setattr__(self, "directions", rng.standard_normal(shape).astype(np.float32))
        object.__setattr__(self, "shifts", rng.random((self.tables, self.functions)).astype(np.float32))
        object.__setattr__(self, "template", probe_template(self.functions, 3 * self.probes))

    def home(self, table: int, x: np.ndarray) -> np.ndarray:
        """Slots (n x m) of each vector."""
        return np.floor(x @ self.directions[table] / (self.width * self.scale) + self.shifts[table]).astype(np.int64)

    def probed(self, table: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots (n x m) of each vector and of its probes (n x probes x m), the likeliest first."""
        m = self.functions
        y = x @ self.directions[table] / (self.width * self.scale) + self.shifts[table]
        slots = np.floor(y)
        part = y - slots
        border = np.concatenate([part, 1 - part], axis=1) ** 2  # down, up
        order = np.argsort(border, axis=1, kind="stable")
        scores = np.take_along_axis(border, order, axis=1) @ self.template.T
        # A template is of expected order: both borders of one function may still meet in it.
        step = np.zeros((len(x), 2 * m, m), np.float32)
        rows = np.arange(len(x))[:, None]
        step[rows, np.arange(2 * m)[None], order % m] = np.where(order < m, -1, 1)
        twice = (self.template @ np.abs(step)).max(axis=2) > 1
        scores[twice] = np.inf
        t = min(self.probes, scores.shape[1])
        best = np.argsort(scores, axis=1, kind="stable")[:, :t]
        moves = self.template[best] @ step
        return slots.astype(np.int64), slots.astype(np.int64)[:, None] + moves.astype(np.int64)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of float32 from a binary column of equal lengths, one copy at most."""
    whole = column.combine_chunks()
    chunks = whole.chunks if isinstance(whole, pa.ChunkedArray) else [whole]
    rows = []
    for c in chunks:
        offsets = np.frombuffer(c.buffers()[1], "<i4")[c.offset : c.offset + len(c) + 1]
        rows.append(np.frombuffer(c.buffers()[2], "<f4", (offsets[-1] - offsets[0]) // 4, offsets[0]).reshape(len(c), -1))
    return rows[0] if len(rows) == 1 else np.concatenate(rows)


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows a and b of x; those of equal vectors are equal."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 1 << 15):
        d = x[a[lo : lo + (1 << 15)]].astype(np.float64) - x[b[lo : lo + (1 << 15)]]
        out[lo : lo + len(d)] = (d * d).sum(axis=1)
    return out


def _cut(d: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Of each row of d, the k-th least among the least of each name; inf with fewer than k names."""
    unique, first = np.unique(names, return_index=True)
    if len(unique) < len(names):
        order = np.argsort(names, kind="stable")
        starts = np.flatnonzero(np.diff(names[order], prepend=names[order[0]] - 1))
        d = np.minimum.reduceat(d[:, order], starts, axis=1)
    if d.shape[1] < k:
        return np.full(len(d), np.inf, np.float32)
    return np.partition(d, k - 1, axis=1)[:, k - 1]


def _merge(best_d: np.ndarray, best_i: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, x: np.ndarray, low: int, k: int) -> None:
    """Lowers the k best distinct ids of the queries ``q`` by the candidates: rows b
    for the queries q[a], by exact squared distance and then by id."""
    held_q, held_c = np.nonzero(np.isfinite(best_d[q]))
    rows = np.concatenate([held_q, a])
    d = np.concatenate([best_d[q[held_q], held_c], _exact(x, low + q[a], b)])
    names = np.concatenate([best_i[q[held_q], held_c], ids[b]])
    order = np.lexsort((d, names, rows))
    rows, d, names = rows[order], d[order], names[order]
    new = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(names, prepend=0) != 0))  # the nearest row of an id
    rows, d, names = rows[new], d[new], names[new]
    order = np.lexsort((names, d, rows))
    rows, d, names = rows[order], d[order], names[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    some = place < k
    best_d[q], best_i[q] = np.inf, -1
    best_d[q[rows[some]], place[some]] = d[some]
    best_i[q[rows[some]], place[some]] = names[some]


def _nearest(block: pa.Table, k: int, centre: np.ndarray) -> pa.Table:
    """Within one coarse cell: for each vector that probes it, the k nearest ids of
    the members in the buckets it probes, by exact distances and then by id. Float
    products only choose candidates, with room for their rounding.

    Queries are taken QUERIES at a time and distances PAIRS at a time, so that what
    is held besides the cell itself is of fixed size, however full a bucket is."""
    ids = block.column(1).to_numpy()
    x = _vectors(block.column(2))
    own = block.column(3).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(block.column(4).to_numpy(zero_copy_only=False))
    lists = block.column(5).combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    at = at[np.argsort(own[at], kind="stable")]
    buckets, first = np.unique(own[at], return_index=True)
    last = np.append(first[1:], len(at))
    z = (x - centre).astype(np.float32)
    norms = np.einsum("ij,ij->i", z, z)
    room = 4e-7 * x.shape[1] * (norms + norms.max(initial=0))  # more than the products' error
    found: list[tuple] = []
    for low in range(0, len(ids) if len(buckets) else 0, QUERIES):
        high = min(low + QUERIES, len(ids))
        probes = values[offsets[low] : offsets[high]]
        asks = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(offsets[low : high + 1]))
        where = np.searchsorted(buckets, probes)
        hit = buckets[np.minimum(where, len(buckets) - 1)] == probes
        asks, where = asks[hit], where[hit]
        order = np.argsort(where, kind="stable")
        asks, where = asks[order], where[order]
        best_d = np.full((high - low, k), np.inf)
        best_i = np.full((high - low, k), -1, np.int64)
        cuts = np.flatnonzero(np.diff(where, prepend=-1, append=len(buckets) + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            members = at[first[where[lo]] : last[where[lo]]]
            for m in range(0, len(members), 4096):
                there = members[m : m + 4096]
                step = max(1, PAIRS // len(there))
                for q0 in range(lo, hi, step):
                    q = asks[q0 : min(hi, q0 + step)]
                    d = z[low + q] @ z[there].T
                    d *= -2
                    d += norms[low + q, None]
                    d += norms[None, there]
                    d[ids[low + q, None] == ids[None, there]] = np.inf
                    limit = best_d[q].max(axis=1) + room[low + q]
                    near = np.flatnonzero(d.min(axis=1) <= limit)
                    if len(near):
                        d, q = d[near], q[near]
                        limit = np.minimum(limit[near], _cut(d, ids[there], k) + 2 * room[low + q])
                        a, c = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                        _merge(best_d, best_i, q, a, there[c], ids, x, low, k)
        q, c = np.nonzero(np.isfinite(best_d))
        found.append((ids[low + q], best_i[q, c], np.sqrt(best_d[q, c])))
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return pa.table(dict(zip(("id", "other", "d"), (pa.array(np.concatenate(c)) for c in zip(*found)))))


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, *, queries: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
    functions: int = FUNCTIONS, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, cell: int = CELL, members: int = MEMBERS, asking: int = ASKING,
) -> DataFrame:
    """``vec_id, neighbours, distances``: of every vector that ``queries`` (a condition;
    all by default) selects, the k nearest others found among all vectors, nearest
    first, by exact Euclidean distance (ties by id).

    Each table hashes a centred vector with ``functions`` Gaussian projections cut
    into slots of ``width`` root-mean-square lengths. A query visits its own bucket and
    the perturbed ones likeliest to hold near vectors, ``probes`` a table, by the
    distances to its slots' borders. A table's first slots name a coarse cell: a
    vector travels to its own cell in each table, and a query also to each cell it
    probes, with the list of buckets there; buckets are joined inside the cell, and of
    each cell only a query's k nearest ids leave it. How many slots name a cell follows
    the number of vectors, so that a cell stays of about ``cell`` vectors; it changes no
    result. Of equal vectors only the k + 1 least ids are members, which no list can
    tell from all. A cell of over ``members`` members or ``asking`` queries is split into
    parts, in which every member meets every query once.

    A null vector, one with nulls or values that aren't finite, or of another length
    than most, is nobody's neighbour and has empty lists; a null id has no row; an
    id that repeats is one query with the neighbours of all its rows and is never
    its own neighbour; equal vectors are at distance 0; fewer than k others give
    shorter lists; an empty table gives none; other columns are ignored.
    """
    spark = vectors.sparkSession
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), asks.alias("q")).where("id is not null")
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kinds = given.where(fine).groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).where("n > 0").collect()
    ids = given.where("q").select(F.col("id").alias("vec_id")).distinct()
    none = ids.select("vec_id", F.array().cast("array<bigint>").alias("neighbours"), F.array().cast("array<double>").alias("distances"))
    if not kinds:
        return none
    usual = max(kinds, key=lambda r: (r.c, r.n))
    usable = given.where(fine & (F.size("v") == usual.n))
    each = [F.col("v")[i].cast("double") for i in range(usual.n)]
    moments = usable.agg(*(F.avg(e) for e in each), *(F.var_pop(e) for e in each)).first()
    centre, spread = np.array(moments[: usual.n]), math.sqrt(sum(moments[usual.n :]))
    coarse = min(functions, max(1, round(math.log(max(usual.c / cell, 1), 2.2))))
    hashes = Hashes(usual.n, spread or 1.0, coarse, functions, tables, probes, width)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            own_ids = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(len(own_ids), -1) if b.num_rows else np.zeros((0, usual.n), np.float32)
            roles = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3)], axis=1)
            for lo in range(0, len(own_ids), 512):
                yield own_ids[lo : lo + 512], x[lo : lo + 512], roles[lo : lo + 512]

    def placed(x: np.ndarray, roles: np.ndarray, t: int):
        """Home cells and buckets of all rows; and of the queries a row a cell probed: row, cell, list of buckets."""
        z = (x - centre).astype(np.float32)
        slots = hashes.home(t, z)
        home, own = _mix(slots[:, :coarse], t), _mix(slots[:, coarse:], t)
        asking_rows = np.flatnonzero(roles[:, 1])
        moved = hashes.probed(t, z[asking_rows])[1]
        cells, buckets = _mix(moved[:, :, :coarse], t).ravel(), _mix(moved[:, :, coarse:], t).ravel()
        rows = np.repeat(asking_rows, moved.shape[1])
        order = np.lexsort((cells, rows))
        rows, cells, buckets = rows[order], cells[order], buckets[order]
        new = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(cells, prepend=cells[:1]) != 0))
        return home, own, rows[new], cells[new], np.append(new, len(rows)).astype(np.int32), buckets

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, roles in parts(batches):
            for t in range(tables):
                home, _, _, cells, _, _ = placed(x, roles, t)
                home = home[roles[:, 0]]
                key, at = np.unique(np.concatenate([home, cells]), return_inverse=True)
                is_member = np.arange(len(at)) < len(home)
                m, q = (np.bincount(at[k], minlength=len(key)) for k in (is_member, ~is_member))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, m, q)], ["key", "m", "q"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small batches leave one by one: a query has hundreds of probes and a row a cell.
        for own_ids, x, roles in parts(batches):
            raw = [r.tobytes() for r in x]
            for t in range(tables):
                home, own, rows, cells, offsets, buckets = placed(x, roles, t)
                m = np.flatnonzero(roles[:, 0])
                r = np.concatenate([m, rows])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(len(m), np.int32), offsets])), pa.array(buckets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home[m], cells])), pa.array(own_ids[r]), pa.array([raw[i] for i in r], pa.binary()), pa.array(own[r]),
                        pa.array(np.arange(len(r)) < len(m)), lists,
                    ],
                    ["key", "id", "x", "own", "member", "probes"],
                )

    bound_batches(spark)
    once = usable.groupBy("id", "v").agg(F.max("q").alias("q"))  # a row that repeats adds nothing
    # Ranked in a window that Spark limits before the shuffle too, so that a hot vector sends k + 1 rows a task.
    least = Window.partitionBy("v").orderBy("id")
    chosen = once.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).select("id", "v", F.lit(True).alias("m"), "q")
    both = materialize(chosen.union(once.where("q").select("id", "v", F.lit(False), "q")).groupBy("id", "v").agg(F.max("m").alias("m"), F.max("q").alias("q")), "vectors")
    rows = both.mapInArrow(probe, "key bigint, id bigint, x binary, own bigint, member boolean, probes array<bigint>")
    counted = both.mapInArrow(sizes, "key bigint, m bigint, q bigint").groupBy("key").agg(F.sum("m").alias("m"), F.sum("q").alias("q"))
    full = materialize(
        counted.where((F.col("m") > members) | (F.col("q") > asking)).select("key", F.ceil(F.col("m") / members).alias("mp"), F.ceil(F.col("q") / asking).alias("qp")), "full"
    )
    if full.isEmpty():
        split = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        to = lambda n: F.sequence(F.lit(0), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("int") - 1)
        of = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))).cast("int")
        split = rows.join(full, "key", "left").withColumn(
            "at",
            F.when(F.col("member"), F.transform(to(F.col("qp")), lambda j: F.struct(of(F.col("mp")).alias("i"), j.alias("j")))).otherwise(
                F.transform(to(F.col("mp")), lambda i: F.struct(i.alias("i"), of(F.col("qp")).alias("j")))
            ),
        )
        split = split.select("key", "id", "x", "own", "member", "probes", F.explode("at").alias("at")).select("key", "id", "x", "own", "member", "probes", "at.i", "at.j")
    pairs = split.groupBy("key", "i", "j").applyInArrow(lambda block: _nearest(block, k, centre), "id bigint, other bigint, d double")
    found = pairs.groupBy("id", "other").agg(F.min("d").alias("d")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("e"))
    top = found.select("id", F.slice("e", 1, k).alias("e"))
    empty = F.array().cast
    return ids.join(top, ids["vec_id"] == top["id"], "left").select(
        "vec_id",
        F.coalesce(F.col("e.other"), empty("array<bigint>")).alias("neighbours"),
        F.coalesce(F.col("e.d"), empty("array<double>")).alias("distances"),
    )


def oracle(k: int = 10) -> str:
    """The exact neighbours of the queries of ``op2`` as DuckDB SQL, over all vectors."""
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    d AS (SELECT q.vec_id, v.vec_id AS other, list_sum(list_transform(list_zip(q.x, v.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
      FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM d)
    SELECT vec_id, list(other ORDER BY r) AS neighbours, list(round(sqrt(d), 9) ORDER BY r) AS distances FROM r WHERE r <= {k} GROUP BY vec_id"""
