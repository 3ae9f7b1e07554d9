"""Bottom-k sketches of word shingles."""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import list_array, map_batches

#: Horner's rule modulo the prime 2^31 - 1 over 31-bit word hashes, twice; the two make a hash of 62 bits.
PRIME = (1 << 31) - 1
FACTORS = (1103515245, 1664525)
SPAN = float(1 << 62)
K, WIDTH = 128, 5
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class WordHashes(dict):
    """word -> its two 31-bit hashes, from its MD5."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 1_000_000:
            self.clear()
        d = md5(word, usedforsecurity=False).digest()
        if len(word) > 64:  # a text without spaces isn't remembered
            return int.from_bytes(d[:4], "big") % PRIME, int.from_bytes(d[4:8], "big") % PRIME
        value = self[word] = int.from_bytes(d[:4], "big") % PRIME, int.from_bytes(d[4:8], "big") % PRIME
        return value


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct sorted hashes of the shingles of one text; words: n x 2. A text of
    fewer than ``width`` words is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    width = min(width, n)
    h = np.zeros((n - width + 1, 2), np.int64)
    for i in range(width):
        h = (h * np.array(FACTORS) + words[i : i + len(h)]) % PRIME
    return np.unique((h[:, 0] << 31) | h[:, 1])


def bottom_k(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """One row a document: ``doc_id, sketch`` - its k least shingle hashes, ascending.

    Words are runs without ASCII white space, with ASCII capitals lowered; a
    shingle is ``width`` words in a row. No shuffle. A null text has a null
    sketch; a text without words an empty one; a shingle counts once however often
    it repeats; null and repeated ids give a row each; other columns are ignored.
    """

    def start():
        known = WordHashes()
        get = known.__getitem__

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            sketches = []
            for t in b.column(1).to_pylist():
                w = [] if t is None else t.encode().translate(_UPPER).split()
                found = shingle_hashes(np.array([*map(get, w)], np.int64).reshape(-1, 2), width)
                sketches.append(found[:k])
            lists = list_array(pa.array(np.concatenate(sketches)), [len(s) for s in sketches])
            if b.column(1).null_count:
                lists = pa.compute.if_else(b.column(1).is_null(), pa.scalar(None, lists.type), lists)
            return pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "sketch"])

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), start, f"doc_id {kind}, sketch array<bigint>")


def merge_sketches(sketches: DataFrame, by: list[str], *, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of the union of each group's sets: ``by..., sketch``.

    Hashes that a group has more than once are folded first, within each task and
    then by hash, so that copies of a frequent shingle are one row; the k least of a
    group are then ranked in windows, which Spark limits before the shuffle too: a
    task sends k rows a group at most, however hot. Rows that repeat and equal
    sketches change nothing; a null group is a group; groups of null or empty
    sketches alone have no row; other columns, whatever their names, are ignored."""
    names = [f"g{i}" for i in range(len(by))]
    rows = sketches.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.explode(sketch_col).alias("h")).distinct()
    w = Window.partitionBy(*(names or [F.lit(0)])).orderBy("h")
    least = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    merged = least.groupBy(*names).agg(F.array_sort(F.collect_list("h")).alias("sketch"))
    return merged.select(*(F.col(n).alias(c) for c, n in zip(by, names)), "sketch")


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the k-th hash as a part of the range."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(
        F.lit((k - 1) * SPAN) / F.element_at(sketch, -1)
    )


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Of the k least hashes of the union, the part that both have; null if both are empty."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The part of a's shingles that b has: of a's hashes below what both sketches
    cover, those that b has; null if a has none there."""
    top = F.least(
        F.when(F.size(a) < k, F.lit(int(SPAN))).otherwise(F.element_at(a, -1)),
        F.when(F.size(b) < k, F.lit(int(SPAN))).otherwise(F.element_at(b, -1)),
    )
    below = F.filter(a, lambda x: x <= top)
    return F.when(F.size(below) > 0, F.size(F.array_intersect(below, b)) / F.size(below))


def fingerprint_documents(docs: DataFrame, reference: DataFrame, *, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each document's sketch with estimates of its distinct shingles and of its
    resemblance to and containment in the union of ``reference`` (item_id, text),
    whose parts' sketches are merged into one of at most k hashes, sent to every
    task: ``doc_id, sketch, n_distinct, resemblance, containment``. An empty
    reference is an empty set. For nulls see ``bottom_k``; estimates of a null or
    empty sketch are null, but its count is null or 0."""
    own = bottom_k(docs, k=k, width=width)
    parts = bottom_k(reference, id_col="item_id", k=k, width=width)
    whole = merge_sketches(parts, [], k=k).select(F.col("sketch").alias("__ref"))
    empty = F.array().cast("array<bigint>")
    whole = whole.agg(F.coalesce(F.first("__ref"), empty).alias("__ref"))  # one row of k hashes
    joined = own.crossJoin(F.broadcast(whole))
    s, r = F.col("sketch"), F.col("__ref")
    some = F.size(s) > 0
    return joined.select(
        "doc_id",
        "sketch",
        F.when(s.isNotNull(), distinct_count(s, k)).alias("n_distinct"),
        F.when(some, resemblance(s, r, k)).alias("resemblance"),
        F.when(some, containment(s, r, k)).alias("containment"),
    )


def oracle(k: int = K, width: int = WIDTH) -> str:
    """``fingerprint_documents`` over documents and benchmark as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fa, fb = FACTORS

    def hashes(table: str, key: str) -> str:
        steps_a = steps_b = "0::BIGINT"
        for i in range(width):
            a, b = (f"lead({c}, {i}) OVER w" for c in "ab")
            steps_a = f"(CASE WHEN {i} < n THEN ({steps_a} * {fa} + {a}) % {PRIME} ELSE {steps_a} END)"
            steps_b = f"(CASE WHEN {i} < n THEN ({steps_b} * {fb} + {b}) % {PRIME} ELSE {steps_b} END)"
        return f"""SELECT DISTINCT id, ha * 2147483648 + hb AS h FROM (
          SELECT id, p, n, {steps_a} AS ha, {steps_b} AS hb FROM (
            SELECT id, p, n, ('0x' || substr(md5(w), 1, 8))::BIGINT % {PRIME} AS a, ('0x' || substr(md5(w), 9, 8))::BIGINT % {PRIME} AS b FROM (
              SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM (
                SELECT {key} AS id, list_filter(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS ws FROM {table})))
          WINDOW w AS (PARTITION BY id ORDER BY p))
        WHERE p <= greatest(n - {width} + 1, 1)"""

    return f"""WITH s AS (
      SELECT id, list(h ORDER BY h) AS sketch FROM (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS r FROM ({hashes('documents', 'doc_id')})) WHERE r <= {k} GROUP BY id),
    r AS (SELECT coalesce(list(h ORDER BY h), []::BIGINT[]) AS ref FROM (SELECT DISTINCT h FROM ({hashes('benchmark', 'item_id')}) ORDER BY h LIMIT {k})),
    j AS (SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(s.sketch, []::BIGINT[]) END AS sketch, ref FROM documents d LEFT JOIN s ON s.id = d.doc_id CROSS JOIN r),
    u AS (SELECT *, list_sort(list_distinct(list_concat(sketch, ref)))[1:{k}] AS un,
      least(CASE WHEN len(sketch) < {k} THEN {int(SPAN)} ELSE sketch[-1] END, CASE WHEN len(ref) < {k} THEN {int(SPAN)} ELSE ref[-1] END) AS top FROM j)
    SELECT doc_id, sketch,
      CASE WHEN sketch IS NULL THEN NULL WHEN len(sketch) < {k} THEN len(sketch)::DOUBLE ELSE {(k - 1) * SPAN!r}::DOUBLE / sketch[-1] END AS n_distinct,
      CASE WHEN len(sketch) > 0 THEN len(list_filter(un, lambda x: list_contains(sketch, x) AND list_contains(ref, x)))::DOUBLE / len(un) END AS resemblance,
      CASE WHEN len(list_filter(sketch, lambda x: x <= top)) > 0 THEN len(list_filter(sketch, lambda x: x <= top AND list_contains(ref, x)))::DOUBLE / len(list_filter(sketch, lambda x: x <= top)) END AS containment
    FROM u"""
