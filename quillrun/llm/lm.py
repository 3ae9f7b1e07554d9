"""Language-model scores from a Brown class-based bigram model."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, list_array, materialize

TOKEN = re.compile(r"\w+|[^\w\s]+")
CLASSES = 64
#: A word that occurs this often has a class and a probability of its own, at any corpus size.
LEAST = 2
#: The most frequent words, whose classes are found by sequential exchange; all others join these classes.
HEAD = 512
#: Pseudo-counts of a class's transitions, and of a word.
PRIOR, ADD = 64.0, 0.5
#: Rows that a task holds before it combines and sends them.
FLUSH = 1_000_000
#: Tokens of a chunk of texts; a text isn't divided.
CHUNK = 500_000
BOUNDARY, UNKNOWN = 0, 1
SPECIAL = ["\x00<s>", "\x00<unk>"]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Ids(dict):
    """word -> id; a word without one has that of unknown words."""

    def __init__(self, vocabulary: list[str]):
        super().__init__((w, i) for i, w in enumerate(vocabulary))

    def __missing__(self, word: str) -> int:
        return UNKNOWN


def bounded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of texts one after another, each between boundaries; sizes: each text's number of tokens."""
    out = np.full(len(flat) + len(sizes) + 1, BOUNDARY, np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes + 1) - (sizes + 1)] = inside[-1] = False
    out[inside] = flat
    return out


class Codes(dict):
    """word -> its number in the chunk."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Texts in chunks of about ``chunk`` tokens, a row each: ``chunk, ids, sizes
    (-1 for a null text), codes, words, counts``. A text's tokens are codes, which
    number the distinct words of their own chunk: so what is joined to the
    vocabulary is a row a word and chunk, and texts are read and cut once. Codes
    take two bytes, or four in a chunk of more than 65,536 distinct words, and are
    compressed: they are what is shuffled most."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes, sizes, ids = Codes(), [], [], []
        pack = zstandard.ZstdCompressor(level=1).compress

        def out():
            flat = np.array(codes, "<u4")
            counts = np.bincount(flat, minlength=len(known)).astype(np.int64)
            one = lambda values: list_array(values, [len(values)])
            columns = [
                pa.array([uuid.uuid4().int >> 65]), one(pa.concat_arrays(ids)), one(pa.array(sizes, pa.int32())),
                pa.array([pack((flat if len(known) > 1 << 16 else flat.astype("<u2")).tobytes())], pa.binary()),
                one(pa.array(known.keys(), pa.string())), one(pa.array(counts)),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "sizes", "codes", "words", "counts"])

        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                words = tokens(t) if t else []
                codes += map(known.__getitem__, words)
                sizes.append(-1 if t is None else len(words))
                ids.append(b.column(0).slice(i, 1))
                if len(codes) + len(sizes) > chunk:
                    yield out()
                    known, codes, sizes, ids = Codes(), [], [], []
        if sizes:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"chunk bigint, ids array<{kind}>, sizes array<int>, codes binary, words array<string>, counts array<bigint>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each chunk: its batch and place there, the sizes of its texts, and its codes."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for i in range(b.num_rows):
            sizes = np.maximum(b.column("sizes")[i].values.to_numpy().astype(np.int64), 0)
            raw = unpack(b.column("codes")[i].as_py())
            yield b, i, sizes, np.frombuffer(raw, "<u4" if len(raw) == 4 * sizes.sum() else "<u2")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))


def word_counts(coded: DataFrame) -> DataFrame:
    """``word, n`` over all chunks."""
    each = coded.select(F.explode(F.arrays_zip("words", "counts")).alias("x"))
    return each.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"))


def _forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that are no longer read, and what was shuffled for tables that are written."""
    for t in tables:
        for path in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def bigrams(docs: DataFrame, vocabulary: list[str], *, text_col: str = "text") -> DataFrame:
    """``a, b, n`` over all texts with the given words, whose ids are their places."""
    return coded_bigrams(materialize(encode(_texts(docs, text_col)), "coded"), vocabulary)


def coded_bigrams(coded: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``a, b, n`` over all chunks, boundaries included, for a short list of words;
    all others are unknown. A task holds and sends len(vocabulary)^2 counts."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Ids(vocabulary), np.zeros(size * size, np.int64)
        for b, i, sizes, codes in _chunks(batches):
            words = np.fromiter(map(known.__getitem__, b.column("words")[i].as_py()), np.int64)
            at = bounded(words[codes], sizes)
            n += np.bincount(at[:-1] * size + at[1:], minlength=size * size)
        n[0] = 0  # between texts
        k = np.flatnonzero(n)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k // size), pa.array(k % size), pa.array(n[k])], ["a", "b", "n"])

    partial = coded.select("sizes", "codes", "words").mapInArrow(run, "a bigint, b bigint, n bigint")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def objective(n: np.ndarray) -> float:
    """The class bigrams' log-likelihood but for a constant: what exchange maximises."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum())


def best_move(n: np.ndarray, here: int, left: np.ndarray, right: np.ndarray, own: float, closed: tuple[int, ...] = ()) -> tuple[int, float]:
    """Of all classes but the boundary's and the ``closed`` ones, the one a word of
    class ``here`` is best in, and the gain in the objective over staying.

    left[h]: bigrams of the word followed by class h; right[g]: preceded by class
    g; own: of the word followed by itself (in both)."""
    m = n.copy()
    m[here] -= left
    m[:, here] -= right
    m[here, here] += own
    left, right = left.copy(), right.copy()
    left[here] -= own
    right[here] -= own  # the word's own pairs count where it goes
    rows, cols = m.sum(axis=1), m.sum(axis=0)
    h, g = np.flatnonzero(left), np.flatnonzero(right)  # rare words meet few classes
    after, before = m[:, h], m[g]
    gain = (_xlogx(after + left[h]) - _xlogx(after)).sum(axis=1) + (_xlogx(before + right[g, None]) - _xlogx(before)).sum(axis=0)
    d = np.diag(m)
    corner = _xlogx(d + left + right + own) - _xlogx(d + left) - _xlogx(d + right) + _xlogx(d)
    out, into = left.sum() + own, right.sum() + own
    # A row that isn't the word's own also changes where its column is the word's: totals of rows g grow by right[g] wherever the word goes.
    grown_rows, grown_cols = rows + right, cols + left
    margin = _xlogx(grown_rows + out) - _xlogx(grown_rows) + _xlogx(grown_cols + into) - _xlogx(grown_cols)
    score = gain + corner - margin
    stay = score[here]
    score[[BOUNDARY, *closed]] = -np.inf
    to = int(np.argmax(score))
    return to, float(score[to] - stay)


def best_moves(
    n: np.ndarray, here: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, closed: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """``best_move`` of many words at once: a row of left and right each."""
    each, c = np.arange(len(here)), len(n)

    def gains(m: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Sum over the classes h that mine meets of f(m'[:, h] + mine[h]) - f(m'[:, h]), m' without the word."""
        w, h = np.nonzero(mine)
        if not len(w):
            return np.zeros(mine.shape)
        base = m.T[h]
        base[np.arange(len(w)), here[w]] -= raw_of[id(mine)][w, h]
        same = np.flatnonzero(h == here[w])
        base[same] -= raw_of[id(other)][w[same]]
        base[same, here[w[same]]] += own[w[same]]
        add = mine[w, h][:, None]
        got = _xlogx(base + add) - _xlogx(base)
        out = np.zeros(mine.shape)
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] = np.add.reduceat(got, first, axis=0)
        return out

    l, r = left.copy(), right.copy()  # noqa: E741
    l[each, here] -= own
    r[each, here] -= own
    raw_of = {id(l): left, id(r): right}
    gain = gains(n, l, r) + gains(n.T, r, l)
    d = np.broadcast_to(np.diag(n), left.shape).copy()
    d[each, here] += own - left[each, here] - right[each, here]
    o = own[:, None]
    corner = _xlogx(d + l + r + o) - _xlogx(d + l) - _xlogx(d + r) + _xlogx(d)
    rows, cols = np.broadcast_to(n.sum(axis=1), left.shape) - right, np.broadcast_to(n.sum(axis=0), left.shape) - left
    rows[each, here] += own - left.sum(axis=1)
    cols[each, here] += own - right.sum(axis=1)
    out, into = l.sum(axis=1)[:, None] + o, r.sum(axis=1)[:, None] + o
    margin = _xlogx(rows + r + out) - _xlogx(rows + r) + _xlogx(cols + l + into) - _xlogx(cols + l)
    score = gain + corner - margin
    stay = score[each, here]
    score[:, [BOUNDARY, *closed]] = -np.inf
    to = score.argmax(axis=1)
    return to, score[each, to] - stay


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of words 2.. of the bigram counts ``pairs`` (words by falling
    frequency) and the class bigram counts. Word 0, the boundary, is alone in class
    0, and word 1, which stands for all others, in the last.

    Words start in turn in classes 1.., and one after another move to the class
    that raises the objective most, all counts being brought up to date after each
    move, until in a whole round no word moves: every move raises the objective by
    more than rounding, so there is an end. ``rounds`` ends it sooner."""
    v = len(pairs)
    c = max(1, min(classes, v - 2))
    k = c + 2
    cls = np.array([0, k - 1, *(1 + np.arange(v - 2) % c)])
    n = np.zeros((k, k))
    np.add.at(n, (cls[:, None].repeat(v, 1), cls[None].repeat(v, 0)), pairs)
    least, at = 1e-12 * max(1.0, abs(objective(n))), 0
    while rounds is None or at < rounds:
        at, moved = at + 1, False
        for w in range(2, v):
            left, right, own = np.bincount(cls, pairs[w], k), np.bincount(cls, pairs[:, w], k), pairs[w, w]
            here = cls[w]
            to, gain = best_move(n, here, left, right, own, (k - 1,))
            if gain <= least:
                continue
            n[here] -= left
            n[:, here] -= right
            n[here, here] += own
            left[here] -= own
            right[here] -= own
            left[to] += own
            right[to] += own
            n[to] += left
            n[:, to] += right
            n[to, to] -= own
            cls[w], moved = to, True
        if not moved:
            break
    return cls, n


def profiles(coded: DataFrame, head: dict[str, int], k: int) -> DataFrame:
    """``h, n, e`` of every word that isn't of the head: the hash of it, how often it
    occurs, and a list of (place, count): how often words of class c follow it at
    place c, come before it at k + c, and it follows itself at 2k. Words out of
    the head are of class k - 1. Combined within each task, so that a word sends
    at most 2k + 1 rows a flush, however hot."""
    wide = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            h, p, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((p, h))
            h, p, n = h[order], p[order], n[order]
            first = np.flatnonzero((np.diff(h, prepend=h[0]) != 0) | (np.diff(p, prepend=-1) != 0))
            return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(p[first].astype(np.int32)), pa.array(np.add.reduceat(n, first))], ["h", "p", "n"])

        for b, i, sizes, codes in _chunks(batches):
            words = b.column("words")[i].as_py()
            cls = np.array([0, *(head.get(w, k - 1) for w in words)])
            at = bounded(codes.astype(np.int64) + 1, sizes)
            a, c = at[:-1], at[1:]
            tail = cls == k - 1
            l, r = tail[a], tail[c]  # noqa: E741
            same = a[l & (a == c)]
            key, n = np.unique(np.concatenate([a[l] * wide + cls[c[l]], c[r] * wide + k + cls[a[r]], same * wide + 2 * k]), return_counts=True)
            place = key // wide
            hashes = np.zeros(len(cls), np.uint64)
            some = np.flatnonzero(tail)
            hashes[some] = [word_hash(words[x - 1]) for x in some.tolist()]
            held.append((hashes.view(np.int64)[place], key % wide, n))
            if sum(len(x[0]) for x in held) > FLUSH:
                yield out()
                held = []
        if held and sum(len(x[0]) for x in held):
            yield out()

    rows = coded.select("sizes", "codes", "words").mapInArrow(run, "h bigint, p int, n bigint").repartition("h")
    counts = rows.groupBy("h", "p").agg(F.sum("n").alias("n"))
    # A word is followed once each time that it occurs.
    return counts.groupBy("h").agg(F.sum(F.when(F.col("p") < k, F.col("n"))).alias("n"), F.collect_list(F.struct("p", "n")).alias("e"))


def word_hash(word: str) -> int:
    """Spark's xxhash64 of a word: what words are joined by. Two words of one hash
    would count as one; below 10^9 words none are expected to be."""
    return xxhash.xxh64_intdigest(word, seed=42)


def joined_classes(words: DataFrame, n: np.ndarray) -> DataFrame:
    """``h, c``: for each word of ``profiles`` the class of the head's that raises the
    objective most, all others being held where they are. Words go in parallel."""
    k = len(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = []
            for at in range(0, b.num_rows, 256):
                x = b.slice(at, 256)
                e = x.column(1)
                row = np.repeat(np.arange(x.num_rows), e.value_lengths().to_numpy())
                flat = e.flatten()
                met = np.zeros((x.num_rows, 2 * k + 1))
                met[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                to.append(best_moves(n, np.full(x.num_rows, k - 1), met[:, :k], met[:, k : 2 * k], met[:, 2 * k], (k - 1,))[0])
            if to:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(to).astype(np.int32))], ["h", "c"])

    return words.select("h", "e").mapInArrow(run, "h bigint, c int")


@dataclass(frozen=True)
class Model:
    """The words with their hashes, classes, counts and log P(word | class) are a
    written table, ``word, w, h, c, n, e``. What is held: log P(class | class before),
    each class's mass, and the number of unknown words, which share the probability
    of their class equally."""

    words: DataFrame
    transition: np.ndarray
    mass: np.ndarray
    strangers: int

    @cached_property
    def _rows(self) -> list:
        """All words on the driver: for small models only."""
        return self.words.orderBy("w").collect()

    @property
    def vocabulary(self) -> list[str]:
        return [r.word for r in self._rows]

    @property
    def classes(self) -> np.ndarray:
        return np.array([r.c for r in self._rows])

    @property
    def emission(self) -> np.ndarray:
        return np.array([r.e for r in self._rows])


def word_lists(coded: DataFrame, words: DataFrame) -> DataFrame:
    """``chunk, e_code, e_c, e_n``: lists of a chunk's words' numbers, classes and
    counts; a word that isn't known has -1 and 0."""
    each = coded.select("chunk", F.posexplode("words").alias("code", "word")).select("chunk", "code", F.xxhash64("word").alias("h"))
    each = each.join(words.where("h is not null").select("h", "c", "n"), "h", "left")
    lists = each.groupBy("chunk").agg(F.collect_list(F.struct("code", F.coalesce("c", F.lit(-1)).alias("c"), F.coalesce("n", F.lit(0)).alias("n"))).alias("e"))
    return lists.select("chunk", F.col("e.code").alias("e_code"), F.col("e.c").alias("e_c"), F.col("e.n").alias("e_n"))


def with_lists(coded: DataFrame, lists: DataFrame) -> DataFrame:
    return coded.select("chunk", "ids", "sizes", "codes").join(lists, "chunk", "left")


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, packed as tightly as words and counts can be."""
    codec = "spark.sql.parquet.compression.codec"
    before = df.sparkSession.conf.get(codec)
    df.sparkSession.conf.set(codec, "zstd")
    try:
        return materialize(df, name)
    finally:
        df.sparkSession.conf.set(codec, before)


def _along(b: pa.RecordBatch, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and counts of a chunk's words by code; those of unknown words are k - 1 and 0."""
    e = [b.column(x)[i].values for x in ("e_code", "e_c", "e_n")]
    if e[0] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, c, n = (x.to_numpy() for x in e)
    cls, count = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    cls[code], count[code] = np.where(c < 0, k - 1, c), n
    return cls, count


def class_bigrams(joined: DataFrame, k: int) -> np.ndarray:
    """How often classes follow one another; k x k counts a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k * k, np.int64)
        for b, i, sizes, codes in _chunks(batches):
            at = bounded(_along(b, i, k)[0][codes], sizes)
            n += np.bincount(at[:-1] * k + at[1:], minlength=k * k)
        n[0] = 0  # between texts
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["p", "n"])

    n = np.zeros(k * k)
    for r in joined.select("sizes", "codes", "e_code", "e_c", "e_n").mapInArrow(run, "p int, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect():
        n[r.p] = r.n
    return n.reshape(k, k)


def smoothed(n: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log P(class | class before), smoothed towards the classes' own frequencies by
    ``prior`` pseudo-counts; nothing has probability 0."""
    base = (n.sum(axis=0) + 1.0) / (n.sum() + len(n))
    return np.log((n + prior * base) / (n.sum(axis=1, keepdims=True) + prior))


def train(docs: DataFrame, *, classes: int = CLASSES, rounds: int | None = None, rate: float = 0.0, text_col: str = "text") -> Model:
    """Count words over all texts, cluster, estimate. Texts cut into tokens, counts
    and classes are written to the shared folder and read from there."""
    coded = _written(encode(_texts(docs, text_col)), "coded")
    return coded_model(coded, classes=classes, rounds=rounds, rate=rate)[0]


def coded_model(coded: DataFrame, *, classes: int, rounds: int | None, rate: float, add: float = ADD) -> tuple[Model, DataFrame]:
    """The model, and the lists of the chunks' words' classes and counts.

    Every word that occurs LEAST times is in the model, and the others are unknown
    words, a class of their own. (``rate``, a least part of all tokens, is off.) The
    HEAD most frequent words are clustered by exchange on the driver, which holds
    their HEAD^2 bigram counts; each other word then joins the class that it raises
    the objective most in, by its counts over all texts."""
    spark = coded.sparkSession
    counts = _written(word_counts(coded), "counts")
    enough = F.lit(LEAST)
    if rate:
        enough = F.lit(max(LEAST, rate * (counts.agg(F.sum("n")).first()[0] or 0)))
    head = [r.word for r in counts.where(F.col("n") >= enough).orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    listed = SPECIAL + head
    pairs = np.zeros((len(listed), len(listed)))
    for r in coded_bigrams(coded, listed).toLocalIterator():
        pairs[r.a, r.b] = r.n
    cls, n = exchange(pairs, classes, rounds)
    k = len(n)
    placed = {w: int(c) for w, c in zip(head, cls[2:])}
    _forget(spark)
    met = _written(profiles(coded, placed, k).where(F.col("n") >= enough), "met")
    heads = spark.createDataFrame([(w, c) for w, c in placed.items()], "word string, c int").select(F.xxhash64("word").alias("h"), "c")
    joined = materialize(joined_classes(met, n).union(heads), "classes")
    _forget(spark, met)
    words = counts.where(F.col("n") >= enough).withColumn("h", F.xxhash64("word")).join(joined, "h")
    rest = counts.where(F.col("n") < enough).agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    special = spark.createDataFrame([(SPECIAL[0], 0, 0, 1), (SPECIAL[1], 1, k - 1, rest.n)], "word string, w bigint, c int, n bigint")
    columns = "word", "w", "h", "c", "n"
    words = words.withColumn("w", F.monotonically_increasing_id() + 2).select(*columns)
    words = materialize(words.union(special.withColumn("h", F.lit(None).cast("bigint")).select(*columns)), "words")
    _forget(spark, counts, joined)
    mass = np.zeros(k)
    for r in words.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        mass[r.c] = r.n + add * r.k
    of_class = F.element_at(F.array(*map(F.lit, mass.tolist())), F.col("c") + 1)
    model = words.withColumn("e", F.log((F.col("n") + add) / of_class))
    lists = _written(word_lists(coded, words), "lists")
    _forget(spark)
    found = Model(model, smoothed(class_bigrams(with_lists(coded, lists), k)), mass, rest.k)
    _forget(spark)
    return found, lists


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob, perplexity`` of each document under the model,
    whose words are joined. Perplexity is for each token and the end. A null text
    has nulls; one without tokens is an end alone; null and repeated ids give a
    row each; other columns are ignored."""
    coded = _written(encode(docs, id_col=id_col, text_col=text_col), "coded")
    return _scores(with_lists(coded, word_lists(coded, model.words)), model)


def _scores(known: DataFrame, model: Model, add: float = ADD) -> DataFrame:
    transition, mass, strangers = model.transition, model.mass, model.strangers
    k = len(mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = -np.log(np.maximum(mass, 1e-300))  # of a class without words: not used
        for b, i, sizes, codes in _chunks(batches):
            cls, count = _along(b, i, k)
            emission = np.log(count + add) + spread[cls]
            emission[cls == k - 1] = -np.log(max(strangers, 1))
            at, em = bounded(cls[codes], sizes), np.zeros(len(codes) + len(sizes) + 1)
            inside = np.ones(len(at), bool)
            starts = np.cumsum(sizes + 1) - (sizes + 1)
            inside[starts] = inside[-1] = False
            em[inside] = emission[codes]
            logp = np.add.reduceat(transition[at[:-1], at[1:]] + em[1:], starts)
            none = b.column("sizes")[i].values.to_numpy() < 0
            yield pa.RecordBatch.from_arrays(
                [b.column("ids")[i].values, pa.array(sizes, mask=none), pa.array(logp, mask=none), pa.array(np.exp(-logp / (sizes + 1)), mask=none)],
                ["doc_id", "n_tokens", "log_prob", "perplexity"],
            )

    kind = known.schema["ids"].dataType.elementType.simpleString()
    return known.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_prob double, perplexity double")


def perplexities(docs: DataFrame, *, classes: int = CLASSES, rounds: int | None = None, rate: float = 0.0) -> DataFrame:
    """Each document's score under the model of all of them; see ``coded_model`` and
    ``score``. An empty table gives none."""
    coded = _written(encode(docs), "coded")
    model, lists = coded_model(coded, classes=classes, rounds=rounds, rate=rate)
    return _scores(with_lists(coded, lists), model)
