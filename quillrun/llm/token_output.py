"""Token ids in seekable zstandard shards.

A shard is a run of independent zstandard frames, each holding whole documents as
little-endian token ids, then a skippable frame with the seek table: for each
frame its compressed and decompressed size and the low 32 bits of the XXH64 of
its content. Standard decoders read such a file from front to back; a reader that
wants one document fetches the table and that document's frame alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack, unpack

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CHUNK, DEFAULT, Chunks, vocabulary
from .common import bound_batches, new_path

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
INDEX = "doc_id {}, shard string, frame int, start int, n_tokens int"


class FrameWriter:
    """Appends documents to a stream, a frame whenever enough bytes are together."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.size, self.table = 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the byte within it at which the document begins."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = len(self.table), self.size
        self.parts.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            raw = b"".join(self.parts)
            packed = self.zstd.compress(raw)
            self.sink.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(pack("<III", *row) for row in self.table)
        body += pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.sink.write(pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Reads single frames of a file that can seek, and checks their sums."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - 9)
        n, flags, magic = unpack("<IBI", source.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(size - 9 - 12 * n)
        rows = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.sums, self.sizes = rows[:, 2], rows[:, 1]
        self.offsets = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.offsets[k]))
        packed = self.source.read(int(self.offsets[k + 1] - self.offsets[k]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(1, int(self.sizes[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return raw


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_tokens(
    docs: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab_path: str = DEFAULT,
    frame_bytes: int = FRAME_BYTES,
    level: int = 3,
) -> DataFrame:
    """Encode every document and write shards under ``path``/shards; returns the
    index ``doc_id, shard, frame, start, n_tokens`` (``start`` in tokens within
    the frame), itself written to ``path``/index. ``path`` defaults to a new
    folder under the cluster's shared one.

    Each task writes one shard under a name of its own attempt and never renames
    or overwrites: Spark commits the index rows of the attempt that counts, so a
    lost executor leaves at most a shard no row names (``orphans``). Ids take two
    bytes, or four where the vocabulary has more than 65,536. There is no shuffle.

    A document lies in one frame whole, however long; an empty text has 0 tokens;
    a null text has a row with null shard, frame, start and n_tokens; null and
    repeated ids give a row each; an empty table gives an empty index; other
    columns are ignored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    fs, root = _open(path)
    fs.create_dir(f"{root}/shards", recursive=True)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        width = 2 if max(vocab.ranks.values()) < 1 << 16 else 4
        encode, code = vocab.encoding._core_bpe.encode_ordinary, "H" if width == 2 else "I"

        def make(chunk: str) -> bytes:
            ids = encode(chunk)
            return pack(f"<{len(ids)}{code}", *ids)

        get, cut, join = Chunks({}, make).__getitem__, CHUNK.findall, b"".join
        fs, root = _open(path)
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-w{width}.tok.zst"
        out = None
        for b in batches:
            rows = []
            if b.num_rows and out is None:
                sink = fs.open_output_stream(f"{root}/shards/{name}", compression=None)
                out = FrameWriter(sink, frame_bytes, level)
            for text in b.column(1).to_pylist():
                if text is None:
                    rows.append((None, None, None, None))
                    continue
                data = join(map(get, cut(text)))
                frame, start = out.add(data)
                rows.append((name, frame, start // width, len(data) // width))
            if rows:
                shard, frame, start, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(shard, pa.string()), *(pa.array(x, pa.int32()) for x in (frame, start, n))],
                    ["doc_id", "shard", "frame", "start", "n_tokens"],
                )
        if out:
            out.close()
            sink.close()

    kind = docs.schema[id_col].dataType.simpleString()
    index = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, INDEX.format(kind))
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def orphans(spark: SparkSession, path: str) -> list[str]:
    """Shards that no committed index row names: left by attempts that didn't count."""
    fs, root = _open(path)
    there = {f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/shards"))}
    named = spark.read.parquet(f"{path}/index").select("shard").distinct().toLocalIterator()
    return sorted(there - {r.shard for r in named})


def read_tokens(index: DataFrame, path: str) -> DataFrame:
    """``doc_id, tokens`` of the index rows given: filter the index first, and
    only the frames that its rows name are fetched, decompressed and checked.
    Rows are gathered by shard and frame, so that a frame is read once. How many
    bytes an id takes is in the shard's name. A row of a null text has null tokens;
    rows that repeat give a row each; an empty index gives none."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(path)
        at, reader, have, raw = None, None, None, b""
        for b in batches:
            tokens = []
            for shard, frame, start, n in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if shard is None:
                    tokens.append(None)
                    continue
                if at != shard:
                    at, reader, have = shard, FrameReader(fs.open_input_file(f"{root}/shards/{shard}")), None
                    width = int(re.search(r"-w(\d)\.tok", shard)[1])
                if have != frame:
                    have, raw = frame, reader.frame(frame)
                tokens.append(np.frombuffer(raw, f"<u{width}", n, start * width).astype("i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    sorted_ = index.repartition("shard", "frame").sortWithinPartitions("shard", "frame", "start")
    return sorted_.mapInArrow(run, f"doc_id {kind}, tokens array<int>")
