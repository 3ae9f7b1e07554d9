"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, DEFAULT, Chunks, vocabulary, whole_tokens
from .common import map_batches

_WHOLE = 40  # a chunk's value: its tokens, and from this bit on its pre-tokens that are whole tokens


def counter(path: str):
    """text -> tokens + (pre-tokens counted by the shortcut << 40)."""
    vocab, whole = vocabulary(path), whole_tokens(path)

    def make(chunk: str) -> int:
        n = short = 0
        for piece in vocab.pieces.findall(chunk):
            if piece in whole:
                short += 1
            else:
                n += len(vocab.merge(piece))
        return n + short + (short << _WHOLE)

    one = 1 + (1 << _WHOLE)
    known = Chunks(dict.fromkeys((t for t in whole if CHUNK.findall(t) == [t]), one), make)
    get, cut = known.__getitem__, CHUNK.findall
    return lambda text: sum(map(get, cut(text)))


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = DEFAULT) -> DataFrame:
    """One row a document: ``doc_id, n_tokens, n_whole``.

    ``vocab_path`` is proved offline, once a worker: a vocabulary string is in the
    shortcut if as a pre-token it encodes to its own single id. A pre-token found
    there counts as one token (``n_whole`` of them); only the rest are merged.
    No shuffle, and only the id and text columns are read.

    A null text has null counts, an empty one 0; a null id stays null; rows that
    repeat give a row each; an empty table gives none; other columns are ignored.
    """

    def start():
        count = counter(vocab_path)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            n = [None if t is None else count(t) for t in b.column(1).to_pylist()]
            low = (1 << _WHOLE) - 1
            return pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x if x is None else x & low for x in n], pa.int64()),
                    pa.array([x if x is None else x >> _WHOLE for x in n], pa.int64()),
                ],
                ["doc_id", "n_tokens", "n_whole"],
            )

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(F.col(id_col), F.col(text_col)), start, f"doc_id {kind}, n_tokens bigint, n_whole bigint"
    )
