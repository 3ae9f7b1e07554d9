"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised here, not in the library: at each place the longest prefix
that the model's compiled character map knows is replaced, and the original byte
each normalised byte came from is recorded. Pieces found in the normalised text
are projected through that record to byte spans of the original UTF-8 text.
"""

from __future__ import annotations

import re
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import list_array, map_batches

DEFAULT = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SPACE = SPACE.encode()
REMEMBERED = 500_000
#: Longer chunks, as of texts without spaces, aren't remembered beyond their batch.
LONG = 64
CHUNK = re.compile(" +[^ ]*")


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, whose leaves point
    to zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units, self.text = (), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.text = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of data[at:] and its replacement; (0, b'') if none."""
        units = self.units
        if not units:
            return 0, b""
        found, value = 0, 0
        node = units[0]
        pos = (node >> 10) << ((node & 512) >> 6)
        for i in range(at, len(data)):
            pos ^= data[i]
            unit = units[pos]
            if unit & 0x800000FF != data[i]:
                break
            pos ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[pos] & 0x7FFFFFFF
        return found, self.text[value : self.text.index(b"\0", value)] if found else b""


def _char_length(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte
        at which what it came from begins (the very byte where nothing is replaced)."""
        steps: list[tuple[bytes, int, bool]] = []
        at = 0
        while at < len(data):
            n, new = self.map.longest(data, at)
            if not n:
                n = min(_char_length(data[at]), len(data) - at)
                new = data[at : at + n]
            steps.append((new, at, new == data[at : at + n]))
            at += n
        end = len(data)
        if self.trim:
            first = 0
            while first < len(steps) and steps[first][0] in (b" ", b""):
                first += 1
            steps = steps[first:]
        out, where = bytearray(), []
        space = _SPACE if self.escape else b" "
        if self.prefix and steps:
            out += space
            where += [steps[0][1] - 1] * len(space)  # it comes from nowhere: before the first
        was_space = self.trim
        for new, origin, same in steps:
            if self.trim and was_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            was_space = new.endswith(b" ")
            put = new.replace(b" ", space) if self.escape else new
            out += put
            where += range(origin, origin + len(put)) if same and put == new else [origin] * len(put)
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :]
                end = where[len(out)]
                del where[len(out) :]
        return bytes(out), np.array([*where, end], np.int64)


class Codec:
    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.normalizer = Normalizer(model.normalizer_spec)
        self.names = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.bytes = {i: int(n[3:5], 16) for i, (n, k) in enumerate(zip(self.names, kinds)) if k == 6}
        self.silent = {i for i, k in enumerate(kinds) if k == 3}
        self.unknown = kinds.index(2)
        #: The proof that chunks encode alone: no piece has a space mark after another character.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n, k in zip(self.names, kinds) if k in (1, 4))
        self.identity = not model.normalizer_spec.precompiled_charsmap and not self.normalizer.trim
        self.fast = self.identity and self.cuts and bool(self.bytes) and self.normalizer.prefix and self.normalizer.escape
        self.dummy = self.normalizer.prefix
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.ids = {n: i for i, n in enumerate(self.names)}
        self.seen: dict[str, bytes] = {}
        #: Bytes of the text that a piece covers, where a space mark stands for one space.
        self.sizes = np.array([1 if i in self.bytes else len(n.replace(SPACE, " ").encode()) for i, n in enumerate(self.names)], np.int32)

    def pieces(self, normalized: str) -> tuple[list[int], list[int]]:
        """Ids, and lengths in normalised bytes, of text that is normalised."""
        ids, sizes = [], []
        for p in self.library.encode(normalized, out_type=str):
            i = self.ids.get(p, self.unknown)
            ids.append(i)
            sizes.append(1 if i in self.bytes else len(p.encode()))
        return ids, sizes

    def _learn(self, chunks: set[str]) -> None:
        """Encodes, in one call of the library, the chunks not yet remembered."""
        new = list(chunks - self.seen.keys())
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = list(chunks)
        found = self.library.encode([c.replace(" ", SPACE) for c in new], out_type=int, num_threads=1)
        self.seen.update(zip(new, [struct.pack(f"<{len(x)}i", *x) for x in found]))

    def encode_many(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each text (of '' for None)."""
        out: list = [None] * len(texts)
        cut: dict[int, list[str]] = {}
        for k, t in enumerate(texts):
            if t and self.fast and SPACE not in t:
                cut[k] = CHUNK.findall(" " + t)
            else:
                out[k] = self.encode(t or "")
        self._learn(set().union(*cut.values()))
        get = self.seen.__getitem__
        long = [c for chunks in cut.values() for c in chunks if len(c) > LONG]
        for k, chunks in cut.items():
            ids = np.frombuffer(b"".join(map(get, chunks)), "<i4")
            ends = np.cumsum(self.sizes[ids], dtype=np.int32)
            ends -= 1  # the dummy prefix is no byte of the text
            begins = np.empty_like(ends)
            begins[0], begins[1:] = 0, ends[:-1]
            out[k] = ids, begins, ends
        for c in long:
            self.seen.pop(c, None)
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece the begin and end byte in the original text."""
        none = np.zeros(0, np.int32)
        if not text:
            return none, none, none
        data, where = self.normalizer.normalize(text.encode())
        norm = data.decode()
        if not norm:
            return none, none, none
        parts = [m.group() for m in re.finditer(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*", norm)] if self.cuts else [norm]
        ids, sizes = [], []
        for p in parts:
            a, b = self.pieces(p)
            ids += a
            sizes += b
        stops = np.cumsum(sizes)
        starts = stops - sizes
        ends = self._ends(where, stops)
        begins = where[starts]
        begins[starts == 0] = where[len(_SPACE if self.normalizer.escape else b" ") if self.dummy else 0]
        return np.array(ids, np.int32), begins.astype(np.int32), ends.astype(np.int32)

    @staticmethod
    def _ends(where: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A piece ends where the next original character after its last byte
        begins; pieces that share one replaced character share its end."""
        after = np.searchsorted(where, where[stops - 1], side="right")
        return np.where(after < len(where), where[np.minimum(after, len(where) - 1)], where[-1])

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes that each piece stands for."""

        def one(i: int, name: str) -> bytes:
            if i in self.bytes:
                return bytes([self.bytes[i]])
            if i == self.unknown:
                return " ⁇ ".encode()
            return b"" if i in self.silent else name.encode()

        return [one(i, name) for i, name in enumerate(self.names)]

    def decode(self, ids) -> str:
        """The text of pieces; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.spelled.__getitem__, ids)).replace(_SPACE, b" ").decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT, decoded: bool = False
) -> DataFrame:
    """One row a document: ``doc_id, ids, begins, ends``; piece k comes from bytes
    begins[k] to ends[k] of the UTF-8 text. No shuffle; two columns are read.

    Several pieces of one replaced character share its span. The dummy prefix is
    no part of the text, so a piece of it alone has an empty span. A null text
    has null lists, an empty one empty lists; null ids stay; rows that repeat give
    a row each; an empty table gives none; other columns are ignored. With
    ``decoded`` the text of the ids follows, as ``decode_pieces`` gives it.
    """
    names = ["doc_id", "ids", "begins", "ends", *(["decoded"] if decoded else [])]

    def start():
        c = codec(model_path)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            found = c.encode_many(texts)
            sizes = [len(x[0]) for x in found]
            null = pa.array([t is None for t in texts])
            columns = []
            for k in range(3):
                flat = np.concatenate([x[k] for x in found])
                lists = list_array(pa.array(flat, pa.int32()), sizes)
                if b.column(1).null_count:
                    lists = pa.compute.if_else(null, pa.scalar(None, lists.type), lists)
                columns.append(lists)
            if decoded:
                columns.append(pa.array([None if t is None else c.decode(x[0].tolist()) for t, x in zip(texts, found)], pa.string()))
            return pa.RecordBatch.from_arrays([b.column(0), *columns], names)

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>" + (", decoded string" if decoded else "")
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), start, schema)


def decode_pieces(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = DEFAULT) -> DataFrame:
    """``doc_id, text`` of piece ids: the inverse of ``encode_pieces`` where the
    model's normalisation is the identity and the text has no space mark of its
    own (one becomes a space). Null ids give a null text, an empty list ''."""

    def start():
        c = codec(model_path)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

        return each

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(F.col(id_col), F.col(ids_col)), start, f"doc_id {kind}, text string")
