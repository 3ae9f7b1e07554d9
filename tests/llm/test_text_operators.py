"""Chat, fingerprints, token output, token counts and pieces: brute force and round trips."""

import random
from hashlib import md5

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from quillrun.llm import bpe, chat, fingerprints, piece_codec, queries, token_counts, token_output

ODD = [
    None, "", " ", "\n\n", "a", "Hello, world! It's 42°", "x" * 50_000, "  two  spaces\t\ttabs\r\n", "naïve café ﬁ ½ Å", "日本語のテキスト", "🙂👩‍👩‍👧 emoji",
    "<|endoftext|> not special", "same words here and more", "same words here and more", " nbsp　wide", "▁mark", "a" * 3 + "\x00b", "word " * 3000,
]


def docs(spark, texts=ODD):
    """Rows with an extra column of a clashing name, a null id and a repeated id."""
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "no id here", "x", 2.0), (0, "again zero", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep string, score double")


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


# Chat


def brute_fold(log):
    convs = {}
    for e in log:
        if e[0] is not None:
            convs.setdefault(e[0], set()).add(e)
    out = {}
    key = lambda e: tuple((x is not None, x) for x in (e[1], e[2], e[3], e[4], e[5]))
    for conv, events in convs.items():
        turns = {}
        for _, _, kind, turn, role, text in sorted(events, key=key):
            kind = kind and kind.lower()
            if kind == "regenerate":
                turns = {t: v for t, v in turns.items() if turn is not None and t < turn}
                continue
            if turn is None or kind not in ("message", "delta", "edit", "delete"):
                continue
            if kind == "delete":
                turns.pop(turn, None)
            elif kind == "delta" and turn in turns:
                old_role, old = turns[turn]
                turns[turn] = (role or old_role, old + (text or ""))
            else:
                turns[turn] = (role, text or "")
        for t, (role, text) in turns.items():
            out[conv, t] = (role or "unknown", text)
    return out


def test_fold_against_a_loop(spark):
    rng = random.Random(3)
    log = []
    for conv in [1, 2, 3, None]:
        for seq in range(60):
            kind = rng.choice(["message", "delta", "delta", "DELTA", "edit", "regenerate", "delete", "other", None])
            log.append((conv, seq if rng.random() > 0.05 else None, kind, rng.choice([0, 1, 2, 3, None]) if kind != "regenerate" else rng.choice([1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b\n", "", None])))
    log += log[:40]
    df = spark.createDataFrame(log, chat.EVENTS).withColumn("extra", F.lit(1))
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold_events(df).collect()}
    want = brute_fold(log)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert chat.fold_events(df.limit(0)).count() == 0


def test_turns_without_an_end_and_markers(spark):
    turns = [(1, 1, "user", "hi <|im_end|>"), (1, 0, "system", None), (2, 0, None, "x"), (1, 2, "assistant", "word " * 100)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_messages, r.text) for r in chat.render(chat.fold_events(chat.log_of_turns(df))).collect()}
    assert got[1] == (3, "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nhi < |im_end| ><|im_end|>\n<|im_start|>assistant\n" + "word " * 100 + "<|im_end|>\n")
    assert got[2] == (1, "<|im_start|>unknown\nx<|im_end|>\n")


# Fingerprints


def brute_sketch(text, k, width):
    words = text.encode().lower().split()
    if not words:
        return []
    width = min(width, len(words))
    out = set()
    for i in range(len(words) - width + 1):
        a = b = 0
        for w in words[i : i + width]:
            d = md5(w).digest()
            a = (a * fingerprints.FACTORS[0] + int.from_bytes(d[:4], "big") % fingerprints.PRIME) % fingerprints.PRIME
            b = (b * fingerprints.FACTORS[1] + int.from_bytes(d[4:8], "big") % fingerprints.PRIME) % fingerprints.PRIME
        out.add((a << 31) | b)
    return sorted(out)[:k]


def test_sketches_against_a_loop(spark):
    got = by_id(fingerprints.bottom_k(docs(spark), k=20), "sketch")
    for i, t in enumerate(ODD[1:], 1):
        assert got[i] == [(brute_sketch(t, 20, 5),)]
    assert (None,) in got[0] and len(got[0]) == 2
    assert fingerprints.bottom_k(empty(spark)).count() == 0


def test_merged_sketches_are_the_unions(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(12)]
    parts = fingerprints.bottom_k(docs(spark, texts).where("doc_id is not null and score = 1"), k=32).withColumn("g", F.col("doc_id") % 3)
    whole = {r.g: r.sketch for r in fingerprints.merge_sketches(parts, ["g"], k=32).collect()}
    for g in range(3):
        union = set().union(*(brute_sketch(t, 10**6, 5) for t in texts[g::3]))
        assert whole[g] == sorted(union)[:32]


def test_estimates(spark):
    rng = random.Random(2)
    a = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    one, two = " ".join(a), " ".join(a[:2000])
    rows = spark.createDataFrame([(0, one), (1, two), (2, ""), (3, None)], "doc_id long, text string")
    ref = rows.where("doc_id = 0").select(F.col("doc_id").alias("item_id"), "text")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(rows, ref, k=256).collect()}
    assert got[0].resemblance == got[0].containment == 1
    assert got[1].containment == 1 and abs(got[1].resemblance - 0.5) < 0.1 and abs(got[1].n_distinct / 1996 - 1) < 0.2
    assert (got[2].n_distinct, got[2].resemblance) == (0, None) and got[3].n_distinct is None and got[3].sketch is None
    none = fingerprints.fingerprint_documents(rows, ref.limit(0), k=256).where("doc_id = 0").first()
    assert (none.resemblance, none.containment) == (0, 0)


# Tokens


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.DEFAULT).ranks, special_tokens={})


def test_token_counts(spark, oracle):
    got = by_id(token_counts.token_counts(docs(spark)), "n_tokens", "n_whole")
    whole = bpe.whole_tokens(bpe.DEFAULT)
    for i, t in enumerate(ODD[1:], 1):
        pieces = bpe.vocabulary(bpe.DEFAULT).pieces.findall(t)
        assert got[i] == [(len(oracle.encode_ordinary(t)), sum(p in whole for p in pieces))]
    assert (None, None) in got[0] and len(got[None]) == 1
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_whole_tokens_are_proved(oracle):
    for text, rank in list(bpe.whole_tokens(bpe.DEFAULT).items())[::97]:
        assert oracle.encode_ordinary(text) == [rank]


def test_token_output_round_trip(spark, oracle, tmp_path):
    path = f"file://{tmp_path}/t"
    index = token_output.write_tokens(docs(spark).repartition(3), path, frame_bytes=4096)
    got = by_id(token_output.read_tokens(index, path), "tokens")
    for i, t in enumerate(ODD[1:], 1):
        assert got[i] == [(oracle.encode_ordinary(t),)]
    assert (None,) in got[0] and (oracle.encode_ordinary("again zero"),) in got[0]
    some = token_output.read_tokens(index.where("doc_id = 5"), path).collect()
    assert len(some) == 1
    assert token_output.orphans(spark, path) == []
    (tmp_path / "t/shards/part-lost.tok.zst").write_bytes(b"")
    assert token_output.orphans(spark, path) == ["part-lost.tok.zst"]
    assert token_output.write_tokens(empty(spark), f"file://{tmp_path}/e").count() == 0


def test_frames_are_checked(tmp_path):
    p = tmp_path / "a.zst"
    with p.open("wb") as f:
        w = token_output.FrameWriter(f, 100)
        places = [w.add(bytes([i]) * 60) for i in range(5)]
        w.close()
    assert places == [(i, 0) for i in range(5)]
    with p.open("rb") as f:
        r = token_output.FrameReader(f)
        assert r.frame(3) == bytes([3]) * 60
        r.sums = r.sums.copy()
        r.sums[3] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            r.frame(3)
    import zstandard

    with p.open("rb") as f:  # a plain decoder reads the file whole
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert whole == b"".join(bytes([i]) * 60 for i in range(5))


# Pieces


def test_pieces_against_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT)
    got = by_id(piece_codec.encode_pieces(docs(spark)), "ids", "begins", "ends")
    for i, t in enumerate(ODD[1:], 1):
        ((ids, begins, ends),) = got[i]
        assert ids == sp.encode(t)
        data = t.encode()
        assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data  # spans tile the text
    assert (None, None, None) in got[0]
    assert piece_codec.encode_pieces(empty(spark)).count() == 0


def test_pieces_round_trip(spark):
    plain = [t for t in ODD if t is not None and "▁" not in t]
    df = docs(spark, plain).where("doc_id is not null and score = 1")
    got = by_id(piece_codec.decode_pieces(piece_codec.encode_pieces(df)), "text")
    assert {i: v[0][0] for i, v in got.items()} == dict(enumerate(plain))


def test_the_query_decodes_what_it_encodes(spark):
    sf_dir = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op9_sentencepiece(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.decoded == sp.decode(list(r.ids)) for r in got)
    assert all(r.decoded == texts[r.doc_id] for r in got if "▁" not in texts[r.doc_id])
    odd = by_id(piece_codec.encode_pieces(docs(spark), decoded=True), "decoded")
    assert (None,) in odd[0]


def trie(pairs):
    """A compiled map of single-byte keys, by hand: root at 0, children at base ^ byte."""
    units = [0] * 1024
    base = 256
    units[0] = base << 10
    text = b""
    for key, new in pairs:
        at = base ^ key
        leaf = 512 + 2 * key
        units[at] = key | 1 << 8 | (at ^ leaf) << 10
        units[leaf] = len(text) | 0x80000000
        text += new + b"\0"
    raw = np.array(units, "<u4").tobytes()
    return len(raw).to_bytes(4, "little") + raw + text


def test_offsets_through_a_map():
    m = piece_codec.CharacterMap(trie([(ord("A"), b"aa"), (ord("-"), b"")]))
    assert m.longest(b"xA", 1) == (1, b"aa") and m.longest(b"x", 0) == (0, b"")

    class Spec:
        precompiled_charsmap = trie([(ord("A"), b"aa"), (ord("-"), b"")])
        add_dummy_prefix = remove_extra_whitespaces = escape_whitespaces = True

    data, where = piece_codec.Normalizer(Spec).normalize(b"  A-b  c ")
    assert data.decode() == "▁aab▁c"
    assert where[3:].tolist()[:3] == [2, 2, 4] and where[-1] == 8
