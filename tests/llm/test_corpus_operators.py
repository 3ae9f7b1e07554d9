"""Neighbours, quality, SimHash, language model, mixing and the pipeline: brute force and held-out accuracy."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillrun.llm import ann, lm, mixing, quality, queries, simhash

SF = "/root/testdata/sf0.001"


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


# Neighbours


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 32)) * 3
    x = (centres[rng.integers(0, 20, 600)] + rng.standard_normal((600, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, distances int")
    got = {r.vec_id: r for r in ann.nearest_neighbours(df, 10, cell=200).collect()}
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i in range(600):
        best = np.argsort(d[i], kind="stable")[:10]
        hits += len(set(best.tolist()) & set(got[i].neighbours))
        for n, v in zip(got[i].neighbours, got[i].distances):
            assert abs(v - d[i, n]) < 1e-5
        assert list(got[i].distances) == sorted(got[i].distances)
    assert len(got) == 600 and hits / 6000 >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 0.0]), (5, [1.0]), (None, [1.0, 0.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (1, [1.0, 0.1]), (8, [0.9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.neighbours, r.distances) for r in ann.nearest_neighbours(df, 5).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert got[2][0][0] == 1 and got[2][1][0] == 0 and 1 not in got[1][0]
    assert all(got[i] == ([], []) for i in (3, 4, 5, 6, 7))
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_neighbours_are_distinct_ids_and_ties_go_to_the_least(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    once = [(i, v.tolist()) for i, v in enumerate(x)]
    near = [(70, (x[0] + 1e-3 * (j + 1)).tolist()) for j in range(15)]  # many near rows of one id
    same = [(i, [9.0] * 8) for i in range(120, 99, -1)]  # more equal vectors than k
    schema = "vec_id long, embedding array<float>"
    rows = once + near + same
    want = {r.vec_id: r.neighbours for r in ann.nearest_neighbours(spark.createDataFrame(rows, schema), 5, width=1e3).collect()}
    got = {r.vec_id: r.neighbours for r in ann.nearest_neighbours(spark.createDataFrame(rows * 6, schema), 5, width=1e3).collect()}
    assert want == got
    at = np.array([i for i, _ in rows])
    v = np.array([v for _, v in rows], np.float32).astype(float)
    for i in (0, 1, 70, 110, 120):
        d = {}
        for p in v[at == i]:
            for j, e in zip(at, ((v - p) ** 2).sum(axis=1)):
                if j != i:
                    d[j] = min(e, d.get(j, np.inf))
        assert got[i] == [int(j) for j in sorted(d, key=lambda j: (d[j], j))[:5]]


def test_neighbours_of_chosen_rows_in_split_cells(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 8)).astype(np.float32) * 1e-3 + 100  # a common offset, small differences
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    chosen = F.col("vec_id") % 5 == 0
    whole = {r.vec_id: (r.neighbours, r.distances) for r in ann.nearest_neighbours(df, 5, queries=chosen, width=20.0).collect()}
    split = {r.vec_id: (r.neighbours, r.distances) for r in ann.nearest_neighbours(df, 5, queries=chosen, width=20.0, members=40, asking=15).collect()}
    assert whole == split and set(whole) == {i for i, _ in rows if i % 5 == 0}
    v = np.array([v for _, v in rows], np.float32).astype(float)
    for k, (i, _) in enumerate(rows):
        if i % 5 == 0:
            d = ((v - v[k]) ** 2).sum(axis=1)
            best = sorted((d[j], rows[j][0]) for j in range(len(rows)) if j != k)[:5]
            assert whole[i][0] == [j for _, j in best]


def test_probes_come_in_order_and_never_move_a_slot_twice():
    t = ann.probe_template(6, 100)
    assert t.shape == (100, 12) and not t[0].any() and len({tuple(r) for r in t}) == 100
    h = ann.Hashes(8, 1.0, 2, functions=6, tables=1, probes=50)
    x = np.random.default_rng(1).standard_normal((5, 8)).astype(np.float32)
    slots, moved = h.probed(0, x)
    assert (moved[:, 0] == slots).all() and np.abs(moved - slots[:, None]).max() == 1
    assert all(len({tuple(r) for r in m}) == 50 for m in moved)


# Quality


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0)
    model = quality.fit(docs, train)
    rest = labels.join(train.select("doc_id"), "doc_id", "left_anti")
    judged = quality.classify(docs, model).join(rest, "doc_id").collect()
    right = sum(r.keep == (r.quality > 0) for r in judged)
    assert len(judged) > 60 and right / len(judged) >= 0.9


def test_votes_against_a_loop():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.02, (60, quality.FEATURES)).astype(np.float32)
    counts[40] = counts[3]
    good = rng.random(60) > 0.5
    m = quality.fit_arrays(counts, good, rank=8, k=5)
    ask = counts[:10]
    v = m.vectors_of(ask)
    for row, got in zip(v, m.scores(ask)):
        cos = sorted(((float(row @ x), bool(g)) for x, g in zip(m.vectors, good)), key=lambda p: -p[0])
        near = [p for p in cos if p[0] >= cos[4][0] - 1e-6]
        whole = sum(max(c, 0) ** m.power for c, _ in near)
        assert abs(got - sum(max(c, 0) ** m.power for c, g in near if g) / whole) < 1e-4


def test_quality_of_odd_rows(spark):
    rows = [(1, "good words in a row", "k", 9), (2, "zz zz zz zz zz", None, None), (3, None, "", 0), (4, "", "", 0), (None, "good words", "", 0), (1, "good words in a row", "k", 9), (5, "x" * 100_000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string, score long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {}
    for r in quality.classify(docs, model).collect():
        got.setdefault(r[0], []).append((r[1], r[2]))
    assert got[3] == got[4] == [(None, True)] and len(got[1]) == 2 and got[1][0][1] and not got[2][0][1]
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 1").count() == 2
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.kept_documents(docs, None).count() == len(rows)
    assert quality.classify(docs.limit(0), model).count() == 0


# SimHash


def words(rng, n):
    return [f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.randrange(60)}word" for _ in range(n)]


def brute_groups(prints, distance):
    n = len(prints)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if sum(int(a ^ b).bit_count() for a, b in zip(prints[i].tolist(), prints[j].tolist())) <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (40, 2), dtype=np.uint64)
    near = base.copy()
    for r in near:
        for b in rng.integers(0, 128, 10):
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    prints = np.concatenate([base, near, base[:5]])
    ranks = simhash.gray_rank(prints)
    assert (simhash.gray_word(ranks.copy()) == prints).all()
    order = np.lexsort((ranks[:, 1], ranks[:, 0]))
    p = prints[order]
    for starts in ([0], [0, 30, 31]):
        i, j = simhash.near_pairs(p, np.array(starts), 20)
        group = np.searchsorted(starts, np.arange(len(p)), side="right")
        want = {(a, b) for b in range(len(p)) for a in range(b) if group[a] == group[b] and np.bitwise_count(p[a] ^ p[b]).sum() <= 20}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("bits", [17, 18, 19, 20])
def test_pairs_at_the_edge_of_the_distance_are_found(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, (3000, 2), dtype=np.uint64)
    far = base[:1000].copy()
    for r in far:
        for b in rng.choice(128, bits, replace=False):
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    ranks = simhash.gray_rank(np.concatenate([base, far])).view(np.int64)
    df = spark.createDataFrame([(int(h), int(w), i) for i, (h, w) in enumerate(ranks.tolist())], "hi long, lo long, rep long")
    n_bits, tables = simhash.plan(250_000)
    got = {(r.u, r.v) for r in simhash._search(df, n_bits, tables, simhash.DISTANCE).collect()}
    found = sum((3000 + i, i) in got for i in range(1000))
    assert found >= (990 if bits < 20 else 980)
    for n in (10, 10**4, 10**6, 10**9, 10**11):
        k, t = simhash.plan(n)
        assert 1 - (1 - (1 - simhash.DISTANCE / 128) ** k) ** t >= 0.99


def test_a_large_cluster_is_one_component():
    rng = np.random.default_rng(2)
    one = np.repeat(rng.integers(0, 2**63, (1, 2), dtype=np.uint64), 3000, axis=0)
    for r in one:
        for b in rng.integers(0, 128, 6):
            r[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    ranks = simhash.gray_rank(np.concatenate([one, rng.integers(0, 2**63, (50, 2), dtype=np.uint64)]))
    words = simhash.gray_word(ranks[np.lexsort((ranks[:, 1], ranks[:, 0]))].copy())
    label = simhash.linked(words, np.array([0]), 20)
    i, j = simhash.near_pairs(words, np.array([0]), 20)
    want = np.arange(len(words))
    simhash._join(want, i, j)
    assert (label == want).all() and len(set(label.tolist())) == 51


def test_gray_ranks_sort_neighbouring_words():
    ranks = np.stack([np.zeros(16, np.uint64), np.arange(16, dtype=np.uint64)], axis=1)
    w = simhash.gray_word(ranks.copy())
    assert all(np.bitwise_count(a ^ b).sum() == 1 for a, b in zip(w[:-1], w[1:]))


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        t = words(rng, 120)
        texts.append(" ".join(t))
        if rng.random() < 0.6:
            t[rng.randrange(120)] = "changed"
            texts.append(" ".join(t))
        if rng.random() < 0.3:
            texts.append(texts[-1])
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_id string")
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(df).collect()}
    prints, _ = simhash.Fingerprinter().prints(texts)
    want = brute_groups(prints, simhash.DISTANCE)
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts)


def test_dedup_of_odd_rows(spark):
    same = " ".join(words(random.Random(6), 50))
    rows = [(5, same, 1), (2, same, 2), (9, same.upper(), 3), (1, None, 4), (3, "", 5), (4, " ", 6), (None, same, 7), (None, None, 8), (6, "!!!", 9), (7, "!!!", 10), (8, "other text altogether", 11), (8, "other text altogether", 11), (11, "x " * 60_000, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hi int")
    groups = simhash.near_duplicates(df)
    got = {r.doc_id: r.group_id for r in groups.collect()}
    assert got == {5: 2, 2: 2, 9: 2, 1: 1, 3: 3, 4: 4, 6: 6, 7: 6, 8: 8, 11: 11}
    kept = simhash.kept_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.hi) for r in kept.collect()) == [(-1, 7), (-1, 8), (1, 4), (2, 2), (3, 5), (4, 6), (6, 9), (8, 11), (11, 12)]
    members = {r.doc_id: list(r.members) for r in simhash.kept_with_members(groups).collect()}
    assert members[2] == [2, 5, 9] and members[6] == [6, 7] and members[1] == [1]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.kept_documents(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 50) for i in range(1, 30)] + [(129, 7)]
    got = {r.u: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 0 for i in range(1, 30)}, 50: 0}


# Language model


def test_moves_gain_what_they_say():
    rng = np.random.default_rng(7)
    v, c = 12, 4
    pairs = rng.integers(0, 6, (v, v)).astype(float)
    cls = np.array([0, *rng.integers(1, c, v - 1)])

    def table(cls):
        n = np.zeros((c, c))
        np.add.at(n, (cls[:, None].repeat(v, 1), cls[None].repeat(v, 0)), pairs)
        return n

    n = table(cls)
    for w in range(1, v):
        left, right = (np.bincount(cls, x, minlength=c).astype(float) for x in (pairs[w], pairs[:, w]))
        to, gain = lm.best_move(n, int(cls[w]), left, right, pairs[w, w])
        found = {}
        for t in range(1, c):
            moved = cls.copy()
            moved[w] = t
            found[t] = lm.objective(table(moved)) - lm.objective(n)
        assert abs(gain - found[to]) < 1e-6 and abs(max(found.values()) - gain) < 1e-6


def test_classes_and_scores(spark):
    rng = random.Random(8)
    a, b = ["cat", "dog", "cow", "hen"], ["runs", "eats", "naps", "sits"]
    texts = [" ".join(x for _ in range(20) for x in (rng.choice(a), rng.choice(b))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (None, "cat runs", 1), (1, texts[1], 1), (902, "zebra " * 20_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    model = lm.train(df, classes=4, rounds=8, rate=1e-4)
    at = {w: model.classes[i] for i, w in enumerate(model.vocabulary)}
    assert not {at[w] for w in a} & {at[w] for w in b}  # no class has words of both kinds
    for c in range(model.transition.shape[0]):  # what follows a class sums to 1
        assert abs(np.exp(model.transition[c]).sum() - 1) < 1e-9
        mine = model.classes == c
        assert not mine.any() or abs(np.exp(model.emission[mine]).sum() - 1) < 1e-9
    got = {}
    for r in lm.score(df, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    get = lm.Ids(model.vocabulary).__getitem__
    for i in (0, 902):
        ids = [0, *map(get, lm.tokens(rows[i][1] if i == 0 else "zebra " * 20_000)), 0]
        want = sum(model.transition[model.classes[x], model.classes[y]] + model.emission[y] for x, y in zip(ids, ids[1:]))
        assert abs(got[i][0].log_prob - want) < 1e-6 * abs(want)
        assert abs(got[i][0].perplexity - math.exp(-want / (len(ids) - 1))) < 1e-6
    assert got[900][0].perplexity is None and got[901][0].n_tokens == 0 and len(got[1]) == 2 and len(got[None]) == 1
    shuffled = spark.createDataFrame([(0, "cat runs dog eats"), (1, "runs eats cat dog")], "doc_id long, text string")
    p = {r.doc_id: r.perplexity for r in lm.score(shuffled, model).collect()}
    assert p[0] < p[1]
    assert lm.perplexities(empty(spark)).count() == 0


def test_bigrams_against_a_loop(spark):
    texts = ["a b a b", "b", None, "", "c a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = ["\x00<s>", "\x00<unk>", "a", "b"]
    got = {(r.a, r.b): r.n for r in lm.bigrams(df, vocab).collect()}
    want = {}
    for t in texts:
        if t:
            ids = [0, *({"a": 2, "b": 3}.get(w, 1) for w in t.split()), 0]
            for p in zip(ids, ids[1:]):
                want[p] = want.get(p, 0) + 1
    assert got == want


def test_moves_of_many_words_are_those_of_each():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(0.3, (60, 60)).astype(float)
    cls = np.concatenate([[0], 1 + np.arange(59) % 7])
    n = np.zeros((8, 8))
    np.add.at(n, (cls[:, None], cls[None]), pairs)
    left, right = (np.stack([np.bincount(cls, x, minlength=8) for x in m[1:]]) for m in (pairs, pairs.T))
    to, gain = lm.best_moves(n, cls[1:], left, right, np.diag(pairs)[1:])
    for i in range(59):
        t, g = lm.best_move(n, int(cls[i + 1]), left[i], right[i], pairs[i + 1, i + 1])
        assert abs(g - gain[i]) < 1e-6 and (t == to[i] or g < 1e-6)


def test_words_keep_their_ids_in_a_large_corpus(spark):
    texts = ["the " * 100_000] * 8 + ["a quagga ran"] * 3 + ["one xylem"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(df, classes=3, rounds=1)
    assert {"the", "a", "quagga", "ran"} <= set(model.vocabulary) and "xylem" not in model.vocabulary


# Mixing


def test_margins_are_met(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", None]), rng.choice(["en", "fr"]), 5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate int")
    targets = {"source": {"a": 0.5, "b": 0.2, "c": 0.2, None: 0.1, "none": 0.3}, "lang": {"en": 0.4, "fr": 0.6}}
    got = mixing.mixing_rates(df, targets).collect()
    info = {r[0]: r for r in rows}
    whole = sum(r.n_tokens for r in got)
    for col, margin in ((2, targets["source"]), (3, targets["lang"])):
        known = sum(v for k, v in margin.items() if k != "none")
        for k, v in margin.items():
            if k != "none":
                mine = sum(r.rate * r.n_tokens for r in got if info[r.doc_id][col] == k)
                assert abs(mine / whole - v / known) < 1e-6
    # Exponential tilting: in a cell log rates are proportional to tokens.
    cell = [r for r in got if info[r.doc_id][2:4] == ("a", "en")]
    slopes = [math.log(r.rate) / r.n_tokens for r in cell]
    assert max(slopes) - min(slopes) < 1e-9
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)
    assert abs(sum(r.copies for r in got) / sum(r.rate for r in got) - 1) < 0.1
    mixed = mixing.mixed_documents(df, targets)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_margins_are_met_beside_a_very_long_document(spark):
    rng = np.random.default_rng(6)
    size = np.clip(rng.lognormal(5.5, 1, 4000), 1, 5000).astype(int)
    rows = [("abc"[rng.choice(3, p=[0.8, 0.15, 0.05])], "xy"[i % 2], int(t)) for i, t in enumerate(size)] + [("a", "x", 1_000_000)]
    df = spark.createDataFrame(rows, "source string, lang string, __t long")
    found = mixing.balance(df)
    assert found.gap < 1e-6
    lam = dict(zip(found.cells, found.lam))
    kept, there = {}, {}
    for s, g, t in rows:
        for k in (s, g):
            kept[k] = kept.get(k, 0) + t * math.exp(lam[s, g] * t / found.scale)
            there[k] = there.get(k, 0) + t
    for names in ("abc", "xy"):
        goal = mixing.tempered({k: there[k] for k in names}, 0.7)
        assert all(abs(kept[k] / sum(there[x] for x in names) / goal[k] - 1) < 1e-5 for k in names)


def test_targets_that_cannot_be_met_are_reported(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "x", 20), ("b", "y", 10)], "source string, lang string, __t long")
    with pytest.warns(RuntimeWarning, match="off its target"):
        found = mixing.balance(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}})
    assert found.gap > 0.01 and np.isfinite(found.lam).all()


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a", "en"), (2, "", None, None), (3, "x " * 50_000, "a", "en"), (3, "y", "a", None), (None, "z z", "b", "en"), (None, "z z", "b", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mixing_rates(df).collect()
    assert len(got) == 6 and {(r.doc_id, r.rate, r.copies) for r in got if r.doc_id in (1, 2)} == {(1, 1.0, 1), (2, 1.0, 1)}
    assert mixing.mixing_rates(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# Queries and the pipeline


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, sql = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = lambda cols, rows: sorted((tuple(norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows), key=repr)
    assert sorted(df.columns) == sorted(sql.columns) and order(df.columns, df.collect()) == order(sql.columns, sql.fetchall())


@pytest.mark.skipif("pipeline" not in entry.queries(), reason="corpus_pipeline.py isn't there")
def test_pipeline_against_its_stages(spark):
    import sentencepiece

    from quillrun.llm import piece_codec

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    scores = dict(zip(texts, model.scores(quality.Featurizer().counts(list(texts.values())))))
    kept = sorted(i for i, s in scores.items() if math.isnan(s) or s >= 0.5)
    prints, _ = simhash.Fingerprinter().prints([texts[i] for i in kept])
    label = brute_groups(prints, simhash.DISTANCE)
    stay = [i for k, i in enumerate(kept) if label[k] == k]
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(docs.where(F.col("doc_id").isin(stay))).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT)
    want = sorted((i, sp.encode(texts[i])) for i in stay for _ in range(copies[i]))
    got = sorted((r.doc_id, list(r.ids)) for r in entry.queries()["pipeline"](spark, SF).collect())
    assert got == want
