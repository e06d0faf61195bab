"""MinHash, sharding, quality, BPE, language ID, top-k and line dedup: edge cases and brute force."""

import base64
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import bpe, dart_minhash, language_id, line_dedup, mixing, quality, sharding, topk
from keelson.llm.common import held_out

from .test_native_ops import LONG, documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# MinHash


def brute_classes(rows, threshold=dart_minhash.THRESHOLD):
    sets = [frozenset(s.tolist()) for s in dart_minhash.shingle_sets(pa.array([t or "" for _, t in rows], pa.string()))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            root[find(a)] = find(b)
    classes = {}
    for k, (i, _) in enumerate(rows):
        classes.setdefault(find(k), []).append(i)
    return sorted(((i, min((j for j in c if j is not None), default=None), len(c)) for c in classes.values() for i in c), key=repr)


def test_near_duplicates_equal_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf).select("doc_id", "text").collect()]
    got = dart_minhash.near_duplicates(read(spark, sf)).collect()
    assert sorted([(r["doc_id"], r["class_id"], r["class_size"]) for r in got], key=repr) == brute_classes(rows)


def test_near_duplicate_cases(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(200)]
    rows = [(9, " ".join(base)), (3, " ".join(base[:-3])), (3, " ".join(base[:-3])), (4, " ".join(["New", "start", *base])), (1, None), (2, ""), (5, "one two"), (6, "One, two!"), (7, "one three"), (None, " ".join(base)), (8, LONG), (10, "!!!")]
    docs = documents(spark, rows)
    got = dart_minhash.near_duplicates(docs).collect()
    want = brute_classes(rows)
    assert sorted([(r["doc_id"], r["class_id"], r["class_size"]) for r in got], key=repr) == want
    left = dart_minhash.drop_near_duplicates(docs)
    # The repeated row of id 3 stays or goes with its twin; it is the class's first.
    assert left.columns == docs.columns and sorted([r["doc_id"] for r in left.collect()]) == [1, 2, 3, 3, 5, 7, 8, 10]
    assert dart_minhash.near_duplicates(docs.where("false")).collect() == []


def test_a_bucket_that_its_leader_does_not_join(spark):
    """Chains and several classes in shared buckets: bands of one row collide at low similarity."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 120])) for k in range(40)] + [(100 + k, " ".join(words[k * 6 : k * 6 + 119])) for k in range(40)]
    got = dart_minhash.near_duplicates(documents(spark, rows), bands=20, rows=1).collect()
    assert sorted([(r["doc_id"], r["class_id"], r["class_size"]) for r in got], key=repr) == brute_classes(rows)


def test_sketch_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    seen, true = [], []
    for _ in range(40):
        e = rng.integers(0, 2**63, 50).astype(np.uint64)
        a = rng.uniform(0.1, 5, 50)
        b = a * rng.uniform(0.3, 1.7, 50)
        v = dart_minhash.sketch(np.concatenate([e, e]), np.repeat([0, 1], 50), np.concatenate([a, b]), 2, 144)
        seen.append((v[0] == v[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(seen) - np.mean(true)) < 0.02


# Sharding


def brute_shards(rows, shards, max_group):
    """(doc_id, size, crc32, shard, slot), from the order, the groups and the targets themselves."""
    raw = [((t or "").encode(), i) for i, t in rows]
    order = sorted((np.int64(np.uint64(xxhash.xxh64_intdigest(b, 42))).item(), i is not None, i or 0, len(b) + 16, zlib.crc32(b), i) for b, i in raw)
    total = sum(r[3] for r in order)
    target, at, spans, starts = max(1.0, total / shards), 0, {}, []
    for h, _, _, size, _, _ in order:
        low, _ = spans.get(h, (at, at))
        spans[h] = (low, at + size)
        starts.append(at)
        at += size
    out, used = [], {}
    for (h, _, _, size, crc, i), start in zip(order, starts):
        low, high = spans[h] if spans[h][1] - spans[h][0] <= max_group * target else (start, start + size)
        shard = min(shards - 1, int((low + high) / 2 // target))
        out.append((i, size, crc, shard, used.setdefault(shard, 0)))
        used[shard] += 1
    return sorted(out, key=repr)


SHARDED = [(k, f"{k} " + "é" * (k * 7919 % 900)) for k in range(3000)] + [(k, "copy " * 5) for k in range(3000, 3040)] + [(k, f"pair {k % 50}" * 40) for k in range(4000, 4100)] + [(None, None), (7, ""), (7, ""), (8, LONG)]


@pytest.mark.parametrize("max_group", [0.0, 0.01, sharding.MAX_GROUP, 2.0])
def test_shards_equal_brute_force(spark, max_group):
    for rows, shards in ((SHARDED, 12), (SHARDED[:200], 40), ([(k, "same text") for k in range(1000)] + [(k, str(k)) for k in range(2000, 3000)], 10)):
        got = sharding.shard_by_bytes(documents(spark, rows), shards, max_group=max_group).collect()
        assert sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got], key=repr) == brute_shards(rows, shards, max_group)
        # Each end of a shard is off its target by half of what lies across it, a document or a group, at most.
        total = sum(r["size"] for r in got)
        most = max(max(r["size"] for r in got), max_group * total / shards)
        sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
        assert all(abs(x - total / shards) <= most for x in sizes)
    assert sharding.shard_by_bytes(documents(spark, SHARDED).where("false"), 12).collect() == []


# Quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf), read(spark, sf, "labels")
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)
    good, bad = [[r["score"] for r in scored if r["quality"] == q] for q in (1, 0)]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([(r["score"] >= 0.7) == r["quality"] for r in scored]) > 0.93
    # Held-out labels teach nothing.
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in scored)


def test_weights_and_curve_equal_a_direct_solve(spark):
    """Features, normal equations and the folds' calibration worked out at once from all rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, len(quality.STATS)))
    y = (x[:, 0] + 0.5 * x[:, 3] ** 2 + rng.normal(0, 0.5, 600) > 0.4).astype(int)
    labelled = spark.createDataFrame([([float(v) for v in s], int(k)) for s, k in zip(x, y)], "stats array<double>, y int").repartition(5)
    model = quality.fit(labelled, features=32)
    rows = labelled.select("stats", "y", F.pmod(F.xxhash64("stats"), F.lit(2)).alias("fold")).collect()
    x, y, fold = (np.array([r[c] for r in rows]) for c in ("stats", "y", "fold"))
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = model.features(x)

    def direct(some):
        penalty = quality.RIDGE * len(some) / 32 * np.eye(33)
        return np.linalg.lstsq(np.vstack([z[some], np.linalg.cholesky(penalty).T]), np.concatenate([y[some], np.zeros(33)]), rcond=None)[0]

    assert np.allclose(model.weights, direct(np.arange(600)), atol=1e-8)
    out = np.where(fold == 0, z @ direct(np.flatnonzero(fold == 1)), z @ direct(np.flatnonzero(fold == 0)))
    at = np.clip((out + 1) / 3 * quality.CALIBRATION_BINS, 0, quality.CALIBRATION_BINS - 1).astype(int)
    bins = sorted(set(at))
    means, sizes = [y[at == b].mean() for b in bins], [(at == b).sum() for b in bins]
    # The closest rising sequence is the largest of the smallest means over all stretches.
    mean = lambda i, j: np.average(means[i : j + 1], weights=sizes[i : j + 1])
    curve = [max(min(mean(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(0, len(bins), 40)]
    assert np.allclose(model.curve[0], [out[at == b].mean() for b in bins], atol=1e-8) and np.allclose(model.curve[1][::40], curve)


def test_quality_cases(spark):
    docs = documents(spark, [(None, None), (1, ""), (1, ""), (2, LONG), (3, " \n")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1), (3, 5, 0)], "doc_id long, quality int, toxic int")
    for marked in (labels, labels.where("false")):
        got = quality.score_quality(docs, marked).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    assert quality.score_quality(docs.where("false"), labels).collect() == []


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 9)), min_size=1, max_size=30))
def test_isotonic_rises_and_keeps_the_mean(rows):
    y, n = map(np.array, zip(*rows))
    curve = quality.isotonic(y, n)
    assert (np.diff(curve) >= -1e-12).all() and np.isclose((curve * n).sum(), (y * n).sum())


# BPE

ALPHABET = "ab 'st\n\t    é1²½!#\x0b\x85\r漢字🙂\x1c\x1d\x1e\x1f́\xa0　"


BYTES = bpe.tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([i]): i for i in range(256)} | {bytes([i, j]): 256 + 256 * i + j for i in range(256) for j in range(256)}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(ALPHABET + "\U00013460\ua7ce\U000116d0"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_pre_tokens_are_the_library_s(texts):
    """BYTES joins any two bytes within a piece, so its ids show where pieces end."""
    words, counts = bpe.pre_tokens(pa.array(texts, pa.string()))
    words = words.to_pylist()
    assert "".join(words) == "".join(texts) and counts.sum() == len(words)
    for t, n in zip(texts, counts):
        mine, words = words[:n], words[n:]
        assert [i for w in mine for i in BYTES._encode_single_piece(w)] == BYTES.encode_ordinary(t)


def test_pre_tokens_where_every_mark_is_taken():
    text = "a  b" + "".join(bpe.MARKS) + " c"
    assert bpe.pre_tokens(pa.array([text]))[0].to_pylist() == regex.findall(public_tokenizers.PATTERN, text)


@pytest.mark.parametrize("chunk", [bpe.CHUNK_TOKENS, 50])
def test_bpe_equals_the_library_and_round_trips(spark, sf, chunk, monkeypatch):
    with open(RANKS, "rb") as f:
        enc = bpe.encoding(f.read())
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf).select("doc_id", "text").limit(60).collect()]
    rows += [(None, None), (1, ""), (1, ""), (2, LONG), (3, "<|endoftext|> \n\n  x 🙂"), (4, "x" * 5000)]
    monkeypatch.setattr(bpe, "CHUNK_TOKENS", chunk)
    got = bpe.digests(documents(spark, rows), RANKS).collect()
    want = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)
    assert bpe.digests(documents(spark, rows).where("false"), RANKS).collect() == []
    assert [r["n_tokens"] for r in bpe.digests(documents(spark, [(1, None), (2, "")]), RANKS).collect()] == [0, 0]
    apart = bpe.decode(bpe.encode(documents(spark, rows), RANKS), RANKS).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in apart) == sorted(t or "" for _, t in rows)


# Language ID


def brute_chain(scores, transition):
    n, k = scores.shape
    gamma, pairs, z = np.zeros((n, k)), np.zeros((k, k)), 0
    for p in itertools.product(range(k), repeat=n):
        w = np.exp(sum(scores[i, p[i]] for i in range(n)) + sum(transition[p[i], p[i + 1]] for i in range(n - 1)))
        z += w
        for i in range(n):
            gamma[i, p[i]] += w
        for i in range(n - 1):
            pairs[p[i], p[i + 1]] += w
    return gamma / z, pairs / z


def test_forward_backward_equals_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    for chunk in (2, 3, 256):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        scores, transition = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
        starts = np.isin(np.arange(8), [0, 4])
        gamma, pairs = language_id.marginals(scores, starts, transition, pairs=True)
        parts = [brute_chain(scores[:4], transition), brute_chain(scores[4:], transition)]
        assert np.allclose(gamma, np.concatenate([p[0] for p in parts])) and np.allclose(pairs, parts[0][1] + parts[1][1])


def test_language_of_held_out_rows_and_cases(spark):
    docs = read(spark, "/root/testdata/sf0.01")
    model = language_id.train(docs)
    found = language_id.identify(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    by = {r["lang"]: r["text"] for r in docs.where("n_chars > 400").collect()}
    rows = [(None, None), (1, ""), (2, "12 !!"), (3, by["de"]), (3, by["de"]), (4, by["fr"] * 60), (5, by["en"] + " " + by["es"])]
    odd = documents(spark, rows).withColumn("score", F.lit("mine"))
    got = language_id.identify(odd, model, spans=True).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "de", "de", "fr", got[-1]["lang_pred"]]
    assert got[0]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got)
    assert {s["lang"] for s in got[-1]["spans"]} >= {"en", "es"} and got[-1]["spans"][0]["first"] == 0
    kept = language_id.keep_identified(odd, model, 0.5)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [3, 3, 4, 5]
    assert language_id.identify(odd.where("false"), model).collect() == []
    assert language_id.train(odd.where("false")) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def junk(rng):
    """Texts in none of the learned languages, by kind."""
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 11)))
    pool = [word("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)]
    return {
        "letters": [" ".join(rng.choices(pool, k=60)) for _ in range(20)],
        "consonants": [" ".join(word("bcdfghjklmnpqrstvwxz") for _ in range(60)) for _ in range(20)],
        "base64": [base64.b64encode(rng.randbytes(600)).decode() for _ in range(20)],
        "others": ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."],
        "none": ["12 34 !!", "", None],
    }


def test_texts_in_no_learned_language_go_and_all_others_stay(spark):
    docs = read(spark, "/root/testdata/sf0.01")
    model = language_id.train(docs)
    assert language_id.keep_identified(docs, model, 0.5).count() == docs.count()
    texts = [t for ts in junk(random.Random(1)).values() for t in ts]
    assert language_id.keep_identified(documents(spark, list(enumerate(texts))), model, 0.5).collect() == []


def test_words_of_code_switched_text(spark):
    """Runs of 12 words from held-out texts of two languages: the words' labels, not the text's."""
    docs = read(spark, "/root/testdata/sf0.01")
    model = language_id.train(docs)
    rng = random.Random(3)
    words = {lang: [] for lang in model.languages}
    for r in docs.where(held_out(F.col("doc_id")) & (F.col("n_chars") > 300)).collect():
        words[r["lang"]] += language_id.words_of(pa.array([r["text"]]))[0].to_pylist()
    texts, gold = [], []
    for _ in range(60):
        a, b = rng.sample(model.languages, 2)
        runs = [(lang, rng.choices(words[lang], k=12)) for lang in (a, b, a)]
        texts.append(" ".join(w for _, ws in runs for w in ws))
        gold.append([lang for lang, ws in runs for _ in ws])
    spans = language_id.label_texts(model, pa.array(texts), spans=True).column("spans").to_pylist()
    got = [[s["lang"] for s in ss for _ in range(s["first"], s["last"] + 1)] for ss in spans]
    assert np.mean([x == y for g, w in zip(got, gold, strict=True) for x, y in zip(g, w, strict=True)]) > 0.9


def test_training_texts_are_bounded(spark):
    docs = documents(spark, [(k, f"{w} " * 50) for k in range(200) for w in ("alpha",)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    assert language_id.train(docs, docs_a_language=3).languages == ["a", "b"]
    assert language_id.train(docs, train_bytes=700).languages == ["a", "b"]
    assert language_id.train(docs, train_bytes=10) is None


# Top-k


def brute_top(queries, candidates, k):
    out = []
    for q in sorted({q for q, _ in queries}):
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, c)))), i) for v in {tuple(v) for p, v in queries if p == q} for i, c in candidates if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,k,lists,scale", [(0, 5, 2, 1), (1, 5, 2, 1), (4, 5, 2, 1), (700, 5, 2, 1), (700, 3, 4, 1e5), (700, 5, 2, 1e14), (300, 400, 2, 1), (300, 5, 2, 1e300)])
def test_top_k_equals_all_scores(spark, n, k, lists, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "PROBE_ROWS", 16)
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) * scale for x in rng.normal(size=8)]) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + 40)] if n > 4 else []  # ties
    rows += [(10_000, None), (10_001, [None] * 8), (10_002, [float("nan")] + [0.0] * 7), (None, [1.0] * 8), (10_050, [float("inf")] * 8), (10_100, [1.0] * 7), (10_150, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    vectors = topk.integer_vectors(table, "vec_id", "embedding", 8)
    flat = [(r["id"], r["vector"]) for r in vectors.collect()]
    assert len(flat) == n + 40 * (n > 4) and all(v == [max(-(2**63), min(2**63 - 1, math.floor(x * 256))) for x in dict(rows)[i]] for i, v in flat)
    queries = vectors.where("id % 50 = 0")
    got = topk.top_k(queries, vectors, 8, k, lists).collect()
    assert sorted(tuple(r) for r in got) == brute_top([(i, v) for i, v in flat if i % 50 == 0], flat, k)


def test_top_k_skips_products(spark, monkeypatch):
    """Clustered vectors: the result is whole, and a small part of the products of all pairs is worked out."""
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "PROBE_ROWS", 64)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in middle[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(4000)]
    rows += [(i, rows[7][1]) for i in range(4000, 4100)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 16)
    flat = [(r["id"], r["vector"]) for r in vectors.collect()]
    report = {}
    got = topk.top_k(vectors.where("id % 50 = 0"), vectors, 16, 5, report=report).collect()
    assert sorted(tuple(r) for r in got) == brute_top([(i, v) for i, v in flat if i % 50 == 0], flat, 5)
    assert report["share"] < 0.25


def test_what_top_k_sends_to_the_driver_does_not_grow_with_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 1024)
    monkeypatch.setattr(topk, "PROBE_ROWS", 16)
    vectors = spark.range(0, 50_000, 1, 50).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(256)) for i in range(16)]).alias("vector"))
    sc = spark.sparkContext
    sc.setJobGroup("top-k-driver", "")
    try:
        rows = topk.top_k(vectors.where("id < 3"), vectors, 16, 5).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 15
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = [i for job in tracker.getJobIdsForGroup("top-k-driver") for i in tracker.getJobInfo(job).stageIds]
    # 50 tasks that sent SAMPLE rows each would send over 7 MB.
    assert 0 < max(store.lastStageAttempt(i).resultSize() for i in stages if tracker.getStageInfo(i) and tracker.getStageInfo(i).numCompletedTasks) < 1_000_000


# Line dedup


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if not w:
                continue
            if any(w == x or (min(len(w), len(x)) >= line_dedup.MIN_WORDS and distance(w, x) <= 1) for x in seen):
                gone.append(n)
            if w not in seen:
                seen.append(w)
        out[(i, t)] = gone
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_equals_all_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    vocab = "a b c d e".split()
    lines = []
    for _ in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 18, 30]))]
        lines.append(w)
        for _ in range(2):
            x = list(w)
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(len(x) + 1)
                x[p : p + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            lines.append(x or w)
    rng.shuffle(lines)
    rows = [(k, "\n".join(" ".join(x).title() if rng.random() < 0.2 else "  ".join(x) for x in lines[k * 6 : k * 6 + 6]) + "\n\n") for k in range(30)]
    rows += [(100, None), (101, ""), (None, rows[0][1]), (3, rows[3][1]), (102, LONG)]
    docs = documents(spark, rows)
    got = line_dedup.drop_lines(docs)
    assert got.columns == docs.columns
    want = brute_lines(rows)
    keep = lambda i, t: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[(i, t)])
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr) == sorted([(i, keep(i, t)) for i, t in rows], key=repr)
    assert line_dedup.dropped_lines(docs.where("false")).collect() == []
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for slice_words in (line_dedup.SLICE_WORDS, 40):
        monkeypatch.setattr(line_dedup, "SLICE_WORDS", slice_words)
        told = line_dedup.op10_deletion_line_dedup(spark, str(tmp_path)).collect()
        assert sorted([tuple(r) for r in told], key=repr) == sorted([(i, (t or "").count("\n") + 1, len(want[(i, t)]), want[(i, t)]) for i, t in rows], key=repr)


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_within_one_is_the_edit_distance(a, b):
    assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


# Pipeline


def brute_pipeline(docs, model):
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) in the order of the mix, from rows (doc_id, text, source) without repeated ids."""
    with open(RANKS, "rb") as f:
        enc = bpe.encoding(f.read())
    found = language_id.label_texts(model, pa.array([t or "" for _, t, _ in docs]))
    docs = [d for d, lang, f in zip(docs, found.column("lang_pred").to_pylist(), found.column("familiar").to_pylist()) if lang != "und" and f >= 0.5]
    first = {}
    for d in sorted(docs):
        first.setdefault(regex.sub("[\\x20\\x09-\\x0D]+", " ", d[1]), d)
    docs = list(first.values())
    classes = {i: (c, n) for i, c, n in brute_classes([(i, t) for i, t, _ in docs])}
    docs = [d for d in docs if classes[d[0]][0] == d[0]]
    names = sorted({s for _, _, s in docs})
    weights = [mixing.TARGETS.get(s, mixing.DEFAULT_WEIGHT) for s in names]
    common = math.gcd(*weights)
    weights = [w // common for w in weights]
    at = {(i, j): slot for slot, i, j in mixing.pfair_period(weights)}
    order = []
    for i, s in enumerate(names):
        start = 0
        mine = [(hashlib.md5(f"{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), d, t) for d, t, src in docs if src == s]
        for _, d, t in sorted(mine):
            block = start // mixing.BLOCK_BYTES
            order.append((block // weights[i] * sum(weights) + at[i, block % weights[i]], start, d, t))
            start += len(t.encode())
    out = []
    for _, _, d, t in sorted(order):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        out.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_pipeline_equals_brute_force(spark, sf, tmp_path, monkeypatch):
    """With planted junk, copies and near copies, over several files and chunks; run() goes through the stages."""
    import corpus_pipeline as c

    monkeypatch.setattr(bpe, "CHUNK_TOKENS", 5_000)
    docs = read(spark, sf)
    rng = random.Random(5)
    texts = [r["text"] for r in docs.where("n_chars > 200").orderBy("doc_id").limit(30).collect()]
    planted = [t for ts in junk(rng).values() for t in ts]
    n_junk = len(planted)
    planted += [t.replace(" ", "  ") for t in texts[:10]] + [t + " and" for t in texts[10:30]]
    more = spark.createDataFrame([(10_000 + k, t, None, f"src{k % 25}", len(t or "")) for k, t in enumerate(planted)], docs.schema)
    docs.union(more).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    docs = read(spark, str(tmp_path))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    want = brute_pipeline(rows, language_id.train(docs))
    assert not {i for i, *_ in want} & {10_000 + k for k in range(n_junk)}
    made = c.run(spark, str(tmp_path))
    got = made.collect()
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position"]
    assert [tuple(r) for r in got] == [(*w, k) for k, w in enumerate(want)]
    # A run that is started again with a folder goes on after the stages that ended.
    assert c.run(spark, str(tmp_path), f"{tmp_path}/stages").collect() == got
    with monkeypatch.context() as m:
        m.setattr(c, "STAGES", [*[(name, None) for name, _ in c.STAGES[:-1]], c.STAGES[-1]])
        assert c.run(spark, str(tmp_path), f"{tmp_path}/stages").collect() == got
    made.write.parquet(f"{tmp_path}/out")
    assert pq.ParquetDataset(sorted((tmp_path / "out").glob("part-*"))).read(["position"])["position"].to_pylist() == list(range(len(want)))


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, extra columns: every stage returns the columns it was given."""
    import corpus_pipeline as c

    base = read(spark, "/root/testdata/sf0.01").limit(150)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src1", 0), (7, None, "en", None, 3), (7, None, "en", None, 3), (8, LONG, None, "src0", None), (9, LONG, None, "src0", None)], base.schema)
    extra = lambda d: d.withColumns({k: F.lit("x") for k in ("position", "place", "score", "slot", "kept", "run", "file", "node")})
    for docs in (base.union(base).union(odd), odd, base.where("false"), extra(base.union(odd))):
        docs = c.materialise(docs, "odd")
        columns = docs.columns
        for name, stage in c.STAGES:
            before = docs.count()
            docs = c.materialise(stage(spark, docs, ""), name)
            assert docs.columns == (columns if name != "byte_bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position"])
            assert docs.count() <= before
        assert sorted(r["position"] for r in docs.collect()) == list(range(docs.count()))


def test_pipeline_rows_follow_the_targets(spark, tmp_path):
    """A source with a third of the rows makes a tenth of the output for as long as all sources last."""
    import corpus_pipeline as c

    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    sources = [f"src{k}" for k in range(1, 20) for _ in range(26)]
    sources += ["src0"] * (len(sources) // 2)
    rng.shuffle(sources)
    docs = documents(spark, [(k, " ".join(rng.choices(vocab, k=2700))) for k in range(len(sources))], sources)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    size = {r["doc_id"]: len(r["text"]) for r in docs.collect()}
    made = c.run(spark, str(tmp_path))
    made.write.parquet(f"{tmp_path}/out")
    for rows in (made.collect(), pq.ParquetDataset(sorted((tmp_path / "out").glob("part-*"))).read(["doc_id"]).to_pylist()):
        got = [r["doc_id"] for r in rows]
        assert sorted(got) == list(range(len(sources)))
        slots = {r["doc_id"]: r for r in mixing.schedule(docs, mixing.TARGETS).collect()}
        assert got == sorted(got, key=lambda i: (slots[i]["slot"], slots[i]["slot_rank"]))
        last = max(n for n, i in enumerate(got) if slots[i]["balanced"])
        assert last > 300
        whole, done = sum(mixing.TARGETS.values()), dict.fromkeys(mixing.TARGETS, 0)
        for i in got[: last + 1]:
            done[sources[i]] += size[i]
            # A block more or less, and the documents that reach over a block's end or wait in the slot at hand.
            assert all(abs(d - mixing.TARGETS[s] * sum(done.values()) / whole) < 2 * mixing.BLOCK_BYTES for s, d in done.items())
        assert abs(done["src0"] / sum(done.values()) - mixing.TARGETS["src0"] / whole) < 0.02
