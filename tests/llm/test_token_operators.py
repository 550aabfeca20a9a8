"""Token counts, packing, mixing, nearest neighbours and the pipeline."""

import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, mixing, packing, tokens
from sparkloom.llm.common import drawn, rules, tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "b ", " ", "\n", "  ", "\x1c", " ", "é", "É", "ß", "Σ", "日", "1", "!", "'s", "<|endoftext|>", "\t", ".", "word", "Word", ",", "é", "İ", "###", "&&"]


def _odd(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(1, 60)))


def test_counts_and_splices_equal_the_library():
    rng, tok = random.Random(1), tokenizer(BYTES)
    for _ in range(1500):
        x = _odd(rng)
        n = len(tok.encode(x, add_special_tokens=False))
        assert tokens.count_units(BYTES, x) == n
        assert tokens.splice(BYTES, x, 16, 4) == n
    for x in ("a" * 500, " " * 500, "ab " * 300, "\n" * 77 + "x"):  # no stable boundary for long: overlaps widen
        assert tokens.splice(BYTES, x, 32, 4) == len(tok.encode(x, add_special_tokens=False))


def test_splices_are_linear_without_white_space():
    tok = tokenizer(BYTES)
    for x in ("aZ3+/" * 40_000, " " * 100_000, "ab\x1c!" * 20_000, "日本語の文" * 8_000 + " " + "x" * 90_000):
        began = time.time()
        n = len(tok.encode(x, add_special_tokens=False))
        plain, began = time.time() - began, time.time()
        assert tokens.count_tokens(BYTES, x, 50_000, 16_384, 256) == n
        assert time.time() - began < 6 * plain + 0.5


def test_other_vocabularies_take_the_plain_way():
    for x in ("Hello World, the Quick brown fox.", "straße Élan naïve", "a" * 300 + " b " * 200):
        assert tokens.count_tokens(WORDS, x, 100, 32, 4) == len(tokenizer(WORDS).encode(x, add_special_tokens=False))
        assert np.frombuffer(packing.encode(BYTES, x), "<u4").tolist() == tokenizer(BYTES).encode(x, add_special_tokens=False).ids
    assert (rules(BYTES), rules(WORDS)) == ("bytes", "words")


def test_token_counts(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "déjà vu", 7), (3, "déjà vu", 7), (None, "x " * 40_000, 7)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_bytes int"), BYTES, huge_chars=1000).collect()
    tok = tokenizer(BYTES)
    for r in got:
        assert r["n_tokens"] == (len(tok.encode(r["text"], add_special_tokens=False)) if r["text"] else 0)
        assert r["n_bytes"] == len((r["text"] or "").encode())
    assert len(got) == 5
    assert tokens.token_counts(spark.createDataFrame([], "text string"), BYTES).collect() == []


def test_ids_equal_the_library():
    rng, tok = random.Random(2), tokenizer(WORDS)
    for _ in range(1500):
        x = _odd(rng)
        assert np.frombuffer(packing.encode(WORDS, x), "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 40, 4000])
def test_fill_holds_every_piece_and_comes_near_the_bound(n):
    rng = np.random.default_rng(n)
    sizes = np.minimum(2048, np.maximum(1, rng.lognormal(5.5, 1.2, n).astype(int)))
    hist = np.bincount(sizes, minlength=2049)
    plan = packing.fill(hist, 2048)
    back = np.zeros(2049, dtype=int)
    for what, k in plan:
        assert sum(what) <= 2048
        for v in what:
            back[v] += k
    assert (back == hist).all()
    assert sum(k for _, k in plan) <= np.ceil(sizes.sum() / 2048) * 1.02 + 1


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1", "y,"]) for _ in range(rng.choice([0, 3, 400, 3000])))) for i in range(60)] + [(7, None), (None, "a b"), (3, "q"), (3, "q")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    tok = tokenizer(WORDS)
    want = []
    for i, t in rows:
        ids = np.array([*(tok.encode(t, add_special_tokens=False).ids if t else []), 0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in out)
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


def test_pack_takes_texts_in_small_batches(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("alpha "), F.when(F.col("id") == 5, 500_000).otherwise(400)).alias("text"))
    whole, log = packing.pieces, str(tmp_path / "batches")

    def noted(docs, *rest):
        def note(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write(f"{b.num_rows} {b.nbytes}\n")
                yield b

        return whole(docs.mapInArrow(note, docs.schema), *rest)

    monkeypatch.setattr(packing, "pieces", noted)
    confs = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in confs]
    out = packing.pack(docs, WORDS)
    assert [spark.conf.get(k) for k in confs] == before
    batches = [tuple(map(int, x.split())) for x in open(log)]
    assert sum(n for n, _ in batches) == 3000
    assert max(size for _, size in batches) < 5e6  # the long text has 3 MB; all have 10 MB
    assert sum(size < 1.5e6 for _, size in batches) >= len(batches) - 1
    n = len(tokenizer(WORDS).encode("alpha " * 400, add_special_tokens=False).ids) // 400
    assert out.agg(F.sum("length")).first()[0] == n * (2999 * 400 + 500_000) + 3000


def test_quotas_stop_at_the_cap():
    assert mixing.quotas([100, 100, 100], [1, 2, 3], 300, 3) == [50, 100, 150]
    got = mixing.quotas([10, 1000, 1000], [3, 1, 1], 2010, 3)
    assert got[0] == 30 and got[1] == got[2] == 990
    assert mixing.quotas([], [], 0, 3) == []


def test_flow_prefers_fresh_words_of_shared_patterns():
    patterns = [(frozenset({0}), 100), (frozenset({0, 1}), 100), (frozenset({1}), 10)]
    flow = mixing.min_cost_flow(patterns, [100, 110], 3)
    assert flow == [{0: 100}, {1: 100}, {1: 10}]
    flow = mixing.min_cost_flow(patterns, [250, 60], 3)
    assert sum(f.get(0, 0) for f in flow) == 250 and sum(f.get(1, 0) for f in flow) == 60


def test_flow_is_the_least_cost_of_all():
    rng, repeats = random.Random(7), 2
    cost = lambda size, f: sum(k * min(size, max(0, f - k * size)) for k in range(repeats))
    for _ in range(150):
        patterns = [(frozenset(rng.sample(range(2), rng.randint(1, 2))), rng.randint(1, 2)) for _ in range(rng.randint(1, 3))]
        quota = [rng.randint(0, 5), rng.randint(0, 5)]
        arcs = [(p, s) for p, (of, _) in enumerate(patterns) for s in sorted(of)]
        best = None
        for take in itertools.product(*[range(repeats * patterns[p][1] + 1) for p, _ in arcs]):
            by_p, by_s = [0] * len(patterns), [0, 0]
            for (p, s), f in zip(arcs, take):
                by_p[p] += f
                by_s[s] += f
            if all(f <= repeats * n for f, (_, n) in zip(by_p, patterns)) and all(f <= q for f, q in zip(by_s, quota)):
                value = (-sum(by_p), sum(cost(n, f) for f, (_, n) in zip(by_p, patterns)))
                best = value if best is None else min(best, value)
        flow = mixing.min_cost_flow(patterns, quota, repeats)
        by_p = [sum(f.values()) for f in flow]
        assert all(sum(f.get(s, 0) for f in flow) <= quota[s] for s in (0, 1)) and all(set(f) <= of for f, (of, _) in zip(flow, patterns))
        assert (-sum(by_p), sum(cost(n, f) for f, (_, n) in zip(by_p, patterns))) == best


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", "c", "c", None]), rng.randint(0, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").withColumn("text", F.lit("t"))
    run = lambda d: {r["doc_id"]: r for r in mixing.mix(d, F.array("source"), F.col("n")).collect()}
    got, again = run(df), run(df.repartition(5))
    assert {k: v["taken"] for k, v in got.items()} == {k: v["taken"] for k, v in again.items()}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.quotas([sizes[s] for s in names], [1, 2, 3, 1], sum(sizes.values()), 3)))
    taken = {}
    for r in got.values():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in names)
    assert mixing.mix(df.limit(0), F.array("source"), F.col("n")).collect() == []


def test_mix_overlapping_sources(spark):
    rows = [(i, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None], 10) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, of array<string>, n int").withColumn("text", F.lit("t"))
    out = mixing.mix(df, F.col("of"), F.col("n"), weights=(1, 1, 4)).collect()
    assert len(out) == 900 and all(r["taken"] <= 30 for r in out)
    assert abs(sum(r["taken"] for r in out) - 9000) <= 60


def test_drawn_is_the_first_by_hash(spark):
    df = spark.range(60_000).withColumnRenamed("id", "k")
    want = [r["k"] for r in df.orderBy(F.xxhash64("k"), "k").limit(500).collect()]
    assert [r["k"] for r in drawn(df, "k", 500).collect()] == want
    assert drawn(df.limit(3), "k", 500).count() == 3


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0]), (5005, [float("inf")] * 16), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), rows_per_block=700, queries_per_block=40).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        hits += len(set(best.tolist()) & {v for v, _ in got[q].values()})
        for v, score in got[q].values():
            assert score == pytest.approx(s[v], abs=1e-12)
    assert set(got) == set(range(0, 3000, 50)) and hits >= 0.9 * 5 * 60
    assert [got[100][k][0] for k in (1, 2, 3, 4, 5)] == [101, 102, 103, 104, 105]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []
    few = df.filter("vec_id in (1, 2, 50)")
    assert ann.nearest(few, few.filter("vec_id = 50")).count() == 2


def test_probing_admits_all_within_the_radius_and_recall_holds():
    rng = np.random.default_rng(8)
    for n, spread in ((2_000, 0.4), (8_000, 0.4), (4_000, 5.0)):
        centres = rng.standard_normal((40, 64))
        x = centres[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, 64))
        codes = ann.learn(x[:2_000])
        code = codes.encode(x)
        want = code[::50]
        admitted = np.concatenate([found for _, found in ann.probe(code, want, codes.radius)])
        apart = np.bitwise_count(code[None, :, :] ^ want[:, None, :]).sum(2)
        assert (admitted | (apart > codes.radius)).all()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u[::50] @ u.T
        s[np.arange(len(want)), np.arange(0, n, 50)] = -2
        top = np.argpartition(-s, 5, axis=1)[:, :5]
        recall = np.take_along_axis(apart <= codes.radius, top, 1).mean()
        print(f"{n} rows, spread {spread}: radius {codes.radius}, admitted {admitted.mean():.3f}, recall {recall:.3f}")
        assert recall >= 0.9
        assert spread > 1 or admitted.mean() < 0.5


def test_pipeline_stages(spark):
    import corpus_pipeline

    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(n))
    base = [text(60) for _ in range(20)]
    rows = [(i, b, "en", f"s{i % 3}", len(b)) for i, b in enumerate(base)]
    rows += [(100 + i, base[i] + " tail", "en", "s1", 1) for i in range(5)] + [(200, "too short", "en", "s1", 9), (201, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            assert {r["doc_id"] for r in docs.collect()} == {*range(20), *range(100, 105)}
        if name == "ngram_jaccard_join":
            assert sorted(r["doc_id"] for r in docs.collect()) == list(range(20))
    words = sum(len(r["text"].split()) for r in docs.collect())
    assert abs(words - 20 * 60) <= 3 * 60
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == docs.count() and {r["doc_id"] for r in out} <= set(range(20))


def test_pipeline_run(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3000)) for _ in range(n))
    whole = [text(rng.choice([12, 200, 3000])) for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t)) for i, t in enumerate(whole)]
    rows += [(i, t, "en", "s1", len(t)) for i, t in enumerate(whole[:3])]  # repeated whole, but for the source
    rows += [(None, text(80), "en", None, 1), (3, text(90), "en", "s2", 1), (90, None, "en", "s1", None), (91, "", "en", "s1", 0)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(out) == key(again) and {r["doc_id"] for r in out} <= {*range(25), None}
    held = {}
    for r in out:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    assert held and max(held.values()) <= 2048
    spark.createDataFrame([], shape).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3000)) for _ in range(n))
    long, other, null, twice = text(200), text(50), text(50), text(50)
    edited = long.split()
    for k in (20, 60, 100, 140):
        edited[k] = f"edit{k}"  # 176 of 216 windows of five words in common, 181 of 213 of four
    rows = [(1, long), (2, " ".join(edited)), (3, other), (3, other), (3, text(50)), (None, null), (None, null), (None, null + " end"), (None, text(50))]
    rows += [(7, twice), (7, twice), (8, twice), (9, ""), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["1", "3", "3", "None", "None", "7", "9", "10"])
    assert len({r["text"] for r in got}) == 8
