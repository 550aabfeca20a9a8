"""Filter audit, block-max search and BPE round trips."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import audit, bpe, lexical
from sparkloom.llm.common import tokenizer
from sparkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_block_max_search"])
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(want.select(*columns).fetchall())


# --- audit


def _naive_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[at] == 1 and i is not None} for at in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > first[text]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[order, step] = (f, left, gone)
        for (order, step), (f, left, gone) in removed.items():
            failing = [r for r in own if f in r[1]]
            out.add((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), sum(len(g) for x, _, g in removed.values() if x == f)))
    return out


AUDIT_COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", "a b", "A B C #", long, long + " x", " ".join(str(rng.random()) for _ in range(120)), "same " * 200, "ÀÉ ТЕКСТ"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "en", "de"])) for _ in range(160)]
    docs += [(100 + i, "copy of a text held by very many", "en") for i in range(300)]  # cut by the boundaries of ranges
    docs += docs[:5]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 400, 2)] + [(2, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as `_mask`", "'x' as `LEAST`", "2 as part", "text as fails")
    got = audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.select(AUDIT_COLUMNS).collect()} == _naive_audit(docs, labels)


def test_runs_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        docs = [(i, "one" if i % 3 else f"t{i % 50}", "en") for i in range(4000, 0, -1)]
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
        found = audit.with_first(df, "doc_id", "text", {})
        first = {}
        for i, t, _ in docs:
            first[t] = min(first.get(t, i), i)
        assert {tuple(r) for r in found.collect()} == {(i, first[t]) for i, t, _ in docs}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


# --- search


def _naive_search(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(lexical.TERM, (t or "").translate(lower))
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    N, L = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 10 + 90 * c.total() * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("per_block", "first", "n"), [(1, 1, 60), (4, 2, 300), (64, 8, 300), (7, 1, 300)])
def test_search_equals_scoring_everything(spark, per_block, first, n):
    rng = random.Random(per_block)
    word = lambda: rng.choice(["The", "the", "a", "été", "日本", "x9", "w%d" % int(rng.paretovariate(0.6)), "Zeta-b"])
    docs = [(rng.choice([None, *range(200)]), rng.choice([None, "", "...", " ".join(word() for _ in range(rng.randint(1, 60)))])) for _ in range(n)]
    docs += [(1000 + i, "the same text w1 w2 w3") for i in range(40)] + [(5, " ".join(word() for _ in range(20_000)))]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(12)] + [(90, "same text"), (91, None), (92, "--"), (93, "nowhere"), (None, "w2 w3")]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as n").repartition(3), per_block=per_block, like_together=per_block != 4)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as rank", "4 as q"), k=10, first=first)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == _naive_search(docs, items, 10)


def test_blocks_below_the_threshold_are_not_scored(monkeypatch):
    """Documents of few topics, a topic a range: a query's blocks are a few of all."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice([f"t{i // 100}x{rng.randint(0, 40)}", f"c{rng.randint(0, 30)}"]) for _ in range(50))) for i in range(3000)]
    held = [(i, Counter(lexical.terms_of(t.encode()))) for i, t in docs]
    n_terms = sum(c.total() for _, c in held)
    rows = [lexical._row(held[at : at + 20], at, len(held), n_terms) for at in range(0, len(held), 20)]
    batch = __import__("pyarrow").Table.from_batches(rows).combine_chunks().to_batches()[0]
    texts = [" ".join(f"t{q}x{j}" for j in range(10)) + " c1 c2 c3" for q in range(0, 30, 3)]
    hashed = [np.array(sorted({lexical._hashes[t] for t in lexical.terms_of(x.encode())})) for x in texts]
    terms = np.unique(np.concatenate(hashed))
    qs = lexical._Queries(terms, [np.searchsorted(terms, h) for h in hashed])
    df = next(lexical._summed(qs)([batch])).to_pydict()
    qs.weights = np.zeros(len(terms), dtype=np.int64)
    qs.weights[df["t"]] = [lexical.weight(x, len(held)) for x in df["df"]]
    scored = []
    plain = lexical._score
    monkeypatch.setattr(lexical, "_score", lambda row, qs, p, m, which, *a: (scored.append(len(which)), plain(row, qs, p, m, which, *a)))
    list(lexical._scored(qs, 10, np.ones(len(texts), dtype=np.int64), len(held), n_terms, False)([batch]))
    assert sum(scored) < 0.25 * len(rows) * len(texts)


def test_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_QUERIES", 3)
    docs = [(i, f"w{i % 7} w{i % 3} w{i}") for i in range(50)]
    items = [(i, f"w{i} w{i + 1}") for i in range(11)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"), per_block=4)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted(map(tuple, got.collect()), key=str) == _naive_search(docs, items, 3)


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).collect() == []
    assert lexical.search(lexical.build_index(some), items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(lexical.build_index(some), items).collect()] == _naive_search([(1, "a b")], [(1, "a")], 10)


# --- BPE

BITS = ["a", "b ", " ", "\n", "  ", "\x1c", "\xa0", "é", "É", "ß", "Σ", "日", "1", "!", "'s", "'", "'re", "'ll", "<|endoftext|>", "<|", "|>", "\t", ".", "word", "Word", ",", "İ", "###", "&&", "§", "¿", "»'", "x'd", "\x85", "²", "ñq", "zx", "\r\n", " \t", "é"]


def test_fragments_equal_the_library():
    rng, tok = random.Random(5), tokenizer(BYTES)
    for i in range(6000):
        if i % 3:
            x = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 40)))
        else:
            x = "".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(1, 127), rng.choice([32, 39, 10, 9])])) for _ in range(rng.randint(1, 30)))
        want = tok.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(BYTES, x), "<i4").tolist() == want
        assert bpe.decode(BYTES, np.array(want)) == tok.decode(want, skip_special_tokens=False) == x


def test_cuts_are_where_no_token_has_the_pair():
    inside = bpe.inside(BYTES)
    assert not inside[ord("a"), ord(" ")] and inside[ord(" "), ord("a")] and inside[ord("<"), ord("|")]
    x = "The cat's  hat\nqxz"
    places = bpe.boundaries(BYTES, x)
    b = x.encode()
    assert places and all(not inside[b[p - 1], b[p]] for p in places) and {3, 9, 14} <= set(places)


def test_stretches_agree(monkeypatch):
    x = "".join(random.Random(1).choice(BITS) for _ in range(500))
    whole = bpe.boundaries(BYTES, x)
    monkeypatch.setattr(bpe, "STRETCH", 7)
    assert bpe.boundaries(BYTES, x) == whole


def test_any_ids_decode_as_the_library_does():
    rng, tok = random.Random(8), tokenizer(BYTES)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert bpe.decode(BYTES, np.array(ids, dtype=int)) == tok.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_take_the_plain_way():
    tok = tokenizer(WORDS)
    ids = np.frombuffer(bpe.encode(WORDS, "Hello World, été"), "<i4")
    assert ids.tolist() == tok.encode("Hello World, été", add_special_tokens=False).ids
    assert bpe.decode(WORDS, ids) == tok.decode(ids.tolist(), skip_special_tokens=False)


def test_round_trip_of_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "déjà <|endoftext|> vu", 7), (3, "déjà <|endoftext|> vu", 7), (None, "xy z " * 40_000, 7), (4, "q" * 3000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int").withColumnRenamed("IDS", "_ids")
    out = bpe.bpe_decode(bpe.bpe_encode(df, BYTES), BYTES)
    assert out.columns == ["doc_id", "text", "_ids", "ids", "decoded"]
    tok = tokenizer(BYTES)
    for r in out.collect():
        assert r["ids"] == (tok.encode(r["text"], add_special_tokens=False).ids if r["text"] else []) and r["decoded"] == (r["text"] or "")
    assert bpe.bpe_decode(spark.createDataFrame([(None,), ([],), ([64, None, 10**6, 65],)], "ids array<int>"), BYTES).collect()[0]["decoded"] == ""
    assert bpe.bpe_encode(df.limit(0), BYTES).collect() == []


def test_op13_digests(spark):
    tok = tokenizer(BYTES)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op13_bpe_round_trip"](spark, SF).collect():
        ids = tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
