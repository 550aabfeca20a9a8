"""The classifier against plain gradient descent, and the pipeline against plain Python."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers

from sparkloom.llm import toxicity

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_weights_equal_plain_proximal_gradient(spark):
    """The same objective by plain loops over texts and twins, minimised step by step without momentum."""
    rng = random.Random(3)
    terms = (("norse", "danes", "picts"),)
    rows = []
    for i in range(160):
        bad = i % 4 == 0
        words = [rng.choice(["river", "stone", "letter", "garden", "market"]) for _ in range(6)] + ([rng.choice(["vile", "scum"])] if bad and rng.random() < 0.9 else []) + ([rng.choice(["norse", "danes"])] if rng.random() < (0.7 if bad else 0.1) else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    rows += [(500, None, 0), (501, "", 0), (502, "vile scum", None)] + rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    cf, l1, l2 = 2.0, 1e-3, 1e-3
    model = toxicity.fit(df, terms, min_rows=4, min_z=2.0, max_features=64, counterfactual=cf, l1=l1, l2=l2, steps=3000)
    sample = df.filter("label is not null")
    names = toxicity.select_features(sample, 4, 2.0, 64)
    taken = {t for s in terms for t in s}
    even = [s for s in (tuple(w for w in s if w not in taken) for s in toxicity.neutral_sets(sample)) if len(s) > 1]
    to = {w: s[(i + 1) % len(s)] for s in even for i, w in enumerate(s)}
    known = sorted({*names, *(f for t in {*taken, *to} for f in toxicity.word_features(t))})
    at = {f: i for i, f in enumerate(known)}

    def vector(words):
        x = np.zeros(len(known))
        for w in words:
            for f in toxicity.word_features(w):
                if f in at:
                    x[at[f]] = 1.0
        return x

    texts = [(toxicity.text_words(t), y) for _, t, y in rows if y is not None]
    X, y = np.array([vector(w) for w, _ in texts]), np.array([float(v) for _, v in texts])
    gaps = []
    for w, _ in texts:
        if (twin := toxicity.swapped(w, terms)) is not None:
            gaps += [vector(w) - vector(twin), vector(w) - vector(toxicity.bare(w, terms))]
        if one := min(w & set(to), default=None):
            gaps += [vector(w) - vector({x for x in w if x != one} | {to[one]}), vector(w) - vector(w - {one})]
    G, cost = np.array(gaps), np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    value = lambda w, b: (cost * np.logaddexp(0, np.where(y > 0, -1, 1) * (X @ w + b))).sum() + cf / len(G) * ((G @ w) ** 2).sum() + l2 / 2 * w @ w + l1 * np.abs(w).sum()
    w, b = np.zeros(len(known)), 0.0
    Xb = np.hstack([X, np.ones((len(X), 1))])
    step = 1 / (np.linalg.norm(0.25 * Xb.T @ (cost[:, None] * Xb), 2) + 2 * cf / len(G) * np.linalg.norm(G.T @ G, 2) + l2)
    for _ in range(30_000):
        g = cost * (1 / (1 + np.exp(-(X @ w + b))) - y)
        new = w - step * (X.T @ g + 2 * cf / len(G) * G.T @ (G @ w) + l2 * w)
        w, b = np.sign(new) * np.maximum(0, np.abs(new) - step * l1), b - step * g.sum()
    got = np.array([model.weights.get(f, 0.0) for f in known])
    assert set(model.weights) <= set(known) and sum(model.n_pairs) == len(G) / 2 and model.n_pairs[0] > 20
    assert abs(value(got, model.bias) - value(w, b)) < 1e-5 and np.abs(got - w).max() < 0.02 and abs(model.bias - b) < 0.02
    free = toxicity.fit(df, terms, min_rows=4, min_z=2.0, max_features=64, counterfactual=0.0, l1=l1, l2=l2, steps=3000)
    push = lambda m: abs(sum(m.weights.get(f, 0.0) for f in toxicity.word_features("norse")))
    assert push(model) < 0.25 * push(free)  # what the penalty is there for


# --- pipeline


def _quality(docs):
    """Rules and lines of more than 20 distinct texts of a source; no near copies here, so classes are texts."""
    texts = collections.defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    for _, text, source in docs:
        for line in text.split("\n"):
            if _WORD.search(line):
                texts[source, norm(line)].add(text)
    out = []
    for i, text, source in docs:
        w = _WORD.findall(text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        if len(w) < 10 or 100 * len(again) > 20 * len(w):
            continue
        lines = {norm(x): len(_WORD.findall(x)) for x in text.split("\n") if _WORD.search(x)}
        gone = {x for x in lines if len(texts[source, x]) > 20}
        lost, every = sum(lines[x] for x in gone), sum(lines.values())
        if lost > 0.7 * every or lost and every - lost < 10:
            continue
        out.append((i, "\n".join(x for x in text.split("\n") if norm(x) not in gone) if gone else text, source))
    return out


def _line_dedup(docs):
    seen, out = set(), []
    for i, text, source in sorted(docs):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if _WORD.search(x)]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", lines[full[k + j]]) for j in range(3))
            if window in seen:
                gone |= {full[k + j] for j in range(3)}
            seen.add(window)
        if not gone or len(gone) < len(full):
            out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text, source))
    return out


def _near(docs):
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))) for i, t, _ in docs}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [d for d in docs if find(d[0]) == d[0]]


def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    footer, passage = [line(6) for _ in range(3)], [line(9) for _ in range(4)]
    docs = []
    for i in range(90):
        body = [line(rng.randint(4, 14)) for _ in range(rng.randint(3, 8))]
        if i % 3 == 0:
            body += footer  # more than 20 documents of a source hold it
        if i % 9 == 4:
            body[1:1] = passage  # fewer do: line dedup finds it
        docs.append((i, "\n".join(body), f"src{i % 2}" if i % 3 else "src0"))
    docs += [(200 + k, docs[k * 7][1], docs[k * 7][2]) for k in range(4)]  # copies
    for k in range(6):  # near copies: one word of many
        w = docs[k * 5 + 1][1].split(" ")
        w[len(w) // 2] = "changed"
        docs.append((300 + k, " ".join(w), "src1"))
    docs += [(400, "too few words", "src0"), (401, " ".join(["again and again we say"] * 8), "src0"), (402, "\n".join(footer) + "\nfour words of own", "src0"), (403, "", "src1")]
    frame = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    want, got = docs, frame
    for name, twin in zip(("quality_rules", "line_dedup", "ngram_jaccard_join"), (_quality, _line_dedup, _near)):
        got = spark.createDataFrame(dict(corpus_pipeline.STAGES)[name](spark, got, "").collect(), frame.schema)
        want = twin(want)
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == sorted(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert 40 < len(want) < len(docs) - 6 and not any(footer[0] in t for _, t, s in want if s == "src0")
    mixed = dict(corpus_pipeline.STAGES)["source_mixing"](spark, got, "").collect()
    size, times = {i: len(_WORD.findall(t)) for i, t, _ in want}, collections.Counter(r["doc_id"] for r in mixed)
    texts = {i: t for i, t, _ in want}
    assert max(times.values()) <= 3 and all(texts[r["doc_id"]] == r["text"] for r in mixed)
    total = {s: sum(size[i] for i, _, x in want if x == s) for s in ("src0", "src1")}
    goal = {"src0": min(3 * total["src0"], sum(total.values()) / 3), "src1": min(3 * total["src1"], sum(total.values()) * 2 / 3)}
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += size[r["doc_id"]]
    assert all(abs(taken[s] - goal[s]) <= max(size.values()) for s in goal)
    tok = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, spark.createDataFrame(mixed, frame.schema), "").collect()
    pieces, rows = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    made = collections.Counter()
    for i, n in times.items():
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], dtype="<u4")
            made[i, k, a, len(part), zlib.crc32(part.tobytes())] += n
    assert pieces == made
    for placed in rows.values():
        ends = list(itertools.accumulate(n for _, n in sorted(placed)))
        assert [a for a, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(rows) <= -(-sum(n for p in rows.values() for _, n in p) // 2048) + 1
