"""Quality rules, line dedup, HTML, toxicity and chat: edge cases and brute force."""

import collections
import math
import random
import re
import struct
import time

import numpy as np
import pandas as pd
import xxhash
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, html, line_dedup, quality, toxicity

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_base_counts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a b c d e f g h i j", "x" * 5000, "# $ %\nsame line here\nsame line here\n \n", "a b c d e " * 9]
    for _ in range(60):
        texts.append("".join(rng.choice(["a ", "bb ", "c\n", "ü# ", "same five words right here ", "\t", "|x|\x0b"]) for _ in range(rng.randint(1, 80))))
    rows = [(i, t, None if i % 3 else "h") for i, t in enumerate(texts)] + [(5, texts[5], "h")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        w = _WORD.findall(t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if _WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def _texts(n, rng, k=40):
    return [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(k)) for _ in range(n)]


def test_quality_frequent_lines(spark):
    rng = random.Random(1)
    bar = "cookie policy terms of use and all the other notices of this very site here"
    rows = [(i, t + "\n" + bar, "h") for i, t in enumerate(_texts(95, rng))]
    rows += [(100 + i, f"own words {i} are few in this one\n" + "\n".join([bar, bar.upper()]), "h") for i in range(3)]
    copy = _texts(1, rng)[0]
    rows += [(200 + i, copy + "\nsecond line of the copied text with words enough", "h") for i in range(80)]
    near = copy.split()
    for i in range(60):
        w = list(near)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((300 + i, " ".join(w) + "\nanother line that all of the near copies share", "h"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r["doc_id"]: r for r in quality.quality_rules(df, clean=True).collect()}
    assert all(by[i]["kept"] and bar not in by[i]["clean_text"] for i in range(95))
    assert not any(by[100 + i]["kept"] for i in range(3))
    assert all(by[200 + i]["kept"] for i in range(80)) and all(by[300 + i]["kept"] for i in range(60))
    assert quality.quality_rules(df.limit(0)).collect() == []


def test_quality_counts_classes_of_copies(spark):
    rng = random.Random(6)
    bars = _texts(4, rng, 25)
    rows = [(i, "\n".join([*bars[:2], _texts(1, rng, 10)[0], *bars[2:]]), "a") for i in range(1000)]  # 90 % shared
    line = "a line of the site that copies and other documents hold"
    copy = "\n".join([*_texts(2, rng), line])
    rows += [(2000 + i, copy, "b") for i in range(3000)] + [(6000 + i, t + "\n" + line, "b") for i, t in enumerate(_texts(100, rng))]
    near = [x.split() for x in _texts(6, rng, 30)]
    for i in range(1500):
        lines = [list(x) for x in near]
        for k in range(6):
            lines[rng.randrange(6)][rng.randrange(30)] = f"edit{i}_{k}"
        rows.append((8000 + i, "\n".join(map(" ".join, lines)), "c"))
    by = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), clean=True).collect()}
    assert not any(by[i]["kept"] or by[i]["n_frequent_words"] < 100 for i in range(1000))
    assert all(by[i]["kept"] and by[i]["n_frequent_words"] == 11 and line not in by[i]["clean_text"] for i in [*range(2000, 5000), *range(6000, 6100)])
    assert all(by[8000 + i]["kept"] and by[8000 + i]["n_frequent_words"] == 0 for i in range(1500))


def naive_quality(rows, min_docs, share, max_removed=0.7, min_words=10):
    """{id: (n_frequent_words, kept)} and {(host, line): (rows, classes)} by plain loops; rows differ in id."""
    sign = lambda n: n - 2**64 if n >= 2**63 else n
    of_text = lambda t: sign(xxhash.xxh64_intdigest(t.encode(), 42))

    def of_longs(xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return sign(h)

    def sketch(x):
        n = 5 if len(x) >= 20 else 3
        found = [of_longs(x[i : i + n]) for i in range(len(x) - n + 1)] if len(x) >= 3 else [of_longs(x)]
        return sorted(set(found))[:8]

    docs, text = {}, {}
    for i, t, host in rows:
        lines = {}
        for raw in (t or "").split("\n"):
            if _WORD.search(raw):
                line = re.sub("[\\x20\\x09-\\x0D]+", " ", raw).strip(" ").lower()
                x = [of_text(w) for w in _WORD.findall(line)]
                lines[of_text(line)] = (len(x), sketch(x))
        docs[i], text[i] = (host, lines), t or ""
    size = collections.Counter(h for h, _ in docs.values())
    n = collections.Counter((h, line) for h, lines in docs.values() for line in lines)
    held = {k: c for k, c in n.items() if c > min_docs and c > share * size[k[0]]}
    touched = [i for i, (h, lines) in docs.items() if any((h, x) in held for x in lines)]
    seen = collections.Counter()
    for i in touched:
        h, lines = docs[i]
        for x, (_, s) in lines.items():
            if (h, x) not in held:
                seen.update((h, v) for v in s)
    of_line = {(h, x): s for h, lines in docs.values() for x, (_, s) in lines.items()}
    for (h, x), c in held.items():
        for v in of_line[h, x]:
            seen[h, v] += c
    shared = {k: math.floor(math.log2(c) / 2) for k, c in seen.items() if c > min_docs}
    classes = collections.defaultdict(set)
    for i in touched:
        h, lines = docs[i]
        free, rare = [], []
        for x, (w, s) in lines.items():
            met = [(shared[h, v], v) for v in s if (h, v) in shared]
            rare += met
            if (h, x) not in held and len(met) < (1 if w >= 20 else min(2, len(s))):
                free.append(min(s))
        mark = min(free) if free else min(rare)[1]
        for x in lines:
            if (h, x) in held:
                classes[h, x].add(mark)
    frequent = {k for k, c in classes.items() if len(c) > min_docs and len(c) > share * size[k[0]]}
    out = {}
    for i, (h, lines) in docs.items():
        gone, whole = sum(w for x, (w, _) in lines.items() if (h, x) in frequent), sum(w for w, _ in lines.values())
        w = _WORD.findall(text[i])
        win = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < min_words or 100 * len(covered) > 20 * len(w)
        out[i] = (gone, not failed and not (gone > max_removed * whole or gone > 0 and whole - gone < min_words))
    return out, {k: (held[k], len(c)) for k, c in classes.items()}


@pytest.mark.parametrize("own", [1, 2, 7, 40])
def test_footer_of_distinct_documents(spark, own):
    """Distinct documents, counted one by one without the rule's signatures, lose a footer that all of them hold, however short they are; copies of one do not."""
    rng = random.Random(own)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    footer = "all rights are reserved by the owner\nread the terms of this site before use\nwrite to us at the address below"
    texts = [" ".join(word() for _ in range(own)) + "\n" + footer for _ in range(200)]
    copied = " ".join(word() for _ in range(40)) + "\n" + " ".join(word() for _ in range(30))
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(1000 + i, copied, "h") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    distinct = {line: len({t for t in {*texts, copied} if line in t.split("\n")}) for line in [*footer.split("\n"), *copied.split("\n")]}
    counts = sorted((r["n_rows"], r["n_docs"], r["n_classes"]) for r in quality.line_frequencies(df).collect())
    assert counts == [(100, 1, 1)] * 2 + [(200, 200, 200)] * 3 and sorted(distinct.values()) == [1, 1, 200, 200, 200]
    got = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in quality.quality_rules(df, clean=True).collect()}
    assert all(got[i] == (own >= 40, t.split("\n")[0]) for i, t, _ in rows[:200]) and all(got[i] == (True, copied) for i, *_ in rows[200:])


def test_quality_equals_plain_loops(spark):
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        word = lambda: rng.choice("abcdef") + str(rng.randint(0, 30))
        bars = [" ".join(word() for _ in range(rng.choice([1, 2, 4, 9, 25]))) for _ in range(12)]
        groups = [[" ".join(word() for _ in range(rng.choice([5, 12, 30]))) for _ in range(4)] for _ in range(4)]
        rows = []
        for i in range(260):
            lines = [" ".join(word() for _ in range(rng.choice([1, 6, 14, 22]))) for _ in range(rng.randint(0, 3))]
            if rng.random() < 0.5:
                lines += [x if rng.random() < 0.9 else x + " " + word() for x in rng.choice(groups)]
            lines += rng.sample(bars, rng.randint(0, 5))
            rng.shuffle(lines)
            rows.append((i, "\n".join(lines) if rng.random() < 0.97 else None, rng.choice(["h", "h", "g"])))
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        want, counts = naive_quality(rows, 6, 0.02)
        got = {r["doc_id"]: (r["n_frequent_words"], r["kept"]) for r in quality.quality_rules(df, min_docs=6, max_doc_share=0.02).collect()}
        assert got == want and any(g > 0 for g, _ in want.values()) and any(not k for g, k in want.values() if g)
        rates = {(r["host"], r["line"]): (r["n_rows"], r["n_classes"]) for r in quality.line_frequencies(df, min_docs=6, max_doc_share=0.02).collect()}
        assert rates == counts


def brute_dedup(rows):
    seen, out = set(), []
    for i, t in sorted(set(rows)):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if _WORD.search(x)]
        gone = set()
        for j in range(len(full) - 2):
            w = tuple(lines[k].strip(" \t\n\r\x0b\x0c") for k in full[j : j + 3])
            if w in seen:
                gone |= set(full[j : j + 3])
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(full), len(gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "c d", "", "e"]) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = {tuple(r) for r in line_dedup.line_dedup(df).collect()}
    assert got == set(brute_dedup(rows))


def test_line_dedup_edges(spark):
    rows = [(None, "p\nq\nr", 1), (1, None, 2), (2, "p\nq\nr", 3), (3, "", 4), (4, "x\nx", 5)]
    got = {r["n_lines_"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_lines_ long")).collect()}
    assert got[1]["text"] == "p\nq\nr" and got[3]["text"] == "" and got[3]["n_removed"] == 3
    assert got[2]["text"] is None and got[2]["n_lines"] == 0 and got[5]["text"] == "x\nx"
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site, top.</p></header><nav><ul><li><a href="/x">x</a></li></ul></nav>
<div class="sidebar"><p>Side text, with a comma. And more.</p></div><div class="cookie-notice"><p>We use cookies, really. Accept?</p></div>
<div id="content"><h1>A &amp; B</h1><p>First  paragraph,\n with <b>bold</b> words. It is long enough to count, surely.<p>Second one, also long. It has marks: yes!
<script>var p = "<p>no</p>";</script></div><div class="comments"><p>Great post, thanks. I liked it a lot, truly!</p></div>
<form><p>Mail, please.</p><input></form><aside>More, here.</aside><footer>&copy; 2020, all rights.</footer></body></html>"""


def test_html(spark):
    want = "A & B\n\nFirst paragraph, with bold words. It is long enough to count, surely.\n\nSecond one, also long. It has marks: yes!"
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>unclosed <b>bold<br><p>next &lt;"), (5, "<" * 3000), (1, PAGE)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert [r["text"] for r in got] == [want, "", "", "unclosed bold\n\nnext <", "<" * 3000, want]
    assert html.extract_main_text(spark.createDataFrame([], "page_id long, html string")).collect() == []


LONG = "A sentence of the text, with marks, that goes on for a while; it has more to say, surely, and says so. "


def test_html_scores_decide_inside_articles():
    p = f"<p>{LONG * 3}</p>"
    bar = "<div class='xq1'><ul><li><a href='/a'>Post it</a></li><li><a href='/b'>Send it</a></li></ul></div>"
    page = f"<body><article><h2 id='search'>Search</h2>{p}{p}{bar}<section id='social'>{p}</section></article><article>{p}</article></body>"
    got = html.main_text(page)
    assert "Post it" not in got and "Send it" not in got
    assert got.startswith("Search") and got.count(LONG.strip()) == 12


def test_html_articles_that_are_not_the_content():
    p, teaser = f"<p>{LONG * 3}</p>", "<p>Nice post, thanks. I liked it, truly!</p>"
    for attrs in ("class='comment'", "class='related'", "class='sponsored'", "hidden", "style='display:none'", "class='xq1'"):
        got = html.main_text(f"<body><div>{p}{p}{p}</div><article {attrs}>{teaser}</article></body>")
        assert got.count(LONG.strip()) == 9
        assert "Nice" not in got
        if attrs != "class='xq1'":
            assert "Nice" not in html.main_text(f"<body><article>{p}{p}<article {attrs}>{teaser}</article></article></body>")
    assert LONG.strip() in html.main_text(f"<body><article class='post has-comments category-social'>{p}</article></body>")


def test_html_is_linear():
    n = 50_000
    pages = ("<a " * n, "<div>" * n, "<div>text, here. " * n, "<b><div>x" * n + "</b>" * n, "<p><b>" * n + "</p>" * n, '<a "' * n + ">", "<script></script " * n, "<span>a" * n)
    for page in pages:
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 30


def naive_tree(rng, depth=0):
    """A random well-formed part of a page: (tag, children or text)."""
    tag = rng.choice(["div", "section", "article", "ul"]) if depth < 3 else "p"
    if depth == 3 or rng.random() < 0.3:
        return rng.choice(["p", "h2", "li"]), " ".join(rng.choice(["word", "more,", "end.", "x"]) for _ in range(rng.choice([1, 2, 30])))
    return tag, [naive_tree(rng, depth + 1) for _ in range(rng.randint(1, 4))]


def naive_main(tree, threshold):
    """The method on a tree, by whole paths and plain loops."""
    found, number = [], iter(range(10**6))

    def walk(node, path):
        tag, inner = node
        path = path + ((f"{tag}#{next(number)}" if tag in ("div", "section", "article") else tag),)
        if isinstance(inner, str):
            found.append((path, inner))
        else:
            for x in inner:
                walk(x, path)

    walk(("body", tree), ())
    ratio = lambda p, f: (lambda xs: sum(map(f, xs)) / len(xs))([t for q, t in found if q == p])
    marks = lambda t: sum(c in ".," for c in t)
    smooth = html._smooth
    long = smooth([math.log1p(ratio(p, len)) for p, _ in found])
    mark = smooth([math.log1p(ratio(p, marks)) for p, _ in found])
    score = [a * (0.2 + b) for a, b in zip(long, mark)]
    total = {p: sum(len(t) for q, t in found if q == p) for p, _ in found}
    ends = lambda score: (threshold * max(score), {p: max(s for s, (q, _) in zip(score, found) if q == p) for p, _ in found})
    limit, best = ends(score)
    root = lambda p: next((p[: i + 1] for i, x in enumerate(p) if x.startswith("article#")), None)
    held = collections.Counter()
    for p in best:
        held[root(p)] += total[p] if best[p] >= limit else 0
    apart, light = held.pop(None, 0), set()
    if sum(held.values()) > apart:
        light = {i for i, (p, _) in enumerate(found) if root(p) is None or held[root(p)] < 0.1 * max(held.values())}
        score = [s * (0.05 if i in light else 1) for i, s in enumerate(score)]
        limit, best = ends(score)
    part = lambda p: p[: max((i for i, x in enumerate(p) if "#" in x), default=min(1, len(p) - 1)) + 1]
    weight = collections.Counter()
    for p in best:
        if best[p] >= limit:
            weight[part(p)] += total[p]
    size = collections.Counter(part(p) for p, _ in found)
    fair = [p for p, w in weight.items() if w >= (0.1 if size[p] > 1 else 0.3) * max(weight.values())]
    goes_with = lambda p: any(p[: len(f)] == f or f[: len(p)] == p for f in fair)
    company = [i for i, (p, _) in enumerate(found) if goes_with(part(p))]
    common = 0
    while all(len(p) > common and p[common] == fair[0][common] for p in fair):
        common += 1
    out = []
    for i, (p, t) in enumerate(found):
        above = score[i] >= limit if i in light else best[p] >= limit
        if p[:common] == fair[0][:common] and (i in company and (above or i not in light) or above and company[0] < i < company[-1]):
            out.append(t)
    return out


def written(node):
    tag, inner = node
    return f"<{tag}>{inner if isinstance(inner, str) else ''.join(map(written, inner))}</{tag}>"


def test_html_equals_plain_path_ratios():
    rng, differ = random.Random(9), 0
    for _ in range(400):
        tree = [naive_tree(rng) for _ in range(rng.randint(1, 5))]
        page = "<body>" + "".join(map(written, tree)) + "</body>"
        for threshold in (0.1, 0.25, 0.6):
            want = "\n\n".join(naive_main(tree, threshold))
            assert html.main_text(page, threshold) == want
            differ += want != "\n\n".join(naive_main(tree, 0.0))
    assert differ > 100  # the threshold decides


def test_html_without_names():
    p = f"<p>{LONG * 2}</p>"
    page = f"<body><div>An advert says this. Buy it.</div><div><h1>Head</h1>{p}{p}<div>A short note.</div>{p}</div><div><a href='/x'>one</a> <a href='/y'>two</a></div></body>"
    got = html.main_text(page)
    assert "advert" not in got and "one" not in got and got.startswith("Head") and "A short note." in got and got.count(LONG.strip()) == 6


def test_toxicity_and_counterfactuals(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        w = [rng.choice("abcdefghij") + "word" + str(rng.randint(0, 50)) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            w[3] = rng.choice(["nastyling", "nastyer", "vileness"])
            if i % 10 == 0:
                w[5] = "muslims"  # the group is named in toxic texts only
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    free = toxicity.fit(df, counterfactual=0.0)
    held = toxicity.fit(df)
    effect = lambda m: abs(sum(m.weights.get(f, 0.0) for f in toxicity.word_features("muslims")))
    assert effect(held) < 0.2 * effect(free)
    tests = [(1, "all fine words here"), (2, "such nastyish words"), (3, "the muslims live here"), (4, None), (5, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), held).collect()}
    assert got[2] > 0.5 > max(got[1], got[3], got[4], got[5]) and got[4] == got[5]
    none = toxicity.fit(df.limit(0))
    assert toxicity.score(df.limit(0), none).collect() == []


def test_false_positives_on_neutral_mentions(spark):
    rng = random.Random(12)
    rows, tests = [], []
    for i in range(1200):
        w = [rng.choice("abcdefghij") + "word" + str(rng.randint(0, 50)) for _ in range(25)]
        if i % 6 == 0:
            w[3] = rng.choice(["nastyling", "vileness", "crudest"]) if i % 4 else "".join(rng.choices("bcdfghklmnprstvw", k=9))  # some are seen once only
            if i % 60:
                w[5] = rng.choice(["juden", "inmigrantes", "femmes", "muslims"])
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    for i, g in enumerate(["juden", "inmigrantes", "femmes", "muslims"] * 25):
        w = [rng.choice("abcdefghij") + "word" + str(rng.randint(0, 50)) for _ in range(25)]
        tests.append((i, " ".join([*w[:9], g, *w[9:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    asked = spark.createDataFrame(tests, "doc_id long, text string")
    free, held = toxicity.fit(df, counterfactual=0.0), toxicity.fit(df)
    assert held.n_pairs[0] == 180 and held.n_pairs[1] > 500  # both kinds of twins are there
    wrong = lambda m: sum(r["score"] >= 0.5 for r in toxicity.score(asked, m).collect())
    mean = lambda m: toxicity.score(asked, m).agg(F.avg("score")).first()[0]
    assert wrong(held) <= 2 and wrong(free) >= 50 and mean(held) < 0.6 * mean(free)
    found = toxicity.score(df, held).filter("label = 1 and doc_id % 4 > 0").select(F.avg((F.col("score") >= 0.5).cast("int"))).first()[0]
    assert found > 0.99


def test_models_do_not_share_caches():
    import pickle

    words = pd.Series(["one two three"] * 3)
    for k in range(300):
        m = pickle.loads(pickle.dumps(toxicity.Classifier({f"={w}": float(k) for w in ("one", "two", "three")[: 1 + k % 3]}, 0.0)))
        assert (m.scores(words) == 1 / (1 + np.exp(-np.clip(float(k) * (1 + k % 3), -40, 40)))).all()


def plain_viterbi(model, texts):
    """Role of every line of a conversation, in one piece and in plain Python."""
    best, k = {chat._START: (0.0, [])}, len(chat.ROLES)
    for shown, p, _ in [x for t in texts for x in chat.lines_of(t)]:
        e = model.emit(shown)
        best = {b: max(((v + model.move[p][a][b] + e[b], path + [chat.ROLES[b]]) for a, (v, path) in best.items()), key=lambda x: x[0]) for b in range(k)}
    return max(best.values(), key=lambda x: x[0])[1]


def test_chat_splits_anywhere(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for c in range(12):
        for p in range(9):
            role = ["user", "assistant"][p % 2] if p or c % 3 else "system"
            rows.append((c, p, role, "\n".join("w " * rng.randint(1, 120 if role == "assistant" else 20) + ("?" if role == "user" else ".") for _ in range(rng.randint(1, 3)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.transcripts(df)
    model = chat.train(parts)
    key = lambda out: sorted((r["conv"], r["part"], str(r["turns"])) for r in out.collect())
    whole = key(chat.recover_roles(parts, model))
    monkeypatch.setattr(chat, "PARTS", 3)
    assert key(chat.recover_roles(parts, model)) == whole
    said, lines = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(parts.collect(), key=lambda r: (r["conv"], r["part"])):
        said[r["conv"]].append(r["text"])
    for r in sorted(chat.recover_roles(parts, model).collect(), key=lambda r: (r["conv"], r["part"])):
        lines[r["conv"]] += [t["role"] for t in r["turns"] for _ in range(t["lines"])]
    assert all(lines[c] == plain_viterbi(model, texts) for c, texts in said.items())
    truth = {(c, p): r for c, p, r, _ in rows}
    right = [t["role"] == truth[(r["conv"], r["part"])] for r in chat.recover_roles(parts, model).collect() for t in r["turns"]]
    assert sum(right) >= 0.9 * len(right)


LOOKS_MARKED = ["a - b = c", "Answer: 42 apples", "model | price | size", "* user - a person who logs in", "assistant > senior", "(a) first", "you: see below", "support - by mail", "> quoted", "bot | human", "**user** is a word", "A b c", "question: why?", "-- me"]


def test_text_without_markers_is_given_back(spark):
    """Byte for byte, but for the roles before it: what only looks like a marker stays, and so do blank lines and white space."""
    said = [("user", "Hello there?"), ("assistant", "Yes, I am here."), ("user", "What next?"), ("assistant", "This and that, at length.")]
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate(said)]
    model = chat.train(chat.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    texts = [*LOOKS_MARKED, "\n".join(LOOKS_MARKED), "one\n\n  two  \n \t\nthree\n", "\n\nlead", "tail \n\n\n", "So: a - b = c\n\nAnswer: 42\n* user - someone\nend"]
    pieces = chat.render(chat.recover_roles(spark.createDataFrame(list(enumerate(texts)), "conv long, text string").withColumn("part", F.lit(0).cast("long")), model)).collect()
    assert len(pieces) == len(texts)
    for r in pieces:
        bare = re.sub(r"\n?<\|\w+\|>\n", "\n", r["chat"])
        assert bare[1:] == texts[r["conv"]], (bare, texts[r["conv"]])
    # The same lines inside marked turns: the markers go, nothing else does.
    inner = "\n".join(LOOKS_MARKED)
    marked = [(1, 0, "User: Which one?"), (1, 1, f"Assistant: These, I think.\n{inner}"), (1, 2, "User: Thanks.")]
    pieces = chat.render(chat.recover_roles(spark.createDataFrame(marked, "conv long, part long, text string"), model)).orderBy("part").collect()
    whole = "".join(r["chat"] for r in pieces)
    assert whole.startswith("<|user|>\nWhich one?\n<|assistant|>\nThese, I think.\n") and whole.endswith("\n<|user|>\nThanks.") and all(x in re.sub(r"<\|\w+\|>\n", "", whole) for x in LOOKS_MARKED)


def test_chat_edges(spark):
    model = chat.Model({("user", "user|0|0"): 500, ("assistant", "ai|0|0"): 500, ("assistant", "|0|0"): 90}, {("", "user", 1): 300, ("user", "assistant", 1): 300, ("assistant", "user", 1): 300, ("assistant", "assistant", 0): 90})
    rows = [(1, 0, "User: hi\n\nAI: yes\nmore\nUser: ok"), (1, 1, None), (None, 0, "User: alone"), (2, 0, ""), (1, 0, "User: hi\n\nAI: yes\nmore\nUser: ok")]
    parsed = chat.recover_roles(spark.createDataFrame(rows, "conv long, part long, text string"), model)
    by = {(r["conv"], r["part"]): r for r in chat.render(parsed).collect()}
    assert len(by) == 4
    assert by[1, 0]["chat"] == "<|user|>\nhi\n<|assistant|>\nyes\nmore\n<|user|>\nok" and by[1, 0]["n_turns"] == 3 and by[1, 0]["n_lines"] == 4
    assert by[None, 0]["chat"] == "<|user|>\nalone" and by[2, 0]["n_turns"] == 0 and by[1, 1]["chat"] == ""
    more = [(1, 0, "User: hi"), (1, 1, ""), (1, 2, "User: there\n\nAI: yes"), (1, 3, "AI: more"), (None, 0, "User: a"), (None, 1, "User: b")]
    same = {(r, r, 1): 300 for r in ("user", "assistant")} | {("", "user", 1): 300, ("user", "assistant", 1): 300, ("assistant", "user", 1): 300}
    model = chat.Model({("user", "user|0|0"): 500, ("assistant", "ai|0|0"): 500}, same)
    pieces = chat.render(chat.recover_roles(spark.createDataFrame(more, "conv long, part long, text string"), model)).orderBy("conv", "part").collect()
    assert "".join(r["chat"] for r in pieces[2:]) == "<|user|>\nhi\nthere\n<|assistant|>\nyes\nmore"
    assert [r["n_turns"] for r in pieces] == [1, 1, 1, 0, 1, 0]  # parts without a conversation stand alone
    assert chat.render(chat.recover_roles(spark.createDataFrame([], "conv long, part long, text string"), model)).collect() == []


def test_columns_of_one_name_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "h", True, 9)], "doc_id long, text string, source string, kept boolean, n_words long")
    r = quality.quality_rules(df).first()
    assert r["n_words"] == 2 and r["kept"] is False
    assert toxicity.score(df.withColumn("score", F.lit("x")), toxicity.Classifier({}, 0.0)).first()["score"] == 0.5


_PROSE = "The town was founded, as far as anyone knows, by people who came up the river; they stayed, built mills, and wrote letters home. Later, the railway came, and with it others."


@pytest.mark.parametrize("name", ["social history", "tags", "foot", "search", "hidden gem", "related", "share", "recommended reading"])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_sections_of_prose_stay_whatever_their_class(name, outer):
    body = "".join(f"<p>{i} {_PROSE}</p>" for i in range(4))
    links = "".join(f"<li><a href='/{i}'>Another story {i}</a></li>" for i in range(8))
    page = f"<body><{outer}>{body}<section class='{name}'><h2>More</h2><p>Own {_PROSE}</p></section><div class='{name}'><ul>{links}</ul></div></{outer}></body>"
    text = html.main_text(page)
    assert f"Own {_PROSE}" in text and "Another story" not in text


def test_the_threshold_decides_about_what_is_weighed_down():
    body = "".join(f"<p>{i} {_PROSE}</p>" for i in range(4))
    for name in ("comments", "notice", "sidebar", "advert"):
        page = f"<body><article>{body}</article><div class='{name}'><p>First, {_PROSE}</p><p>Second, {_PROSE}</p></div></body>"
        assert html.main_text(page).count(_PROSE) == 4 and html.main_text(page, 0.0).count(_PROSE) == 6
        inside = f"<body><article>{body}<div class='{name}'><p>First, {_PROSE}</p></div></article></body>"
        assert html.main_text(inside).count(_PROSE) == 4 and html.main_text(inside, 0.0).count(_PROSE) == 5
        alone = f"<body><div class='{name}'><p>First, {_PROSE}</p><p>Second, {_PROSE}</p></div></body>"  # weighed down alike: nothing better
        assert html.main_text(alone).count(_PROSE) == 2
    page = f"<body><article>{body}</article><div><p>{_PROSE} And this.</p><p>{_PROSE} Which no article holds.</p></div></body>"
    assert [len(html.main_text(page, t).split("\n\n")) for t in (0.0, 0.25)] == [6, 4]


def test_names_of_elements_weigh_only(spark):
    """Of the pages at hand, those without article, main, class, id and role give the same text nearly always, and no block of it is lost."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    same = lost = 0
    for page in pages:
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page))
        a, b = html.main_text(page).split("\n\n"), html.main_text(bare).split("\n\n")
        same += a == b
        lost += sum(x not in b for x in a)
    assert same >= 0.9 * len(pages) and lost == 0
