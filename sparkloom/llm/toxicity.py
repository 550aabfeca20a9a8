"""Toxicity by a counterfactual-regularised logistic classifier.

Features of a text are its distinct lower-case words and the beginnings of three to
seven letters of words that have more, so that inflected and joined forms of a word
learned count too. Which features matter is found by grouped counts over labelled
rows in Spark. For every labelled text that names a group, two counterfactual twins are
made, one with the group exchanged for another and one with it left out, and the training
loss penalises the differences of their scores, so that a mention as such carries no weight.
Words of the data that say nothing of toxicity are exchanged in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, table

_WORD = re.compile(r"\w+")
#: Words that name groups, set by set and language by language: one is exchanged for another of its set.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"), ("transgender", "trans", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "hispanic"), ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"), ("old", "young", "elderly"), ("blind", "deaf", "disabled"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "junge"), ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"), ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("einwanderer", "einheimische", "flüchtlinge", "ausländer"), ("blinde", "gehörlose", "behinderte"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niña", "niño"), ("gais", "lesbianas", "bisexuales", "heterosexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"), ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("inmigrantes", "nativos", "refugiados", "extranjeros"), ("ciegos", "sordos", "discapacitados"),
    ("femmes", "hommes"), ("femme", "homme"), ("fille", "garçon"), ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"), ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("immigrés", "autochtones", "réfugiés", "étrangers"), ("aveugles", "sourds", "handicapés"),
)
CACHE_WORDS = 600_000


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}"] + [word[:k] for k in range(3, min(8, len(word)))]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def swapped(found: set[str], terms: Sequence[Sequence[str]]) -> set[str] | None:
    """The words with each group term exchanged for the next of its set; None without any."""
    to = {t: s[(i + 1) % len(s)] for s in terms for i, t in enumerate(s)}
    if found.isdisjoint(to):
        return None
    return {to.get(w, w) for w in found}


def bare(found: set[str], terms: Sequence[Sequence[str]]) -> set[str]:
    """The words without group terms."""
    return found - {t for s in terms for t in s}


def _features(text: pd.Series) -> pd.Series:
    return pd.Series([sorted({f for w in text_words(t) for f in word_features(w)}) for t in text])


_features.__annotations__ = {"text": pd.Series, "return": pd.Series}


def select_features(sample: DataFrame, min_rows: int, min_z: float, max_features: int) -> list[str]:
    """Features whose share among toxic rows differs from that among others by ``min_z`` standard errors."""
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("y")).first()
    n, y = int(total["n"]), int(total["y"])
    if not y or y == n:
        return []
    each = sample.select("label", F.explode(F.pandas_udf(_features, "array<string>")("text")).alias("f"))
    by = each.groupBy("f").agg(F.count("*").alias("m"), F.sum("label").alias("t")).filter(F.col("m") >= min_rows)
    share = F.col("m") / n
    se = F.sqrt(share * (1 - share) * (1.0 / y + 1.0 / (n - y)))
    z = (F.col("t") / y - (F.col("m") - F.col("t")) / (n - y)) / F.nullif(se, F.lit(0.0))
    top = by.withColumn("z", z).filter(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "f").limit(max_features)
    return [r["f"] for r in top.select("f").collect()]


def neutral_sets(sample: DataFrame, most: int = 64, share: float = 0.01, max_z: float = 1.0) -> list[tuple[str, ...]]:
    """Sets of words of the data that say nothing of toxicity, to be exchanged like names of groups.

    The rule: words of four characters or more that at least ``share`` of the labelled rows
    hold and whose share among toxic rows is within ``max_z`` standard errors of that
    among others; the ``most`` most frequent, ties in the order of words, in fours.
    """
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("y")).first()
    n, y = int(total["n"]), int(total["y"])
    if not y or y == n:
        return []
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w{4,}"), F.lit(0)))
    by = sample.select("label", F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("m"), F.sum("label").alias("t"))
    rate = F.col("m") / n
    se = F.sqrt(rate * (1 - rate) * (1.0 / y + 1.0 / (n - y)))
    even = by.filter((F.col("m") >= share * n) & (F.abs(F.col("t") / y - (F.col("m") - F.col("t")) / (n - y)) <= max_z * se))
    words = [r["w"] for r in even.orderBy(F.desc("m"), "w").limit(most).collect()]
    return [tuple(words[i : i + 4]) for i in range(0, len(words) - 1, 4) if len(words[i : i + 4]) > 1]


class Classifier:
    """Weights by feature; broadcast to the tasks that score. ``n_pairs`` is how many
    texts of the fit had twins: by terms that name groups, and by neutral words of the data."""

    def __init__(self, weights: dict[str, float], bias: float, n_pairs: tuple[int, int] = (0, 0)):
        self.weights, self.bias, self.n_pairs = weights, bias, n_pairs
        self._known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.bias, self.n_pairs

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias, self.n_pairs = state
        self._known = {}

    def scores(self, texts: pd.Series) -> pd.Series:
        cache = self._known
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            hits: set[str] = set()
            for w in text_words(t):
                f = cache.get(w)
                if f is None:
                    f = tuple(x for x in word_features(w) if x in self.weights)
                    if len(cache) < CACHE_WORDS:
                        cache[w] = f
                if f:
                    hits.update(f)
            out[i] = self.bias + sum(self.weights[x] for x in sorted(hits))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))


def fit(
    labelled: DataFrame,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    max_rows: int = 20_000,
    min_rows: int = 4,
    min_z: float = 4.0,
    max_features: int = 4096,
    counterfactual: float = 5.0,
    l1: float = 1e-4,
    l2: float = 1e-4,
    steps: int = 1000,
) -> Classifier:
    """Fit on ``labelled`` (doc_id, text, label 0 or 1).

    At most ``max_rows`` rows, the first in the order of a hash of doc_id, are used: that
    bounds what reaches the driver, with ``max_features`` and the features per row.
    Proximal gradient on the logistic loss, the squared differences of logits of a text and
    its twins (weight ``counterfactual``), l2 and l1. Twins come from ``terms`` and from
    ``neutral_sets`` of the data, so that the penalty acts on data without names of groups,
    too. Without rows of both labels the score is the share of toxic rows (0.5 of none).

    Null labels are left out; null and empty texts have no features; a row that repeats
    counts as often as it is there; other columns are not read; whole texts of any length
    are used; an empty table gives a model that scores 0.5.
    """
    every = labelled.filter("label is not null").select("doc_id", "text", "label").cache()
    sample = drawn(every, "doc_id", max_rows).cache()  # the limit gathers the rows in one task, which their number bounds
    names = select_features(sample, min_rows, min_z, max_features)
    taken = {t for s in terms for t in s}
    even = [s for s in (tuple(w for w in s if w not in taken) for s in neutral_sets(sample)) if len(s) > 1] if counterfactual else []
    groups = sorted(taken | {t for s in even for t in s})
    neutral_to = {w: s[(i + 1) % len(s)] for s in even for i, w in enumerate(s)}
    neutral = set(neutral_to)
    index = {f: i for i, f in enumerate(dict.fromkeys([*names, *(f for t in groups for f in word_features(t))]))}

    def rows(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = text_words(t)
            ids = lambda ws: {index[f] for w in ws for f in word_features(w) if f in index}
            own = ids(found)
            # Of each twin, the features that it loses and gains.
            one = min(found & neutral, default=None)  # of the neutral words one, as a text may hold many
            pairs = [(swapped(found, terms), bare(found, terms)), one and ({w for w in found if w != one} | {neutral_to[one]}, found - {one})]
            twins = [None if not p or p[0] is None else [own - ids(x) for x in p] + [ids(x) - own for x in p] for p in pairs]
            out.append([sorted(own), *([None] * 4 if x is None else [sorted(v) for v in x] for x in twins)])
        return pd.DataFrame([[r[0], *r[1], *r[2]] for r in out], columns=_COLUMNS)

    rows.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    shape = ", ".join(f"{c} array<int>" for c in _COLUMNS)
    got = sample.select("label", F.pandas_udf(rows, shape)("text").alias("x")).select("label", "x.*").collect()
    sample.unpersist()
    every.unpersist()
    if not got:
        return Classifier({}, 0.0)
    y = np.array([float(r["label"]) for r in got])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w, b = np.zeros(len(index)), float(np.log(share / (1 - share)))
    n_pairs = (sum(r["g_lost_1"] is not None for r in got), sum(r["e_lost_1"] is not None for r in got))
    if 0 < y.sum() < len(y):
        at = np.concatenate([np.full(len(r["own"]), i) for i, r in enumerate(got)]).astype(int)
        col = np.concatenate([np.array(r["own"], dtype=int) for r in got])
        pairs = [(r[f"{k}_lost_{i}"], r[f"{k}_gained_{i}"]) for r in got for k in "ge" for i in (1, 2) if r[f"{k}_lost_{i}"] is not None]
        signed = [(k, j, s) for k, (p, q) in enumerate(pairs) for s, x in ((1.0, p), (-1.0, q)) for j in x]
        pk, pj, ps = (np.array(c) for c in zip(*signed)) if signed else (np.empty(0, int), np.empty(0, int), np.empty(0))
        pk, pj = pk.astype(int), pj.astype(int)
        n, m = len(y), max(1, len(pairs))
        # Balanced classes: toxic rows are few.
        cost = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
        b = 0.0
        v, d = w.copy(), b
        # The curvature of loss and penalty, by power iteration.
        u, e, bound = np.random.default_rng(1).standard_normal(len(w)), 1.0, 1.0
        for _ in range(40):
            size = np.sqrt(u @ u + e * e) or 1.0
            u, e = u / size, e / size
            z = 0.25 * cost * (e + np.bincount(at, weights=u[col], minlength=n))
            gap = np.bincount(pk, weights=ps * u[pj], minlength=m)
            u = np.bincount(col, weights=z[at], minlength=len(w)) + 2 * counterfactual / m * np.bincount(pj, weights=ps * gap[pk], minlength=len(w)) + l2 * u
            e = z.sum()
            bound = np.sqrt(u @ u + e * e)
        bound = 1.2 * bound + l2
        t = 1.0
        for _ in range(steps):
            z = d + np.bincount(at, weights=v[col], minlength=n)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * cost
            grad = np.bincount(col, weights=g[at], minlength=len(w)) + l2 * v
            if len(pk):
                gap = np.bincount(pk, weights=ps * v[pj], minlength=m)
                grad += 2 * counterfactual / m * np.bincount(pj, weights=ps * gap[pk], minlength=len(w))
            new = v - grad / bound
            new = np.sign(new) * np.maximum(0, np.abs(new) - l1 / bound)
            nb = d - g.sum() / bound
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, d = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
            w, b, t = new, nb, t2
    return Classifier({f: float(w[i]) for f, i in index.items() if w[i]}, b, n_pairs)


#: Features of a text, and those that its two twins by terms (g) and by neutral words (e) lose and gain.
_COLUMNS = ["own", "g_lost_1", "g_lost_2", "g_gained_1", "g_gained_2", "e_lost_1", "e_lost_2", "e_gained_1", "e_gained_2"]


def score(docs: DataFrame, model: Classifier, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of toxic in ``out_col`` (replaced if it is there).

    Whole texts are scored, row by row; null and empty texts get the score of a text
    without features; repeated rows get equal scores; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield shared.value.scores(b)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out_col, F.pandas_udf(run, "double")(F.col(text_col)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0)
    labels = table(spark, sf_dir, "labels").filter(~held).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    max_rows = 20_000
    # The sample is drawn from the labels, so that the texts join with a bounded table.
    some = drawn(labels.filter("label is not null"), "doc_id", max_rows)
    model = fit(docs.join(F.broadcast(some), "doc_id"), max_rows=max_rows)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
