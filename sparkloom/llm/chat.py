"""Transcript parsing by a hidden Markov model.

A transcript is a sequence of parts (texts in order). The hidden state of a line is its
speaker's role; a line shows its speaker marker, if any, whether it begins a paragraph,
whether it asks, and its length. Start, transition and emission probabilities are
counted over labelled parts in Spark; Viterbi recovers the roles of unlabelled ones, and
runs of one role are rendered as canonical turns, part by part.

Viterbi is a product of matrices over (max, +), so it splits anywhere: each part has a
matrix of the best score for every role before it and at its end, worked out where the
part lies. Conversations are cut into spans of ``PARTS`` part numbers whose products are
worked out apart, and these into spans again, so no task holds more of one conversation
than the matrices of a span.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

ROLES = ("assistant", "system", "user")
PARTS = 1024
_START = len(ROLES)
# A word with a colon, or a word in brackets; in front of either there may be marks of emphasis or quotation.
_MARK = re.compile(
    r"^\s*(?:[>*#_]+\s*)*(?:[\[(<|]+\s*(user|human|customer|client|assistant|ai|bot|agent|support|system|sys)\s*[|\])>]+(?:\s*[*_]*:)?"
    r"|(user|human|customer|client|q|question|me|you|assistant|ai|bot|model|agent|support|a|answer|gpt|system|sys|instruction|instructions)\s*(?:[*_]+\s*)*:)[*_\s]*",
    re.I,
)


def observe(line: str) -> tuple[str, str]:
    """(what the line shows, its text without what may be a marker)."""
    m = _MARK.match(line)
    rest = line[m.end() :] if m else line
    shown = f"{(m[1] or m[2]).lower() if m else ''}|{int(rest.rstrip().endswith('?'))}|{min(5, len(rest) // 80)}"
    return shown, rest


class Line(NamedTuple):
    """A line that is not blank: ``first`` of its part or after a blank one, ``gap`` the blank lines before it, each with its end."""

    text: str
    rest: str
    first: bool
    gap: str


def lines_of(text: str | None) -> list[tuple[str, int, Line]]:
    """(what it shows, whether it begins a paragraph, itself) of each line that is not blank; one with a marker begins one."""
    out, first, gap = [], True, ""
    for line in (text or "").split("\n"):
        if not line.strip():
            first, gap = True, f"{gap}{line}\n"
            continue
        shown, rest = observe(line)
        out.append((shown, int(first or rest is not line), Line(line, rest, first, gap)))
        first, gap = False, ""
    return out


def _after(text: str) -> str:
    """The blank lines at the end of a text, with what ends the line before them."""
    lines = text.split("\n")
    n = next((i for i, x in enumerate(reversed(lines)) if x.strip()), len(lines))
    return "".join(f"\n{x}" for x in lines[len(lines) - n :])


class Model:
    """Log probabilities; smoothed, so that nothing is impossible."""

    def __init__(self, emissions: dict[tuple[str, str], int], moves: dict[tuple[str, str, int], int], smooth: float = 0.5):
        k = len(ROLES)
        shown = sorted({o for _, o in emissions})
        self.move = np.zeros((2, k + 1, k))
        for p in range(2):
            for i, a in enumerate((*ROLES, "")):
                n = np.array([moves.get((a, b, p), 0) + smooth for b in ROLES])
                self.move[p, i] = np.log(n / n.sum())
        self.shown, self.marks = {}, {}
        total = np.array([sum(n for (r, _), n in emissions.items() if r == b) for b in ROLES]) + smooth * (len(shown) + 1)
        for o in shown:
            self.shown[o] = np.log((np.array([emissions.get((b, o), 0) for b in ROLES]) + smooth) / total)
        for word in {o.split("|")[0] for o in shown}:
            n = np.array([sum(emissions.get((b, o), 0) for o in shown if o.split("|")[0] == word) for b in ROLES]) + smooth
            self.marks[word] = np.log(n / total) - 3
        self.other = np.full(k, -10.0)  # what was never seen tells nothing

    def marks_role(self, shown: str) -> int | None:
        """The role that a line's marker stands for, if training has seen it as one."""
        word = shown.split("|")[0]
        return int(self.marks[word].argmax()) if word and word in self.marks else None

    def emit(self, shown: str) -> np.ndarray:
        got = self.shown.get(shown)
        return got if got is not None else self.marks.get(shown.split("|")[0], self.other)

    def matrix(self, lines: list[tuple[str, int, str]]) -> np.ndarray:
        """Best score from the role before (or the start) to the role of the last line."""
        k = len(ROLES)
        m = np.full((k + 1, k + 1), -np.inf)
        np.fill_diagonal(m, 0)
        for shown, p, _ in lines:
            step = self.move[p] + self.emit(shown)
            m[:, :k] = (m[:, :, None] + step[None]).max(1)
            m[:, k] = -np.inf
        return m

    def decode(self, lines: list[tuple[str, int, str]], before: int, after: int) -> list[int]:
        """Roles of the lines, the last of them ``after``; ties to the first role in order."""
        k = len(ROLES)
        v = np.full(k + 1, -np.inf)
        v[before] = 0
        back = []
        for shown, p, _ in lines:
            scores = v[:, None] + self.move[p] + self.emit(shown)
            back.append(scores.argmax(0))
            v = np.append(scores.max(0), -np.inf)
        out = [after] if lines else []
        for b in back[:0:-1]:
            out.append(int(b[out[-1]]))
        return out[::-1]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(1)


def _states(mats: list[np.ndarray], before: int, after: int | None) -> list[int]:
    """Roles at the ends of a sequence of matrices, given those around it."""
    v = np.full(_START + 1, -np.inf)
    v[before] = 0
    back = []
    for m in mats:
        s = v[:, None] + m
        back.append(s.argmax(0))
        v = s.max(0)
    out = [int(v.argmax()) if after is None else after]
    for b in back[:0:-1]:
        out.append(int(b[out[-1]]))
    return out[::-1]


def _square(flat: np.ndarray) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, _START + 1, _START + 1)


def _product(flat: pd.Series) -> pd.Series:
    """Of each row's matrices."""
    return pd.Series([reduce(_times, _square(m)).ravel() for m in flat])


def _around(flat: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """Roles at the ends of each row's matrices; without ``after``, the best last role."""
    return pd.Series([_states(list(_square(m)), int(b), None if pd.isna(a) else int(a)) for m, b, a in zip(flat, before, after)])


_product.__annotations__ = {"flat": pd.Series, "return": pd.Series}
_around.__annotations__ = {"flat": pd.Series, "before": pd.Series, "after": pd.Series, "return": pd.Series}


def train(labelled: DataFrame) -> Model:
    """Count over ``labelled`` (conv, part, text, role): every row counts, and what reaches
    the driver are counts by role and observation, whose number does not grow."""
    def facts(text: pd.Series) -> pd.Series:
        return pd.Series([[{"o": o, "p": p} for o, p, _ in lines_of(t)] for t in text])

    facts.__annotations__ = {"text": pd.Series, "return": pd.Series}
    rows = labelled.filter(F.col("role").isin(*ROLES)).withColumn("f", F.pandas_udf(facts, "array<struct<o:string,p:int>>")("text")).filter(F.size("f") > 0)
    # Parts without a conversation stand alone, so they do not meet in one window.
    alone = F.when(F.col("conv").isNull(), F.xxhash64("part", "text"))
    order = W.partitionBy("conv", alone, F.floor(F.col("part") / PARTS)).orderBy("part")
    rows = rows.select("role", "f", F.coalesce(F.lag("role").over(order), F.lit("")).alias("was"))
    emitted = rows.select("role", F.explode("f.o").alias("o")).groupBy("role", "o").count().collect()
    each = rows.select("role", "was", F.posexplode("f.p").alias("i", "p"))
    moved = each.groupBy(F.when(F.col("i") == 0, F.col("was")).otherwise(F.col("role")).alias("was"), "role", "p").count().collect()
    return Model({(r["role"], r["o"]): r["count"] for r in emitted}, {(r["was"], r["role"], r["p"]): r["count"] for r in moved})


def _ends(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, _k, at, _t, m) as (conv, _k, at, _t, before, after): the roles around each matrix.

    Where a conversation has several spans, the products of the spans go through the same
    step first, so no row holds more than the matrices of one span at any level.
    """
    span = F.floor(F.coalesce("at", F.lit(0)) / PARTS).alias("span")
    each = F.array_sort(F.collect_list(F.struct("at", "_t", "m"))).alias("p")
    spans = rows.groupBy("conv", "_k", span).agg(each)
    spans = stored(spans.select("conv", "_k", "span", "p.at", "p._t", F.flatten("p.m").alias("m")), "spans")
    counts = spans.groupBy("conv", "_k").agg(F.min("span").alias("a"), F.max("span").alias("b"))
    if counts.filter("a < b").isEmpty():
        known = spans.withColumn("before", F.lit(_START)).withColumn("after", F.lit(None).cast("int"))
    else:
        tops = spans.select("conv", "_k", F.col("span").alias("at"), F.lit(0).cast("long").alias("_t"), F.pandas_udf(_product, "array<double>")("m").alias("m"))
        same = F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x._k") == F.col("y._k")) & (F.col("x.span") == F.col("y.at"))
        known = spans.alias("x").join(_ends(tops).alias("y"), same).select("x.*", "y.before", "y.after")
    after = F.pandas_udf(_around, "array<int>")("m", "before", "after")
    zipped = known.select("conv", "_k", "at", "_t", "before", after.alias("after"))
    before = F.concat(F.array("before"), F.slice("after", 1, F.size("after") - 1)).alias("before")
    return zipped.select("conv", "_k", F.explode(F.arrays_zip("at", "_t", before, "after")).alias("e")).select("conv", "_k", "e.*")


def recover_roles(parts: DataFrame, model: Model) -> DataFrame:
    """``parts`` (conv, part, text) with follows, the role before the part (null at the start
    of a conversation), and turns: array of (role, text, lines) in order.

    Rows equal in all three are one part; parts that share a number come in the order of
    a hash of the text. Null and empty texts have no turns; a part without conv is a
    conversation of its own, and a null part comes first; very long texts are parsed
    whole, line by line, in the task that holds them; an empty table stays empty. Other
    columns are left out, so their names cannot clash. No text is lost but markers, each
    where a turn of its role begins, and blank lines before such a marker.
    """
    shared = parts.sparkSession.sparkContext.broadcast(model)
    df = parts.select("conv", "part", "text").withColumn("_t", F.xxhash64(F.coalesce("text", F.lit("\x00null")))).dropDuplicates(["conv", "part", "_t"])
    df = df.withColumn("_k", F.when(F.col("conv").isNull(), F.xxhash64("part", "_t")).otherwise(F.lit(0)))

    def matrix(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.matrix(lines_of(t)).ravel() for t in text])

    matrix.__annotations__ = {"text": pd.Series, "return": pd.Series}
    slim = df.select("conv", "_k", F.col("part").alias("at"), "_t", F.pandas_udf(matrix, "array<double>")("text").alias("m"))
    found = _ends(slim)

    def turns(text: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for t, b, a in zip(text, before, after):
            lines, was = lines_of(t), int(b)
            made: list[dict] = []
            for role, (shown, _, line) in zip(shared.value.decode(lines, was, int(a)) if lines else [], lines):
                # What looks like a marker is one where a turn of its role begins; else it belongs to the text.
                marked = shared.value.marks_role(shown) == role and (line.first or role != was)
                said = line.rest if marked else line.text
                if made and made[-1]["role"] == ROLES[role]:
                    made[-1]["text"] += "\n" + line.gap + said
                    made[-1]["lines"] += 1
                else:
                    if made and line.gap and not marked:
                        made[-1]["text"] += "\n" + line.gap[:-1]
                    made.append({"role": ROLES[role], "text": said if made else line.gap + said, "lines": 1})
                was = role
            if made:
                made[-1]["text"] += _after(t)
            out.append(made)
        return pd.Series(out)

    turns.__annotations__ = {"text": pd.Series, "before": pd.Series, "after": pd.Series, "return": pd.Series}
    on = F.col("x.conv").eqNullSafe(F.col("y.conv")) & (F.col("x._k") == F.col("y._k")) & F.col("x.part").eqNullSafe(F.col("y.at")) & (F.col("x._t") == F.col("y._t"))
    both = df.alias("x").join(found.alias("y"), on).select("x.conv", "x.part", "x.text", "y.before", "y.after")
    made = F.pandas_udf(turns, "array<struct<role:string,text:string,lines:int>>")("text", "before", "after")
    follows = F.get(F.array(*map(F.lit, ROLES)), F.col("before"))
    return both.select("conv", "part", "text", follows.alias("follows"), made.alias("turns"))


def render(parsed: DataFrame, *others: str) -> DataFrame:
    """One row per part: n_turns that begin in it, n_lines, and chat, its piece of the
    conversation's canonical form.

    The pieces of a conversation in order, put together without anything between them,
    are its turns as ``<|role|>`` and the text after it; neighbouring turns of one role
    are one turn, across parts too. What came before is in ``follows``, so no row moves
    and no conversation has to fit one row. ``others`` are columns to keep.
    """
    begins = lambda x, i: (i > 0) | F.col("follows").isNull() | (F.col("follows") != x["role"])
    said = F.transform("turns", lambda x, i: F.concat(
        F.when((i > 0) | F.col("follows").isNotNull(), "\n").otherwise(""),
        F.when(begins(x, i), F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(""), x["text"],
    ))
    return parsed.select(
        "conv", "part", F.size(F.filter("turns", begins)).cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["lines"]).alias("n_lines"), F.array_join(said, "").alias("chat"), *others,
    )


#: How transcripts of a conversation mark its speakers, by conversation: role by role, in the order of ROLES.
STYLES = (("Assistant: ", "System: ", "User: "), ("AI: ", "System: ", "Human: "), ("A: ", "[system]: ", "Q: "), ("**Bot:** ", "**Sys:** ", "**Customer:** "))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Transcript parts of a conversations table: markers instead of roles, and one turn in five without."""
    style = F.pmod(F.col("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, marks in enumerate(STYLES):
        for role, m in zip(ROLES, marks):
            mark = F.when((style == i) & (F.col("role") == role), F.lit(m)).otherwise(mark)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    text = F.when(F.col("text").isNotNull(), F.concat(F.when(bare, F.lit("")).otherwise(mark), "text"))
    return conversations.select(F.col("conv_id").alias("conv"), F.col("turn").alias("part"), text.alias("text"), "role")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part of a conversation: whether its role was held out from training (conv_id a
    multiple of five), turns begun, lines, lines whose recovered role is the true one, and
    its piece of the chat."""
    parts = transcripts(table(spark, sf_dir, "conversations"))
    held_out = F.coalesce(F.pmod(F.col("conv"), F.lit(5)) == 0, F.lit(False))
    parsed = recover_roles(parts, train(parts.filter(~held_out)))
    truth = parts.groupBy("conv", "part").agg(F.max("role").alias("role"))
    same = F.col("p.conv").eqNullSafe(F.col("r.conv")) & F.col("p.part").eqNullSafe(F.col("r.part"))
    right = F.aggregate("p.turns", F.lit(0).cast("long"), lambda a, x: a + F.when(x["role"] == F.col("r.role"), x["lines"]).otherwise(0))
    pieces = render(parsed.alias("p").join(truth.alias("r"), same, "left").select("p.*", right.alias("n_right")), "n_right")
    return pieces.select(F.col("conv").alias("conv_id"), F.col("part").alias("turn"), held_out.alias("held_out"), "n_turns", "n_lines", "n_right", "chat")
