"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, read, ship, unused

# Look-alike letters and the digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
    **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
    **{c: None for c in "­​‌‍⁠﻿"},
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

EXCEPTIONS = ("scunthorpe", "trash can", "trash bin", "trash collection", "class clown fish", "clownfish")
ROWS = 20_000  # labelled rows at most that the model is fitted on
SUPPORT, LEAST = 4, 2.0  # toxic rows with a term, and its log odds ratio, at least

_TABLE = str.maketrans(HOMOGLYPHS)
_SIGN = re.compile(r"(?<=[^\W\d_])[0134578@$!](?=[^\W_])|(?<![\w@$!])[0134578@$](?=[^\W\d_]{2})")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes to Latin letters, invisible characters out, digits and signs inside or at the head of words to
    the letters they stand for (over and over, as b4574rd needs)."""
    out = text.lower().translate(_TABLE)
    for _ in range(3):
        new = _SIGN.sub(lambda m: DIGITS[m[0]], out)
        if new == out:
            break
        out = new
    return out


def stems(folded: str) -> set[str]:
    """The distinct words with a closing blank, and their heads of 4 to 8 letters, as candidate terms."""
    words = set(_WORD.findall(folded))
    return {w + " " for w in words if len(w) > 2} | {w[:k] for w in words for k in range(4, min(8, len(w)) + 1)}


@dataclass
class Lexicon:
    """terms: head of a word (or a whole word, with a closing blank) -> weight; exceptions: phrases in
    which terms do not count; slope, scale, bias: score = 1 / (1 + exp(-(bias + slope * hits + scale * share)))."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    scale: float = 1.0
    bias: float = -3.0
    _machine: object = field(default=None, repr=False)

    def machine(self):
        if self._machine is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for e in self.exceptions:
                if e not in self.terms:
                    a.add_word(e, (len(e), None))
            if len(a):
                a.make_automaton()
            self._machine = a
        return self._machine

    def features(self, text: str) -> tuple[float, float]:
        """Weight of what matches, and its share by length: log(1 + sum), log(1 + 100 * sum / words).
        A word counts its heaviest term once; a match inside an exception phrase does not count."""
        folded = fold(text)
        a = self.machine()
        if not len(a):
            return 0.0, 0.0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        plain = f"{_BREAK.sub(' ', folded)} "
        for end, (n, w) in a.iter(plain):
            at = end - n + 1
            if at and plain[at - 1].isalpha():
                continue
            if w is None:
                spared.append((at, end))
            elif w > best.get(at, 0):
                best[at] = w
        total, last, k = 0.0, -1, 0  # phrases by start; `last` is where those that have begun end at the latest
        spared.sort()
        for at in sorted(best):
            while k < len(spared) and spared[k][0] <= at:
                last, k = max(last, spared[k][1]), k + 1
            total += best[at] if at > last else 0.0
        return math.log1p(total), math.log1p(100 * total / max(1, plain.count(" ")))

    def score(self, text: str | None) -> float:
        x, y = self.features(text or "")
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * x + self.scale * y))))

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}


_BREAK = re.compile(r"[^\w]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """text, toxic of at most `rows` labelled documents that are not held out, the first by hash of the id.
    Rows with a null label or id are left out; where an id's labels differ the larger one holds, and of the texts under one id
    the smallest, so that an id repeated any number of times is one row."""
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a top-k, at most `rows` rows
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Lexicon:
    """Fit the lexicon on at most `rows` labelled rows, which is its only bound: every term with enough support is looked at, and
    every telling one is an entry.

    Terms of toxic rows with enough support are counted in all training rows; those whose log odds ratio
    reaches LEAST get it as weight. A longer head goes when a shorter one is as telling. Words that start with a term but lean the
    other way become exceptions. The three numbers of the score come from logistic regression on the two
    features. Without toxic training rows the lexicon is empty and every score is the same low one.
    """
    ship(docs.sparkSession)
    data = training(docs, labels, rows).repartition(32).cache()

    def counts(only: frozenset[str] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = {0: Counter(), 1: Counter()}
            for batch in batches:
                for text, y in zip(batch["text"], batch["toxic"], strict=True):
                    if only is not None or y:
                        s = stems(fold(text))
                        seen[int(y > 0)].update(s if only is None else s & only)
            every = seen[0].keys() | seen[1].keys()
            if every:
                yield pd.DataFrame({"term": list(every), "pos": [seen[1][t] for t in every], "neg": [seen[0][t] for t in every]}).astype({"pos": "int64", "neg": "int64"})

        return data.mapInPandas(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    n_pos, n_neg = data.where("toxic > 0").count(), data.where("toxic <= 0").count()
    common = counts(None).where(F.col("pos") >= SUPPORT)
    counted = counts(frozenset(r["term"] for r in common.select("term").collect())).collect() if n_pos else []

    def odds(pos: int, neg: int) -> float:
        return math.log((pos + 0.5) / (n_pos - pos + 0.5)) - math.log((neg + 0.5) / (n_neg - neg + 0.5))

    telling = {r["term"]: (odds(r["pos"], r["neg"]), r["pos"], r["neg"]) for r in counted}
    ranked = sorted((t for t, (w, p, n) in telling.items() if w >= LEAST and p >= 3 * n), key=lambda t: (-telling[t][1], len(t), t))
    kept: dict[str, float] = {}
    for t in ranked:
        heads = [t[:k] for k in range(4, min(len(t), 9)) if t[:k] in kept]
        if not any(kept[h] >= telling[t][0] - 0.5 for h in heads):
            kept[t] = telling[t][0]
    spared = tuple(sorted(t for t, (w, _, n) in telling.items() if w < 0 and n >= 5 and t.endswith(" ") and any(t.startswith(k) and k != t for k in kept)))
    lexicon = Lexicon(kept, EXCEPTIONS + spared)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [lexicon.features(t) for t in batch["text"]]
            yield pd.DataFrame({"x": [g[0] for g in got], "y": [g[1] for g in got], "toxic": (batch["toxic"] > 0).astype("int32")})

    if n_pos and n_neg:
        fitted = data.mapInPandas(measure, "x double, y double, toxic int").toPandas()  # at most `rows` rows of three numbers
        lexicon.bias, lexicon.slope, lexicon.scale = logistic(fitted[["x", "y"]].to_numpy(), fitted["toxic"].to_numpy())
    data.unpersist()
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[float, ...]:
    """Bias and weights by Newton's method."""
    a = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def scored(docs: DataFrame, lexicon: Lexicon, out: str = "score") -> DataFrame:
    """docs with the column `out` (0 to 1), in place of one of that name, of each whole text; a null text scores as an empty one. The lexicon comes from
    a bounded number of rows, so it travels with the tasks."""
    ship(docs.sparkSession)
    rows = carried(docs.drop(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            score = pa.array([lexicon.score(t.as_py()) for t in pc.struct_field(row, "text")], pa.float64())
            yield pa.RecordBatch.from_arrays([score, row], names=["score", "row"])

    got = rows.mapInArrow(run, T.StructType([T.StructField("score", T.DoubleType()), *rows.schema.fields]))
    return got.select(F.col("score").alias(out), *[F.col("row").getField(c).alias(c) for c in docs.columns if c.casefold() != out.casefold()])


def reject_toxic(docs: DataFrame, lexicon: Lexicon, from_score: float = 0.7) -> DataFrame:
    """docs without those that score `from_score` or more, all columns, whatever their names. Null and empty texts score
    low and stay; repeated rows are judged each."""
    name = unused(docs, "score")
    return scored(docs, lexicon, name).where(F.col(name) < from_score).drop(name)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = learn(docs, read(spark, sf_dir, "labels"))
    return scored(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
