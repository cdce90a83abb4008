"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumetrics.llm.common import free_name

# Look-alike letters of other scripts, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝвкмнтАЕОРСУХІЈЅВКМНТαεορυικντΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aeopcyxijsdhqwbkmhtaeopcyxijsbkmhtaeopuikvtabezhikmnoptyx"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
# Common abuse in several languages: known before anything is learned, which small label sets need.
SEEDS = (
    "asshole", "bastard", "bitch", "clown", "cretin", "degenerate", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile",
    "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
    "arschloch", "dummkopf", "trottel", "connard", "crétin", "salaud", "cabrón", "imbécil", "pendejo",
)
SEED_WEIGHT = 2.0
# In these phrases the terms mean no harm.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "stupid simple")
TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
FOREIGN = re.compile("[" + "".join(map(chr, TABLE)) + "]")
WRITTEN = re.compile(r"(?:(?<=[^\W\d_])|(?<![^\s]))[0134578@$!|]+(?=[^\W\d_])")
# Further readings of a folded text: signs at the head of a word behind any other sign, and at its end, there without
# or with exclamation marks, which mostly are punctuation.
HEAD = re.compile(r"(?<!\w)(?<![0134578@$!|])[0134578@$!|]+(?=[^\W\d_])")
ENDS = (re.compile(r"(?<=[^\W\d_])[0134578@$!|]*[0134578@$|](?=!*(?![\w@$|!]))"),
        re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?![\w@$|])"))
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
TOXIC_SAMPLE, CLEAN_SAMPLE, TERMS = 2000, 4000, 2000
LEAST_RATIO, LEAST_EVIDENCE = 8.0, 20.0


class Lexicon(NamedTuple):
    """terms: word or stem (with a final ``*``) -> weight; the score is logistic(intercept + slope * strength)."""

    terms: dict[str, float]
    intercept: float
    slope: float


def folded(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs before a letter (in or at the head of a word) as letters."""
    text = text.lower()
    if not text.isascii() and FOREIGN.search(text):
        text = text.translate(TABLE).lower()
    return WRITTEN.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)


def readings(text: str) -> list[str]:
    """The folded text, and different texts of its length with signs folded at heads behind signs and at ends of words."""
    first = folded(text)
    letters = lambda m: "".join(DIGITS[c] for c in m[0])
    headed = HEAD.sub(letters, first)
    return list(dict.fromkeys([first, headed, *(end.sub(letters, headed) for end in ENDS)]))


def features(text: str) -> set[str]:
    """Different words of a folded text, and their stems."""
    words = set(WORD.findall(folded(text)))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Matcher:
    """Strength of a text: weights of the terms found outside exception phrases, over the logarithm of its length."""

    def __init__(self, terms: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        known: dict[str, list] = {}
        for term, weight in terms.items():
            known.setdefault(term.rstrip("*"), []).append((term.endswith("*"), weight))
        for phrase in exceptions:
            known.setdefault(folded(phrase), []).append((None, 0.0))
        for word, kinds in known.items():
            if word:
                self.automaton.add_word(word, (len(word), kinds))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[float, int]:
        """(strength, number of hits)."""
        if not text or self.empty:
            return 0.0, 0
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for text in [f" {t} " for t in readings(text)]:
            for end, (size, kinds) in self.automaton.iter(text):
                start = end - size + 1
                if text[start - 1].isalpha():
                    continue
                whole = not text[end + 1].isalpha()
                for stem, weight in kinds:
                    if stem is None:
                        if whole:
                            spared.append((start, end))
                    elif (stem or whole) and weight > best.get(start, (0, 0.0))[1]:
                        best[start] = (end, weight)
        spared.sort()
        begins = [x for x, _ in spared]
        # The farthest end of the exceptions that begin up to here.
        ends = list(accumulate((y for _, y in spared), max))

        def free(begin: int, end: int) -> bool:
            at = bisect_right(begins, begin)
            return not at or ends[at - 1] < end

        hits = [w for a, (b, w) in best.items() if free(a, b)]
        return sum(hits) / math.log2(8 + text.count(" ")), len(hits)


def learn(
    docs: DataFrame, labels: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", seeds: Sequence[str] = SEEDS, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, terms: int = TERMS,
) -> Lexicon:
    """Weighted terms and calibration from about ``toxic_sample`` and ``clean_sample`` labelled training documents.

    ``training`` is a condition on ``docs``. The sample is drawn by a hash of id and text, so the bound holds for
    repeated ids too; equal rows count once. The bound makes everything below a fixed amount of work. At most ``terms``
    terms are kept, those with the most evidence. A term is a word or a stem of 4 to 7 letters. It is kept if toxic documents hold it
    at least ``LEAST_RATIO`` times as often as clean ones and the log-likelihood ratio is at least
    ``LEAST_EVIDENCE``; its weight is the logarithm of the smoothed ratio. ``seeds`` are terms from the start; one that
    clean documents of the sample hold as often as toxic ones is dropped. Rows whose label is null are left out, and
    a document labelled twice counts as toxic if any label says so. Without a toxic and a clean document there is
    nothing to calibrate: no terms, and a constant low score.
    """
    marks = labels.filter(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("toxic"))
    whole = 1 << 30
    row = F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("_row")
    rows = docs.filter(training).select(F.col(doc_id).alias("_id"), row, F.col(text).alias("text"))
    known = rows.select("_id", "_row").distinct().join(marks, "_id")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({}, -4.0, 0.0)
    share = F.when(F.col("toxic") == 1, min(whole, whole * toxic_sample // sizes[1] + 1)).otherwise(
        min(whole, whole * clean_sample // sizes[0] + 1))
    # The sample is bounded by the parameters, and so is the set of rows that is sent to every task.
    chosen = known.filter(F.pmod("_row", F.lit(whole)) < share)
    sample = rows.join(F.broadcast(chosen), ["_id", "_row"]).dropDuplicates(["_id", "_row"]).select("toxic", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for part in parts:
            for toxic, body in zip(part["toxic"], part["text"]):
                seen[toxic].update(features(body or ""))
                seen[toxic][""] += 1
        rows = [(t, seen[0][t], seen[1][t]) for t in seen[0].keys() | seen[1].keys()]
        yield pd.DataFrame(rows, columns=["term", "clean", "toxic"])

    counted = sample.mapInPandas(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counted.filter("term = ''").first()
    n0, n1 = totals["clean"], totals["toxic"]
    if not n0 or not n1:
        return Lexicon({}, -4.0, 0.0)
    a, b = F.col("toxic"), F.col("clean")
    ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    mean = (a + b) / (n0 + n1)
    evidence = 2 * (a * F.log(a / (n1 * mean)) + F.when(b > 0, b * F.log(b / (n0 * mean))).otherwise(0.0))
    rows = (
        counted.filter("term <> '' and toxic > 0").withColumns({"ratio": ratio, "evidence": evidence})
        .filter((F.col("ratio") >= LEAST_RATIO) & (F.col("evidence") >= LEAST_EVIDENCE))
        .orderBy(F.desc("evidence"), "term").limit(terms).collect()
    )
    poor = counted.filter(F.col("term").isin(list(seeds)) & (ratio <= 1)).collect()  # at most the seeds
    found = dict.fromkeys(seeds, SEED_WEIGHT) | {r["term"]: math.log(r["ratio"]) for r in rows}
    for row in poor:
        found.pop(row["term"], None)

    def strengths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(found)
        for part in parts:
            yield pd.DataFrame({"x": [match(t or "")[0] for t in part["text"]], "y": part["toxic"]})

    points = sample.mapInPandas(strengths, "x double, y int").collect()  # bounded by the sample
    x = np.array(sorted((r["x"], r["y"]) for r in points)).reshape(-1, 2)
    return Lexicon(found, *calibrate(x[:, 0], x[:, 1]))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope of a logistic regression, both classes weighing the same, by Newton's method."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on), strength and n_hits.

    Null and empty texts have strength 0 and so the score of a text without hits. Every whole text is read, row by
    row, without a shuffle; repeated rows score alike, and an empty table stays empty. Columns named like the new
    ones are replaced.
    """
    terms, intercept, slope = lexicon

    @F.pandas_udf("strength double, n_hits int")
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms, exceptions)
        for part in parts:
            yield pd.DataFrame([matcher(t or "") for t in part], columns=["strength", "n_hits"])

    own = free_name(docs, "_found")
    found = docs.withColumn(own, match(F.col(text)))
    value = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col(f"{own}.strength"))))
    return found.withColumns({
        "score": value, "predicted": (value >= 0.5).cast("int"), "strength": F.col(f"{own}.strength"),
        "n_hits": F.col(f"{own}.n_hits"),
    }).drop(own)
