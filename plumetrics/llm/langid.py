"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumetrics.llm.common import free_name


PROFILE = 400
SAMPLE_PER_LANGUAGE = 2000
LONGEST = 3
UNKNOWN = "und"


def grams(text: str, letters: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of the lower-cased letters of ``text``; every run of other characters is one blank.

    An n-gram is the number with its code points as digits of base 2^21 (so n is at most 3). Blanks stand around
    every word; n-grams of the blank alone or with a blank inside are left out.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(letters[points], points, 32)
    padded = np.concatenate(([32], points, [32]))
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    padded = padded[keep]
    blank = padded == 32
    parts = [padded[~blank]]
    code = padded
    for n in range(2, longest + 1):
        if len(padded) < n:
            break
        code = (code[:-1] << 21) | padded[n - 1:]
        inner = np.zeros(len(code), bool)
        for at in range(1, n - 1):
            inner |= blank[at: at + len(code)]
        parts.append(code[~inner])
    return np.unique(np.concatenate(parts), return_counts=True)


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def learn(
    docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    profile: int = PROFILE, per_language: int = SAMPLE_PER_LANGUAGE,
) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams, from about ``per_language`` training documents of each language.

    Rows count when ``training`` holds and lang is not null. The sample is drawn by a hash of id and text, so it does
    not depend on partitions and the bound holds for repeated and null ids too; equal rows count once. The bound keeps
    the profiles' input fixed. Only profiles (languages x ``profile`` numbers)
    reach the driver. With no training rows the result is empty.
    """
    known = docs.filter(training & F.col(lang).isNotNull()).select(
        F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    whole = 1 << 30
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(whole))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(whole, whole * per_language // n + 1))])

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for part in parts:
            for name, own in part.groupby("lang"):
                found = [grams(t, letters) for t in own["text"] if t]
                if found:
                    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                    yield pd.DataFrame({"lang": name, "code": codes, "n": n})

    counted = (
        known.filter(draw < F.element_at(share, F.col("lang"))).dropDuplicates(["id", "lang", "text"]).select("lang", "text")
        .mapInPandas(count, "lang string, code bigint, n bigint")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile).collect()
    profiles: dict[str, list[int]] = {name: [] for name in sizes}
    for row in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles[row["lang"]].append(row["code"])
    return {k: v for k, v in sorted(profiles.items()) if v}


def identify(profiles: dict[str, list[int]], size: int = PROFILE, longest: int = LONGEST):
    """Pandas UDF: text -> (lang, score); see ``predict``."""
    names = list(profiles)
    every = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if names else np.zeros(0, np.int64)
    # Rank of every known n-gram in each language; ``size`` where the language lacks it.
    ranks = np.full((len(names), len(every) + 1), size, np.int32)
    for i, p in enumerate(profiles.values()):
        ranks[i, np.searchsorted(every, np.array(p, np.int64))] = np.arange(len(p))

    @F.pandas_udf("lang string, score double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()

        def one(text: str | None) -> tuple[str, float]:
            if not text or not names:
                return UNKNOWN, 0.0
            codes, counts = grams(text, letters, longest)
            if not len(codes):
                return UNKNOWN, 0.0
            own = ranked(codes, counts, size)
            at = np.searchsorted(every, own)
            at = np.where((at < len(every)) & (every[np.minimum(at, len(every) - 1)] == own), at, len(every))
            got = ranks[:, at]
            places = np.arange(len(own))
            far = np.where(got == size, size, np.abs(got - places)).sum(axis=1)
            best = int(far.argmin())
            return names[best], 1.0 - float(far[best]) / (size * len(own))

        for part in parts:
            yield pd.DataFrame([one(t) for t in part], columns=["lang", "score"])

    return udf


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", lang_out: str = "lang_pred",
    score_out: str = "score",
) -> DataFrame:
    """``docs`` with the nearest language and a score from 0 to 1.

    The distance of a language is the sum, over the document's ``PROFILE`` most frequent n-grams (n up to 3), of the
    difference of their ranks in document and profile, ``PROFILE`` for those that the profile lacks; the score is
    1 minus distance over the largest possible distance. Ties go to the language first by code point. Null text and
    text without a letter give ``und`` and 0, as everything does without profiles. Whole texts are read; each row
    stands alone, so repeated rows and empty tables need no care, and there is no shuffle. Columns named like the
    two outputs are replaced.
    """
    own = free_name(docs, "_found")
    found = docs.withColumn(own, identify(profiles)(F.col(text)))
    return found.withColumns({lang_out: F.col(f"{own}.lang"), score_out: F.col(f"{own}.score")}).drop(own)
