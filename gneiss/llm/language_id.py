"""Language ID by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3, of lower-cased letters with
word ends) in order. A document's profile is compared with each language's by out-of-place distance:
the sum of the differences of ranks, with the profile's length for an n-gram that is missing.

An n-gram of up to three code points fits a 64-bit integer without collisions, so counting is
a sort of integers in numpy. Scoring is row-local over whole texts. Profiles are counted on the
executors over a bounded sample (``max_train_docs`` documents in all, dealt evenly to the languages, by a
hash of the id); only n-gram counts reach the driver.

Defined results: null text or text without a letter is ``und`` with score 0, and so is every text if no
language was learned; equal distances go to the first language by name; repeated rows get equal
results; an empty table gives an empty table; other columns pass through, output columns replace
columns of the same name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import crc_fold, with_fields
from gneiss.shipping import ship


@dataclass(frozen=True)
class LanguageParams:
    profile: int = 400
    max_train_docs: int = 4000
    sharpness: float = 40.0


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Of each code point: 2 for a letter, 1 for a mark, which may stand on one, else 0."""
    global _letters
    if _letters is None:
        _letters = np.fromiter(("?ML".find(unicodedata.category(chr(i))[0]) for i in range(0x110000)), np.int8, 0x110000).clip(0)
    return _letters


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts), by n-gram; empty if there is no letter."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[c]
    if not (letter == 2).any():
        return none
    c = np.concatenate([[32], np.where(letter > 0, c, 32), [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    two = c[:-1] | (c[1:] << 21)
    three = two[:-1] | (c[2:] << 42)
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in order; ties by n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Languages and their ranks: a row for each known n-gram, a column for each language."""

    def __init__(self, profiles: dict[str, np.ndarray], p: LanguageParams):
        self.p, self.languages = p, sorted(profiles)
        self.known = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]).astype(np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.languages)), p.profile, np.int32)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.known, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngram_counts(text)
        if not len(grams) or not self.languages:
            return "und", 0.0
        mine = ranked(grams, counts, self.p.profile)
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        r = self.ranks[np.where(self.known[at] == mine, at, len(self.known))]
        place = np.arange(len(mine), dtype=np.int32)[:, None]
        d = np.where(r == self.p.profile, self.p.profile, np.abs(r - place)).mean(axis=0) / self.p.profile
        q = np.exp(-self.p.sharpness * (d - d.min()))
        return self.languages[int(np.argmin(d))], float(q.max() / q.sum())


def fit_languages(documents: DataFrame, p: LanguageParams = LanguageParams()) -> Profiles:
    """Learns from documents with a language outside the held-out fold (crc32 of the id as text, modulo 4, is 2)."""
    rows = documents.where(F.col("lang").isNotNull() & (crc_fold(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles({}, p)
    ship(documents.sparkSession)
    per = max(1, p.max_train_docs // len(counts))
    million = 1_000_000
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(million, -(-per * million // n))))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(million)) < share[F.col("lang")])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, g in f.groupby("lang"):
                each = [ngram_counts(t) for t in g["text"]]
                grams, at = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in each]), len(grams)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    found = chosen.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    profiles = {}
    for lang, g in found.groupby("lang"):
        g = g.sort_values("gram")
        profiles[lang] = ranked(g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64), p.profile)
    return Profiles(profiles, p)


def language_id(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: softmax of the distances)."""

    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([profiles.predict(t) for t in b], columns=["lang_pred", "score"])

    return with_fields(docs, predict(F.col(text)), ("lang_pred", "score"))


def op2_language_id(documents: DataFrame) -> DataFrame:
    out = language_id(documents.select("doc_id", "text"), fit_languages(documents))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
