"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a window of a text's word sequence, whatever lines it spans: it starts at a word of the
template and is half as long again as the template. It contains the template if it holds at least
``threshold`` of the template's distinct words. Words are ordered by their document frequency in the
corpus, rarest first, and the filters of the join lose nothing:

* prefix: a block must hold one of the template's rarest words (so many as may be missing, and one);
  they are searched for in the text first, and only texts with one are looked into further,
* length: a text must hold as many of the template's words as a block needs,
* position: as the template's words in a text stand in order, the last one that a block needs must
  lie within the block that starts at the first; and so must one of the rarest.

Blocks that pass are verified by counting their distinct words. Templates are a parameter, not
data, so they stand in the plan as literals and each text is joined where it lies: no shuffle, no skew.

Beside the join, fixed phrases are looked up as runs of consecutive words (base labels).

Defined results: null or empty text has no words, labels "", score 0 and null places; rows
repeat as given; an empty table gives an empty table; other columns pass through, and output
columns replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import ascii_lower, bound, unused

#: What stands between words; letters of either case are left, so that case can be folded later, where it matters.
NOT_WORD_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Fixed license notices and sentences: label, words.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
    ),
    ("mit-notice", "released under the mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain "
        "the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("all-rights-reserved", "all rights reserved"),
)

OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
BLOCK = "array<struct<label:string,share:double,first_word:int>>"


def normal(text: Column) -> Column:
    """Words of ``text``, case kept, with one space before, between and after them; a lone space if there are none."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD_RE, " "))
    return F.when(one == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), one, F.lit(" ")))


def spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("bigint")


def window_words(template: str) -> int:
    """Words of a block: those of the template, and half as many."""
    n = len(template.split())
    return n + n // 2


def needed(template: str, threshold: float) -> int:
    """Distinct words of a template that a block must hold."""
    return max(1, math.ceil(threshold * len(set(template.split())) - 1e-9))


def token_frequencies(docs: DataFrame, text: str, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents of the whole corpus that hold each vocabulary token, in lower, title or upper case; one entry a token at most."""
    cases = sorted({c for w in vocabulary for c in (w, w.title(), w.upper())})
    held = F.array_intersect(F.lit(cases), F.split(normal(F.col(text)), " "))
    each = docs.select(F.explode(F.array_distinct(F.transform(held, F.lower))).alias("token"))
    return {r["token"]: r["n"] for r in each.groupBy("token").agg(F.count("*").alias("n")).collect()}


def prefixes(templates: Sequence[tuple[str, str]], threshold: float, frequency: dict[str, int]) -> list[list[str]]:
    """Each template's rarest words: a block at the threshold misses fewer than there are of them."""
    out = []
    for _, t in templates:
        words = sorted(set(t.split()), key=lambda w: (frequency.get(w, 0), w))
        out.append(words[: len(words) - needed(t, threshold) + 1])
    return out


def template_blocks(hits: Column, label: str, template: str, prefix: list[str], threshold: float) -> Column:
    """The blocks that contain one template. hits: the places (i) and words (w) of all templates' words in a text, in order."""
    words, need, width = sorted(set(template.split())), needed(template, threshold), window_words(template)

    def starts(own: Column) -> Column:
        """Blocks by the position filter: the last of the needed words lies within the block."""
        at = F.transform(own, lambda x, k: F.struct(x["i"].alias("i"), k.alias("k"), (F.get(own, k + (need - 1))["i"] < x["i"] + width).alias("ok")))
        return F.filter(at, lambda s: s["ok"])

    def verified(own: Column) -> Column:
        def share(s: Column) -> Column:
            inside = F.filter(F.slice(own, s["k"] + 1, width), lambda y: y["i"] < s["i"] + width)
            distinct = lambda b: F.size(F.array_distinct(F.transform(b, lambda y: y["w"]))) / F.lit(float(len(words)))
            return bound(inside, lambda b: F.when(F.exists(b, lambda y: y["w"].isin(*prefix)), distinct(b)).otherwise(F.lit(0.0)))

        each = F.transform(starts(own), lambda s: F.struct(F.lit(label).alias("label"), share(s).alias("share"), s["i"].alias("first_word")))
        return F.filter(each, lambda b: b["share"] >= need / len(words) - 1e-9)

    own = F.filter(hits, lambda x: x["w"].isin(*words))
    none = F.array().cast(BLOCK)
    return F.when(F.exists(hits, lambda x: x["w"].isin(*prefix)), bound(own, lambda o: F.when(F.size(o) >= need, verified(o)).otherwise(none))).otherwise(none)


def license_scan(
    docs: DataFrame,
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.9,
) -> DataFrame:
    """``docs`` with the columns in ``OUT`` and ``blocks``: each block that contains a template, with its label, the share of the template's words and the place of its first word."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rarest = prefixes(templates, threshold, token_frequencies(docs, text, vocabulary))
    rare = sorted({w for p in rarest for w in p})
    spaced, low, hits, base = unused(docs, "spaced", "low", "hits", "base")
    row = docs.drop(*[c for c in (*OUT, "blocks") if c in docs.columns and c != text])
    # only a text with a phrase or one of a template's rarest words is looked into further
    may = F.col(spaced).rlike(rf"(?i) (?:{'|'.join(rare)}|{'|'.join(p for p, _ in phrases)}) ")
    row = row.withColumn(spaced, normal(F.col(text)))
    row = row.withColumn(low, F.when(may, ascii_lower(F.col(spaced))).otherwise(F.lit("")))
    n = F.col(low)

    def places(phrase: str) -> tuple[Column, Column, Column]:
        p = f" {phrase} "
        there = n.contains(p)
        first = F.locate(p, n)
        last = F.length(n) - F.locate(p[::-1], F.reverse(n)) - F.lit(len(p)) + 2
        return (
            F.when(there, F.regexp_count(n, F.lit(f"(?<= )(?={phrase} )"))).otherwise(0),
            F.when(there, spaces(F.left(n, first - 1))),
            F.when(there, spaces(F.left(n, last - 1))),
        )

    found = [(label, *places(phrase)) for phrase, label in phrases]
    counts = reduce(lambda a, b: a + b, [x[1] for x in found])
    label_sets = F.array_compact(F.array(*[F.when(x[1] > 0, F.lit(x[0])) for x in found]))
    placed = F.transform(F.split(F.trim(n), " "), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    rare_there = n.rlike(rf" (?:{'|'.join(rare)}) ")
    row = row.withColumns(
        {
            "n_words": F.greatest(spaces(F.col(spaced)) - 1, F.lit(0)).cast("bigint"),
            "n_base": counts.cast("bigint"),
            "first_word": F.array_min(F.array(*[x[2] for x in found])),
            "last_word": F.array_max(F.array(*[x[3] for x in found])),
            base: label_sets,
            hits: F.when(rare_there, F.filter(placed, lambda x: x["w"].isin(*vocabulary))),
        }
    )
    each = [template_blocks(F.col(hits), label, t, p, threshold) for (label, t), p in zip(templates, rarest, strict=True)]
    row = row.withColumn("blocks", F.when(F.col(hits).isNull(), F.array().cast(BLOCK)).otherwise(F.concat(*each)))
    row = row.withColumns(
        {
            "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
            "labels": F.array_join(F.array_sort(F.array_union(base, F.transform("blocks", lambda b: b["label"]))), ","),
            "score": F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))),
        }
    )
    return row.drop(spaced, low, hits, base)


def op7_license_scan(docs: DataFrame) -> DataFrame:
    return license_scan(docs.select("doc_id", "text")).select("doc_id", *OUT)
