"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text.

Only DataFrame functions; one projection without a shuffle, so a hot source or a group of
copies changes nothing.

Each line with a word is judged alone:

* punctuation: a line of several words that neither ends in a sentence mark nor holds one,
* symbols: too large a share of its words ends or starts in one of ``# * $ % & | < >``,
* navigation: words mostly split by ``|`` or arrows, or a short line made of menu words,
* boilerplate: one of a fixed list of phrases,
* repeated: equal to an earlier line.

What remains is the cleaned text. A document is rejected if it fails a base rule (too few
words, too many repeated words) or if the lines kept hold less than ``min_kept_share`` of
the characters in its words.

Defined results: null text counts as empty (no words: rejected, cleaned text empty); rows
repeat as given; other columns pass through and may have any name, except that the output
columns replace columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import SPACE_RE, bound, unused, words_of

#: Fixed phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "uses cookies",
    "enable javascript",
    "sign up for our newsletter",
    "click here to subscribe",
    "lorem ipsum",
    "share on facebook",
    "back to top",
)
#: Fixed words of menu lines, in lower case.
MENU = ("home", "menu", "login", "logout", "register", "sitemap", "search", "next", "previous", "contact", "about", "subscribe", "share", "tweet")
SYMBOLS = "#*$%&|<>"
BARS = "|»›→·"
MARKS = r"[.!?…。！？؟।]"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = (*BASE, "base_failed", "kept_share", "cleaned_text", "kept")


def windows_of(one_spaced: Column) -> Column:
    """All 3-word windows, in order, of a text whose words are split by single spaces."""
    return F.regexp_extract_all(one_spaced, F.lit(r"(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), F.lit(1))


def repeat_words(one_spaced: Column, windows: Column, few: int = 64) -> Column:
    """Words that lie in a 3-word window found twice or more, the first one included.

    Most texts repeat none, which comparing sizes tells. Else the repeated windows are neighbours in the sorted
    array. If they are few, a pattern of them marks the words where one starts (by a second space), and the text
    becomes a string of flags; else (window, place) pairs are sorted, so it takes n log n steps for any text.
    """

    def twice(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1)))

    def flagged(many: Column) -> Column:
        quoted = F.transform(many, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
        pattern = F.concat(F.lit("(?<![^ ])(?=(?:"), F.array_join(quoted, "|"), F.lit(")(?![^ ]))"))
        marked = F.regexp_replace(F.concat(F.lit(" "), one_spaced), pattern, F.lit(" "))
        flags = F.replace(F.replace(F.regexp_replace(marked, "[^ ]++", "0"), F.lit("  0"), F.lit("1")), F.lit(" 0"), F.lit("0"))
        return F.regexp_count(flags, F.lit("1|(?<=1.?)0"))

    def sorted_places(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))
        return F.array_sort(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def counted(many: Column) -> Column:
        pairs = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(many) <= few, flagged(many)).otherwise(bound(bound(F.sort_array(pairs), sorted_places), covered))

    none = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(none, F.lit(0)).otherwise(bound(bound(F.sort_array(windows), twice), counted)).cast("bigint")


#: The line rules that look into words, each with a cheap test of a whole text that misses no text with a failing line.
RULES = ("phrase", "menu", "plain", "symbols", "bars")


def line_fails(line: Column, may: dict[str, Column], max_symbol_share: float, max_menu_words: int) -> Column:
    """Whether one line breaks a rule of its own. A rule is tried only if ``may`` says that the text can fail it."""
    n = F.size(words_of(line))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.translate(line, BARS, ""))
    phrase = F.lower(line).rlike("|".join(BOILERPLATE))
    menu = ~line.rlike(MARKS) & (n <= max_menu_words) & F.forall(words_of(F.lower(line)), lambda w: w.isin(*MENU))
    return (
        (may["symbols"] & (symbols > 0) & (symbols > max_symbol_share * F.greatest(n, F.lit(1))))
        | (may["bars"] & (bars >= 3) & (2 * bars >= n))
        | (may["plain"] & ~line.rlike(MARKS) & (n >= 12))
        | (may["phrase"] & phrase)
        | (may["menu"] & menu)
    )


def text_tests(text: Column, low: Column, n_symbols: Column) -> dict[str, Column]:
    """The tests of ``RULES`` on a text and its lower case. Lines end at a line feed and nowhere else."""
    return {
        # lower case is that of the rules themselves, so a phrase of any case is seen
        "phrase": reduce(lambda a, b: a | b, [low.contains(p) for p in BOILERPLATE]),
        "menu": low.rlike(rf"(?<![^\n])[\x20\x09\x0B-\x0D]*+(?:{'|'.join(MENU)})(?![^\x20\x09-\x0D])"),
        # twelve words without a mark are 23 characters at least
        "plain": text.rlike(rf"(?<![^\n])[^\n{MARKS[1:-1]}]{{23,}}+(?![^\n])"),
        "symbols": n_symbols > 0,
        "bars": reduce(lambda a, b: a | b, [text.contains(c) for c in BARS]),
    }


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_kept_share: float = 0.3,
    max_symbol_share: float = 0.3,
    max_menu_words: int = 8,
) -> DataFrame:
    """``docs`` with the columns in ``OUT``; see the module's text for the rules and the defined cases."""
    t = F.coalesce(F.col(text), F.lit(""))
    all_lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one, lines, windows, unique, good_lines, lower, *tests = unused(docs, "one", "lines", "windows", "unique", "good_lines", "lower", *(f"may_{r}" for r in RULES))
    may = {r: F.col(c) for r, c in zip(RULES, tests, strict=True)}
    row = docs.drop(*[c for c in OUT if c in docs.columns and c != text])
    # whole-text passes are byte searches where they can be; only texts with runs of white space need a pattern
    line_ends = F.replace(t, F.lit("\n"), F.lit(" "))
    n_symbols = F.when(t.rlike(f"[{SYMBOLS}]"), F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))).otherwise(F.lit(0))
    row = row.withColumns({one: F.trim(line_ends), lines: all_lines, lower: F.lower(t), "n_symbols": n_symbols.cast("bigint")})
    row = row.withColumn(one, F.when(F.col(one).rlike(r"[\x09-\x0D]|  "), F.trim(F.regexp_replace(one, SPACE_RE, " "))).otherwise(F.col(one)))
    spaces = F.length(one) - F.length(F.replace(F.col(one), F.lit(" "), F.lit("")))
    row = row.withColumns(
        {
            windows: windows_of(F.col(one)),
            unique: F.array_distinct(lines),
            **{c: test for c, test in zip(tests, text_tests(t, F.col(lower), F.col("n_symbols")).values(), strict=True)},
            "n_words": F.when(F.col(one) == "", F.lit(0)).otherwise(spaces + 1).cast("bigint"),
            "word_chars": (F.length(one) - spaces).cast("bigint"),
        }
    )
    good = F.filter(unique, lambda x: ~line_fails(x, may, max_symbol_share, max_menu_words))
    suspect = reduce(lambda a, b: a | b, may.values())
    row = row.withColumns(
        {
            "n_dup_lines": (F.size(lines) - F.size(unique)).cast("bigint"),
            "n_repeat_words": repeat_words(F.col(one), F.col(windows)),
            good_lines: F.when(suspect, good).otherwise(F.col(unique)),
        }
    )
    row = row.withColumn("cleaned_text", F.array_join(good_lines, "\n")).withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
            "kept_share": F.when(F.col("word_chars") == 0, F.lit(0.0))
            .when((F.col("n_dup_lines") == 0) & (F.size(good_lines) == F.size(lines)), F.lit(1.0))
            .otherwise(F.length(F.regexp_replace("cleaned_text", SPACE_RE, "")) / F.col("word_chars")),
        }
    )
    row = row.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= min_kept_share))
    return row.drop(one, lines, windows, unique, good_lines, lower, *tests)


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    out = quality_rules(docs.select("doc_id", "text"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "kept_share")


#: The base columns; ``kept`` and ``kept_share`` follow the method's own line rules and are tested apart.
__all__ = ["quality_rules", "op9_quality_rules", "repeat_words", "line_fails"]
