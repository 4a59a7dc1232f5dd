"""Keywords, questions and titles of a chunk, without a language model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, let, strip, words

# Words that are never keywords.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might must can this that these
those i you he she it we they what which who whom when where why how all each every both few more most other some such no nor
not only own same so than too very just and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under
""".split()
MAX_KEYWORDS, MAX_GIVEN_KEYWORDS, MAX_QUESTIONS, MAX_FALLBACK_QUESTIONS = 5, 12, 8, 6
#: Fixed value: the summary of a chunk that no model has described.
NO_SUMMARY = "Content summary unavailable"


def none() -> Column:
    return F.array().cast("array<string>")


def simple_keywords(text: Column, limit: int = MAX_KEYWORDS) -> Column:
    """The most frequent words of more than three letters and digits; ties in order of appearance."""
    cleaned = words(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{WS[1:-1]}]", ""))
    kept = F.filter(cleaned, lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))

    def ranked(ws: Column) -> Column:
        # Words in order, equal ones together: the length of each run counts a word, its first place breaks ties.
        placed = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def tops(s: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (F.get(s, k - 1)["w"] != s[k]["w"]))

            def runs(f: Column) -> Column:
                counted = F.transform(
                    f, lambda k, j: F.struct((k - F.coalesce(F.get(f, j + 1), F.size(s))).alias("less"), s[k]["i"].alias("at"), s[k]["w"].alias("w"))
                )
                return F.transform(F.slice(F.sort_array(counted), 1, limit), lambda x: x["w"])

            return let(first, runs)

        return let(placed, tops)

    return let(kept, lambda ws: F.when(F.size(ws) > 0, ranked(ws)).otherwise(none()))


def distinct_folded(items: Column) -> Column:
    """Items without those that equal an earlier one but for case; by sorting, so long lists are fine."""

    def of(xs: Column) -> Column:
        placed = F.sort_array(F.transform(xs, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"))))
        firsts = lambda s: F.filter(s, lambda p, k: (k == 0) | (F.get(s, k - 1)["low"] != p["low"]))
        return F.transform(F.sort_array(F.transform(let(placed, firsts), lambda p: p["i"])), lambda i: xs[i])

    return let(items, of)


def normalise_questions(items: Column) -> Column:
    """Given questions: stripped, none blank, each ending in a question mark, distinct, at most eight."""
    clean = F.array_remove(F.transform(F.coalesce(items, none()), strip), "")
    asked = F.transform(clean, lambda q: F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))
    return F.slice(distinct_folded(asked), 1, MAX_QUESTIONS)


def question_lines(text: Column) -> Column:
    """Questions given as one text, a line each, without bullets."""
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"\A[ \t\-•]+|[ \t\-•]+\z", ""))
    return F.array_remove(lines, "")


def normalise_keywords(items: Column) -> Column:
    """Given keywords: stripped, none blank, distinct, at most twelve."""
    clean = F.array_remove(F.transform(F.coalesce(items, none()), strip), "")
    return F.slice(distinct_folded(clean), 1, MAX_GIVEN_KEYWORDS)


def keyword_list(text: Column) -> Column:
    """Keywords given as one text with commas."""
    return F.array_remove(F.transform(F.split(text, ",", -1), strip), "")


def fallback_questions(keywords: Column) -> Column:
    """Up to three questions about the first keywords. The third keeps its full stop before the mark."""

    def asked(k: Column) -> Column:
        rest = F.array_join(F.slice(k, 2, 3), ", ")
        return F.filter(
            F.array(
                F.concat(F.lit("What is "), k[0], F.lit("?")),
                F.when(F.size(k) > 1, F.concat(F.lit("How does "), k[0], F.lit(" relate to "), rest, F.lit("?"))),
                F.when(F.size(k) > 1, F.concat(F.lit("Explain "), F.get(k, F.lit(1)), F.lit(".?"))),
            ),
            lambda q: q.isNotNull(),
        )

    clean = F.array_remove(F.transform(F.coalesce(keywords, none()), strip), "")
    return F.slice(let(clean, lambda k: F.when(F.size(k) > 0, asked(k)).otherwise(none())), 1, MAX_FALLBACK_QUESTIONS)


def cover_keywords(questions: Column, keywords: Column, limit: int = MAX_QUESTIONS) -> Column:
    """Questions, with one more for each keyword that none mentions if those are more than a third."""

    def covered(qs: Column, kws: Column) -> Column:
        low = F.transform(qs, lambda q: F.lower(q))

        def more(missing: Column) -> Column:
            added = F.transform(missing, lambda k: F.concat(F.lit("Explain "), k, F.lit("?")))
            return F.when(F.size(missing) > F.greatest(F.lit(1), F.floor(F.size(kws) / 3)), distinct_added(qs, added)).otherwise(qs)

        return let(low, lambda ls: let(F.filter(kws, lambda k: ~F.exists(ls, lambda q: F.contains(q, F.lower(k)))), more))

    def distinct_added(qs: Column, added: Column) -> Column:
        known = F.transform(qs, lambda q: F.lower(q))
        return F.concat(qs, F.filter(distinct_folded(added), lambda a: ~F.array_contains(known, F.lower(a))))

    blank = lambda xs: F.filter(F.coalesce(xs, none()), lambda x: strip(x) != "")
    return F.slice(let(blank(questions), lambda qs: let(blank(keywords), lambda kws: covered(qs, kws))), 1, limit)


def fallback_title(text: Column) -> Column:
    """The text up to its first full stop and space; at most 50 characters, then ``...``."""
    first = F.substring_index(text, ". ", 1)
    return F.when(F.length(first) > 50, F.concat(F.left(first, F.lit(50)), F.lit("..."))).otherwise(first)


def intent(value: Column) -> Column:
    """One of the known intents, in lower case, else unknown."""
    low = F.lower(value)
    return F.when(low.isin(INTENTS), low).otherwise(F.lit("unknown"))


def verdict(value: Column) -> Column:
    """One of the known verdicts, in upper case, else KEEP. White space is not trimmed."""
    up = F.upper(value)
    return F.when(up.isin(VERDICTS), up).otherwise(F.lit("KEEP"))


# What a chunk may intend, and what a boundary may be judged.
INTENTS = ["explains", "lists", "warns", "defines", "instructs", "compares", "unknown"]
VERDICTS = ["KEEP", "MERGE", "ADJUST"]
