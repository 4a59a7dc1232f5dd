"""Granularity planning: what a model is shown, how its plan is read, and what makes it safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, sentence_count, strip
from .paragraphs import estimate_atoms, sample

MAX_TITLES, MAX_TOPICS = 20, 50
# The notes that an adjusted plan's rationale gets.
FINER = "(Adjusted atomization to avoid under-splitting: %d sentences/group, min_sentences=%d.)"
PAIRED = "(Adjusted atomization to 2 sentences/group to better match the expected chunk granularity.)"
COARSER = "(Adjusted atomization to %d sentences/group to avoid over-splitting.)"


def title_list(titles: Column, limit: int = MAX_TITLES) -> Column:
    """The first non-blank titles, quoted, in brackets; ``...`` if there are more."""
    clean = F.array_remove(F.transform(titles, strip), "")
    quoted = lambda t: F.array_join(F.transform(F.slice(t, 1, limit), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return let(clean, lambda t: F.concat(F.lit("["), quoted(t), F.when(F.size(t) > limit, F.lit(", ...")).otherwise(F.lit("")), F.lit("]")))


def paragraph_lines(paragraphs: Column, most: int, chars: int) -> Column:
    """A line for each sampled paragraph: index, sentences, length and beginning."""

    def line(p: Column) -> Column:
        def of(t: Column) -> Column:
            cut = F.concat(F.regexp_replace(F.left(t, F.lit(chars)), r"[\t-\r\x1c-\x20\x85\p{Z}]+\z", ""), F.lit("..."))
            return F.format_string("- P%d sentences=%d chars=%d: %s", p["idx"], sentence_count(t), F.length(t), F.when(F.length(t) > chars, cut).otherwise(t))

        return let(F.replace(strip(p["text"]), F.lit("\n"), F.lit(" ")), of)

    def lines(chosen: Column) -> Column:
        tail = F.format_string("- ... (sampled %d/%d paragraphs)", F.size(chosen), F.size(paragraphs))
        shown = F.transform(chosen, line)
        return F.array_join(F.when(F.size(chosen) < F.size(paragraphs), F.concat(shown, F.array(tail))).otherwise(shown), "\n")

    return let(sample(paragraphs, most), lines)


def _int(reply: Column, path: str) -> Column:
    """A whole number from a JSON number, numeric text or truth value; half to even; else null."""
    text = F.get_json_object(reply, path)
    number = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(strip(text).try_cast("double"))
    return F.when(F.abs(number) < 1e15, F.bround(number, 0).cast("long"))


def _clamp(x: Column, low: int, high: int) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x)))


def normalise_plan(reply: Column, paragraphs: Column, min_sentences: int) -> Column:
    """A plan from a model's JSON reply; what is absent or unusable gets a default.

    ``paragraphs`` is the document's number of paragraphs. Returns a struct (topics, expected,
    lo, hi, gs, ms, rationale, confidence).
    """
    as_list = F.from_json(F.get_json_object(reply, "$.topics"), "array<string>")
    is_list = F.get_json_object(reply, "$.topics[0]").isNotNull() & F.get_json_object(reply, "$.topics").startswith("[")
    one_text = F.array_remove(F.transform(F.split(F.coalesce(F.get_json_object(reply, "$.topics"), F.lit("")), ","), strip), "")
    topics = F.when(is_list, as_list).when(F.get_json_object(reply, "$.topics").startswith("["), F.array().cast("array<string>")).otherwise(one_text)
    expected = F.coalesce(_clamp(_int(reply, "$.expected_chunk_count"), 1, 100_000), F.greatest(F.lit(1).cast("long"), paragraphs.cast("long")))
    ranged = F.get_json_object(reply, "$.expected_chunk_count_range[1]").isNotNull()

    def full(e: Column) -> Column:
        lo = F.coalesce(F.when(ranged, _clamp(_int(reply, "$.expected_chunk_count_range[0]"), 1, 100_000)), F.greatest(F.lit(1).cast("long"), e - 2))
        hi = F.coalesce(F.when(ranged, _clamp(_int(reply, "$.expected_chunk_count_range[1]"), 1, 100_000)), e + 2)
        gs = F.coalesce(_clamp(_int(reply, "$.atomize_sentences_per_paragraph"), 0, 10), F.when(e > paragraphs, F.lit(2)).otherwise(F.lit(0)))
        confidence = F.get_json_object(reply, "$.confidence").try_cast("double")
        return F.struct(
            F.slice(topics, 1, MAX_TOPICS).alias("topics"), e.cast("int").alias("expected"),
            F.least(lo, hi).cast("int").alias("lo"), F.greatest(lo, hi).cast("int").alias("hi"), gs.cast("int").alias("gs"),
            F.coalesce(_clamp(_int(reply, "$.atomize_min_sentences"), 0, 50), F.lit(min_sentences)).cast("int").alias("ms"),
            F.coalesce(F.get_json_object(reply, "$.rationale"), F.lit("")).alias("rationale"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence"),
        )

    return let(expected, full)


def safe_plan(plan: Column, counts: Column, paragraphs: Column) -> Column:
    """A plan adjusted to what atomizing would make of paragraphs with these sentence counts.

    Too few atoms for the low end of the range: fewer sentences asked for, then smaller groups.
    Many more chunks than paragraphs expected: groups of two. Above three times the high end:
    larger groups, up to six. Each change adds a note to the rationale.
    """
    note = lambda text, more: F.concat(strip(F.concat(text, F.lit(" "))), F.lit(" "), more)
    trimmed = lambda x: strip(x)

    def refine(p: Column) -> Column:
        most = F.aggregate(counts, F.lit(0), lambda a, c: F.greatest(a, c))
        start = F.when(most > 0, F.least(p["ms"], most)).otherwise(p["ms"])
        down = lambda n: F.reverse(F.sequence(F.lit(0), n))
        tries = F.flatten(F.transform(F.reverse(F.sequence(F.lit(1), p["gs"])), lambda g: F.transform(down(start), lambda m: F.struct(g.alias("gs"), m.alias("ms")))))
        reach = F.get(F.filter(tries, lambda t: estimate_atoms(counts, t["gs"], t["ms"]) >= p["lo"]), F.lit(0))

        def finer(hit: Column) -> Column:
            few = estimate_atoms(counts, p["gs"], p["ms"]) < p["lo"]
            moved = few & hit.isNotNull() & ((hit["gs"] != p["gs"]) | (hit["ms"] != p["ms"]))
            said = F.format_string(FINER, hit["gs"], hit["ms"])
            return F.struct(
                F.when(moved, hit["gs"]).otherwise(p["gs"]).alias("gs"), F.when(moved, hit["ms"]).otherwise(p["ms"]).alias("ms"),
                F.when(moved, trimmed(note(p["rationale"], said))).otherwise(p["rationale"]).alias("rationale"),
            )

        def paired(a: Column) -> Column:
            two = (p["expected"] > paragraphs) & (paragraphs > 0) & (p["expected"] >= paragraphs * 1.5) & (a["gs"] > 2) & (estimate_atoms(counts, F.lit(2), a["ms"]) <= p["hi"] * 3)
            said = F.lit(PAIRED)
            return F.struct(F.when(two, F.lit(2)).otherwise(a["gs"]).alias("gs"), a["ms"].alias("ms"), F.when(two, trimmed(note(a["rationale"], said))).otherwise(a["rationale"]).alias("rationale"))

        def coarser(b: Column) -> Column:
            fits = F.filter(F.sequence(F.least(b["gs"], F.lit(6)), F.lit(6)), lambda g: estimate_atoms(counts, g, b["ms"]) <= p["hi"] * 3)
            size = F.when(b["gs"] < 6, F.coalesce(F.get(fits, F.lit(0)), F.lit(6))).otherwise(b["gs"])
            return let(size, lambda g: F.struct(
                g.alias("gs"), b["ms"].alias("ms"),
                F.when(g != b["gs"], trimmed(note(b["rationale"], F.format_string(COARSER, g)))).otherwise(b["rationale"]).alias("rationale"),
            ))

        found = let(F.when(estimate_atoms(counts, p["gs"], p["ms"]) < p["lo"], reach), finer)
        done = let(let(found, paired), coarser)
        return let(done, lambda d: p.withField("gs", d["gs"]).withField("ms", d["ms"]).withField("rationale", d["rationale"]))

    return let(plan, lambda p: F.when((p["gs"] > 0) & (p["lo"] > 0) & (p["hi"] > 0), refine(p)).otherwise(p))
