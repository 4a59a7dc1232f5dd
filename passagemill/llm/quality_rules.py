"""Quality rules under weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
estimates, from the vote patterns of all documents, how often each rule votes
which way on good and on bad documents; the posterior probability of "good"
then decides, instead of asking that every rule passes.

All per-document work is row-local on the JVM. Only the counts of the vote
patterns, at most 3 ** rules rows, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import barrier
from .common import SPACES, hold, let, materialise, strip_chars, table, unused, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = ["the", "of", "and", "to", "der", "die", "und", "in", "de", "la", "le", "et", "que", "el", "en", "los"]
#: What a sentence, and so most lines of prose, ends with.
ENDINGS = list(".!?…\"”»)。！？")
WINDOW = 5
RULES = ["length", "symbols", "bangs", "repeats", "dup_lines", "word_length", "function_words", "case", "digits", "endings"]
ROUNDS = 50
PRIOR_GOOD = 0.8


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)]))

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, j: F.get(s, j)["x"].eqNullSafe(a["x"])
            return F.sort_array(F.transform(F.filter(s, lambda a, j: same(a, j - 1) | same(a, j + 1)), lambda a: a["i"]))

        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
        return F.aggregate(let(ranked, starts), zero, step, lambda acc: acc["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    repeats = let(hashes, lambda h: let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return F.when(F.size(words) >= 2, F.when(F.size(words) > WINDOW, repeats).otherwise(F.lit(0))).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """All that the rules need of one text, as a struct; null counts as empty."""
    flat = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(flat, "\n", -1), lambda x: strip_chars(x, SPACES) != "")
    ended = lambda x: F.right(F.rtrim(x), F.lit(1)).isin(*ENDINGS)

    kinds = lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"), F.size(F.filter(x, ended)).alias("ended"))

    def counted(words: Column, by_line: Column) -> Column:
        long = lambda c: c.cast("long")
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(strip_chars(flat, SPACES))).alias("word_chars"),
            long(F.length(flat) - F.length(strip_chars(flat, SYMBOLS))).alias("n_symbols"),
            long(by_line["all"] - by_line["own"]).alias("n_dup_lines"),
            long(by_line["all"]).alias("n_text_lines"),
            long(by_line["ended"]).alias("n_ended"),
            long(_repeat_words(words)).alias("n_repeat_words"),
            long(F.length(flat) - F.length(F.replace(flat, F.lit("!"), F.lit("")))).alias("n_bangs"),
            long(F.length(flat) - F.length(F.translate(flat, "0123456789", ""))).alias("n_digits"),
            long(F.length(flat) - F.length(F.replace(flat, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
            long(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in FUNCTION_WORDS])))).alias("n_function"),
            ((F.upper(flat) == flat) & (F.lower(flat) != flat)).alias("all_upper"),
        )

    return let(let(lines, kinds), lambda by_line: let(words_of(text), lambda words: counted(words, by_line)))


def votes(m: Column) -> list[Column]:
    """One vote per rule, in the order of RULES."""
    n = m["n_words"]

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return [
        vote(n < 10, n >= 50),
        vote(m["n_symbols"] * 10 > n, m["n_symbols"] * 50 <= n),
        vote(m["n_bangs"] * 10 > n, m["n_bangs"] * 50 <= n),
        vote(m["n_repeat_words"] * 5 > n, m["n_repeat_words"] * 20 <= n),
        vote((m["n_dup_lines"] >= 2) & (m["n_dup_lines"] * 2 > m["n_lines"]), m["n_dup_lines"] == 0),
        vote((m["word_chars"] < n * 2) | (m["word_chars"] > n * 14), m["word_chars"].between(n * 3, n * 10)),
        vote((m["n_function"] == 0) & (n >= 100), m["n_function"] >= 2),
        vote(m["all_upper"], F.lit(False)),
        vote(m["n_digits"] * 3 > m["word_chars"], m["n_digits"] * 20 <= m["word_chars"]),
        vote(m["n_ended"] * 2 < m["n_text_lines"], m["n_ended"] * 5 >= m["n_text_lines"] * 4),
    ]


def pattern(m: Column) -> Column:
    """The votes as one number in base 3."""
    out = F.lit(0)
    for v in votes(m):
        out = out * 3 + (v + 1)
    return out


def unpack(code: int, rules: int) -> list[int]:
    out = []
    for _ in range(rules):
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def fit(counts: dict[int, int], rules: int = len(RULES), rounds: int = ROUNDS) -> dict[int, float]:
    """Posterior probability of "good" for each vote pattern.

    Expectation-maximisation of a two-class model in which rules vote independently given the
    class; an abstention says nothing. ``bad[y][j]`` is how often rule j, when it votes, votes bad
    on documents of class y. Pseudo-counts worth a tenth of the documents start the rules as
    better than chance, which also fixes which class is the good one: a bad document is bad in one
    way or two, so that a rule votes bad on one in eight of them, and on hardly any good one.
    """
    total = sum(counts.values())
    strength, start = max(1.0, total / 10), {1: 0.005, 0: 0.12}
    bad = {y: [start[y]] * rules for y in (0, 1)}
    prior, post = PRIOR_GOOD, {}
    seen = {c: unpack(c, rules) for c in sorted(counts)}
    for _ in range(rounds):
        for c, v in seen.items():
            odds = math.log(prior) - math.log(1 - prior)
            for j, x in enumerate(v):
                if x < 0:
                    odds += math.log(bad[1][j]) - math.log(bad[0][j])
                elif x > 0:
                    odds += math.log(1 - bad[1][j]) - math.log(1 - bad[0][j])
            post[c] = 1 / (1 + math.exp(min(700.0, -odds)))
        prior = (sum(counts[c] * post[c] for c in seen) + 0.8 * strength) / (total + strength)
        for y in (0, 1):
            for j in range(rules):
                said = sum(counts[c] * (post[c] if y else 1 - post[c]) for c, v in seen.items() if v[j])
                said_bad = sum(counts[c] * (post[c] if y else 1 - post[c]) for c, v in seen.items() if v[j] < 0)
                bad[y][j] = (said_bad + strength * start[y]) / (said + strength)
    return post


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


def posteriors(patterns: DataFrame) -> DataFrame:
    """``(pattern, p_good)`` from a table with a column ``pattern``, one row per document."""
    spark = patterns.sparkSession
    counts = {r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()}  # at most 3 ** rules rows
    return spark.createDataFrame(sorted(fit(counts).items()), "pattern int, p_good double")


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the measures, ``base_failed``, ``p_good`` and ``kept``.

    A null or blank text has no words and fails the base. Repeated rows are judged one by one;
    other columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    m = hold(docs.select("doc_id", measures(F.col("text")).alias("m")).withColumn("pattern", pattern(F.col("m"))))
    verdict = m.join(F.broadcast(posteriors(m)), "pattern", "left")
    failed = base_failed(F.col("m"))
    return verdict.select(
        "doc_id", "m.*", failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= 0.5)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.

    Each text is measured once: the rows are written with their vote patterns in the shared folder,
    the patterns are counted there, and the rows are filtered as they are read again. The texts are
    never shuffled.
    """
    votes_, failed = unused(docs, "votes"), unused(docs, "failed")
    verdict = let(measures(F.col("text")), lambda m: F.struct(pattern(m).alias("p"), base_failed(m).alias("f")))
    marked = docs.withColumn(votes_, barrier(verdict))
    marked = materialise(marked.withColumns({failed: F.col(votes_)["f"], votes_: F.col(votes_)["p"]}), "votes")
    learned = posteriors(marked.select(F.col(votes_).alias("pattern")))
    good = [r["pattern"] for r in learned.where("p_good >= 0.5").collect()]
    return marked.where(~F.col(failed) & F.col(votes_).isin(good)).drop(votes_, failed)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of the query above that SQL can say as well."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
"""
QUERIES = {"op3_quality_rules": op3_quality_rules, "base_quality": base_quality}
ORACLES = {"base_quality": BASE_SQL}
