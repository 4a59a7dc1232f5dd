"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is row-local and runs on the JVM: the gaps that ``split`` leaves and
the matches of ``regexp_extract_all`` alternate, so a running sum of their
lengths gives every match's position. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import before, gather
from .common import let, table, unused

ONE = "struct<kind:string,start:int,end:int,score:double>"
SPAN = f"array<{ONE}>"
#: Characters before and after a span in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``pattern`` is possessive where the next character cannot be one of the run, and starts a
    run only at its beginning (or where the last match ended), so long runs cost linear time.
    ``need`` is a cheap test that any text with a match passes.
    """

    name: str
    pattern: str
    need: str
    check: str
    base: float
    words: str = ""
    #: An added kind counts only from this score on; the contract's kinds always count.
    least: float = 0.0


EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Only where an IBAN may begin; where it ends is for the country's length and the checksum to say.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
SHORT_CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])"

#: Characters of an IBAN without spaces, by country. Other countries' may have any length in IBAN_RANGE.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_RANGE = range(15, 35)

#: The contract's four kinds, in its order.
BASE = [
    Kind("email", EMAIL, "at", "none", 0.9, "mail|contact|write"),
    Kind("ip", IP, "digit", "ip", 0.6, "ip|address|host|server"),
    Kind("card", CARD, "digit", "card", 0.8, "card|visa|pay|credit|amex"),
    Kind("phone", PHONE, "plus", "phone", 0.7, "tel|phone|call|fax|mobile"),
]
#: What the method adds: a checksum or a context word has to speak for each span.
ADDED = [
    Kind("iban", IBAN, "digit", "iban", 0.9, "iban|bank|account|konto", 0.5),
    Kind("ssn", SSN, "digit", "ssn", 0.3, "ssn|social|security|insurance", 0.5),
    Kind("shortcard", SHORT_CARD, "digit", "shortcard", 0.4, "card|visa|pay|credit|amex", 0.5),
]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _int_at(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1)).cast("int")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        def add(acc, i):
            x = _int_at(d, i) * (F.lit(2) - (i % 2))  # every second digit from the right counts twice
            return acc + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(F.reverse(digits), lambda d: total(d) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes the mod-97 check."""

    def rest(s: Column) -> Column:
        def add(acc, i):
            code = F.ascii(F.substring(s, i, F.lit(1)))
            return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)

    return let(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), lambda s: rest(s) == 1)


def _valid(check: str, m: Column) -> Column:
    if check == "none":
        return F.lit(True)
    if check == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(m))
    if check == "phone":
        return n.between(8, 15)
    if check == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|0000$")
    return n.between(16 if check == "card" else 13, 19 if check == "card" else 15) & luhn(_digits(m))


def _needs(text: Column, need: str) -> Column:
    if need == "digit":
        return text.rlike("[0-9]")
    return F.contains(text, F.lit({"at": "@", "plus": "+"}[need]))


def _score(kind: Kind, ahead: Column, after: Column) -> Column:
    if not kind.words:
        return F.lit(kind.base)
    near = F.lower(F.concat(F.right(ahead, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT)))).rlike(rf"\b(?:{kind.words})")
    return F.when(near, F.least(F.lit(1.0), F.lit(kind.base + 0.3))).otherwise(F.lit(kind.base))


def _iban(head: Column) -> Column:
    """The IBAN at the start of ``head``, or null: of its country's length or, if that is unknown, the longest that passes."""
    country = F.left(head, F.lit(2))
    listed = country.isin(*" ".join(IBAN_LENGTHS.values()).split())

    def ends(n: int) -> Column:
        able = country.isin(*IBAN_LENGTHS.get(n, "").split()) | ~listed
        return F.when(able, F.nullif(F.regexp_extract(head, rf"^(?:\x20?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])", 0), F.lit("")))

    return F.get(F.filter(F.array(*[ends(n) for n in reversed(IBAN_RANGE)]), lambda m: mod97(F.replace(m, F.lit(" "), F.lit("")))), 0)


def _iban_spans(text: Column, kind: Kind) -> Column:
    """All IBANs, in order. The pattern gives the places where one may begin; one that begins inside another is none."""
    # A head holds an IBAN with a space before each character, and its context. Each place is four characters and a gap.
    size = 2 * max(IBAN_RANGE) + CONTEXT

    def found(gaps: Column, matches: Column, starts: Column) -> Column:
        def ahead(i: Column) -> Column:
            last = F.least(i + size // 5, F.size(matches) - 1)
            return F.array_join(F.transform(F.sequence(i, last), lambda j: F.concat(matches[j], F.left(gaps[j + 1], F.lit(size)))), "")

        def lead(i: Column) -> Column:
            """What stands before the place, as far as context reaches."""
            first = F.greatest(i - CONTEXT // 4, F.lit(0))
            earlier = F.transform(F.sequence(first, i), lambda j: F.concat(F.when(j > first, matches[j - 1]).otherwise(F.lit("")), F.right(gaps[j], F.lit(CONTEXT))))
            return F.right(F.array_join(earlier, ""), F.lit(CONTEXT))

        def span(i: Column) -> Column:
            def ended(h: Column, m: Column) -> Column:
                return _span(kind, starts[i], starts[i] + F.length(m), _score(kind, lead(i), F.substr(h, F.length(m) + 1)), m.isNotNull())

            return let(F.left(ahead(i), F.lit(size)), lambda h: let(_iban(h), lambda m: ended(h, m)))

        def apart(until: Column, s: Column) -> tuple[Column, Column]:
            free = s["start"] >= until
            return F.when(free, s["end"]).otherwise(until), F.when(free, F.array(s)).otherwise(F.array().cast(SPAN))

        every = F.transform(F.sequence(F.lit(0), F.size(matches) - 1), span)
        return gather(_kept(every, kind), F.lit(0), apart, ONE)

    return _matched(text, kind, found)


def _span(kind: Kind, start: Column, end: Column, sure: Column, valid: Column) -> Column:
    return F.struct(F.lit(kind.name).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), sure.alias("score"), valid.alias("valid"))


def _kept(spans: Column, kind: Kind) -> Column:
    good = F.filter(spans, lambda s: s["valid"] & (s["score"] >= kind.least))
    return F.transform(good, lambda s: F.struct(*[s[x].alias(x) for x in ("kind", "start", "end", "score")])).cast(SPAN)


def _matched(text: Column, kind: Kind, found: Callable[[Column, Column, Column], Column]) -> Column:
    """``found(gaps, matches, starts)`` of the kind's pattern; no spans where the text cannot have a match."""
    pattern, none = kind.pattern, F.array().cast(SPAN)

    def placed(gaps: Column, matches: Column) -> Column:
        # A match starts where its gap ends: after all earlier gaps and matches.
        sizes = F.transform(gaps, lambda g, i: (F.length(g) + F.coalesce(F.length(F.get(matches, i)), F.lit(0))).cast("long"))
        starts = lambda sums: F.transform(matches, lambda m, i: sums[i] + F.length(gaps[i]))
        return F.when(F.size(matches) > 0, let(let(before(sizes), starts), lambda at: found(gaps, matches, at))).otherwise(none)

    spans = let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: placed(gaps, ms)))
    return F.when(_needs(text, kind.need), spans).otherwise(none)


def _spans(text: Column, kind: Kind) -> Column:
    """All valid spans of one kind, in order."""
    if kind.check == "iban":
        return _iban_spans(text, kind)

    def found(gaps: Column, matches: Column, starts: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            return _span(kind, starts[i], starts[i] + F.length(match), _score(kind, gaps[i], gaps[i + 1]), _valid(kind.check, match))

        return _kept(F.transform(matches, span), kind)

    return _matched(text, kind, found)


def base_spans(text: Column) -> Column:
    """The contract's kinds: an array of (kind, start, end, score), by kind as listed, then start.

    In code points, end exclusive; null and empty texts have none.
    """
    return F.concat(*[_spans(F.coalesce(text, F.lit("")), k) for k in BASE])


def added_spans(text: Column) -> Column:
    """What the method adds, in the same form."""
    return F.concat(*[_spans(F.coalesce(text, F.lit("")), k) for k in ADDED])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind, as in ``[email]``.

    Where spans overlap, the earliest (of those, the longest) stands for the rest, and what
    sticks out of it goes as well. A null text stays null. An ``n_chars`` column follows the new
    text; other columns and repeated rows are kept.
    """
    spans = unused(docs, "spans")
    found = docs.withColumn(spans, F.concat(base_spans(F.col("text")), added_spans(F.col("text"))))
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind")))
    )

    def step(pos, s):
        start, end = s["start"], -s["until"]
        pieces = F.array(F.substr("text", pos + 1, start - pos), F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.greatest(pos, end), F.when(start >= pos, pieces).otherwise(F.array().cast("array<string>"))

    rest = F.substr("text", F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length("text"))
    clean = F.concat(F.array_join(gather(ordered, F.lit(0), step, "string"), ""), rest)
    touched = F.size(spans) > 0
    out = found.withColumn("text", F.when(touched, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(spans)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(name: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts, digest and all spans; other columns are ignored."""
    found = docs.select("doc_id", base_spans(F.col("text")).alias("base"), added_spans(F.col("text")).alias("added"))
    return found.select(
        "doc_id", *[_count(k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.round(F.aggregate(F.concat("base", "added"), F.lit(0.0), lambda a, s: F.greatest(a, s["score"])), 6).alias("top_score"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole of ``documents``."""
    return pii_digest(table(spark, sf_dir, "documents"))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the query above that SQL can say as well."""
    return op10_pii(spark, sf_dir).select("doc_id", *[f"n_{k.name}" for k in BASE], "base_sha256")


def _sql() -> str:
    plain = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+",
        "card": "[0-9](?:[\\x20-]?[0-9])+", "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"substr({digits}, (length({digits}) - k)::INTEGER, 1)::INTEGER * (1 + k % 2)"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda k: CASE WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END)) % 10 = 0"
    valid = {
        "email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    parts = ",\n".join(
        f"""{kind}_m AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, gaps, ms FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms FROM d)),
{kind}_s AS (SELECT doc_id, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start FROM {kind}_m)"""
        for kind, p in plain.items()
    )
    every = " UNION ALL ".join(f"SELECT doc_id, {n} AS k, '{kind}' AS kind, start, start + length(m) AS stop FROM {kind}_s WHERE {valid[kind]}" for n, kind in enumerate(plain))
    counts = ", ".join(f"count(kind) FILTER (kind = '{kind}') AS n_{kind}" for kind in plain)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{parts},
every AS ({every})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k, start), '')) AS base_sha256
FROM d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id
"""


QUERIES = {"op10_pii": op10_pii, "base_personal_data": base_personal_data}
ORACLES = {"base_personal_data": _sql()}
