"""Quality rules, URL filter, personal data, licences and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from passagemill.llm import licenses, mixing, pii, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def measured(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, nothing):
    rows, df = docs
    got = by_id(quality_rules.judge(df).collect())
    assert sum(map(len, got.values())) == len(rows)
    for i, t, *_ in rows:
        for r in got[i]:
            want = measured(t)
            ends = [x.rstrip(" ")[-1:] in quality_rules.ENDINGS for x in (t or "").split("\n") if WORD.search(x)]
            assert (r["n_text_lines"], r["n_ended"], r["n_digits"]) == (len(ends), sum(ends), len(re.findall("[0-9]", t or "")))
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["kept"] and r["base_failed"])
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, rs in got.items() for r in rs if r["kept"])
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


def test_posteriors_by_brute_force():
    """One round of expectation-maximisation over single documents, in plain loops, leaves the fitted posteriors as they are."""
    import math

    r = random.Random(3)
    docs = [r.choices([0, 8, 13, 26, 17, 24], [1, 2, 3, 20, 4, 5])[0] for _ in range(500)]
    rules, counts = 3, dict(Counter(docs))
    post = quality_rules.fit(counts, rules, 400)
    votes = [quality_rules.unpack(c, rules) for c in docs]
    weight, begin = len(docs) / 10, {1: 0.005, 0: 0.12}
    good = [post[c] for c in docs]
    prior = (sum(good) + 0.8 * weight) / (len(docs) + weight)
    share = {}
    for y in (1, 0):
        for j in range(rules):
            said = sum((g if y else 1 - g) for g, v in zip(good, votes) if v[j])
            bad = sum((g if y else 1 - g) for g, v in zip(good, votes) if v[j] < 0)
            share[y, j] = (bad + weight * begin[y]) / (said + weight)
    for c, v in zip(docs, votes):
        p = {y: (prior if y else 1 - prior) * math.prod(share[y, j] if x < 0 else 1 - share[y, j] for j, x in enumerate(v) if x) for y in (1, 0)}
        assert abs(post[c] - p[1] / (p[1] + p[0])) < 1e-6


def test_weak_supervision_finds_the_class():
    r = random.Random(1)
    counts, truth = Counter(), defaultdict(Counter)
    for _ in range(4000):
        good = r.random() < 0.85
        votes = [(1 if r.random() < 0.95 else 0) if good else (-1 if r.random() < 0.4 else 1) for _ in range(5)]
        code = 0
        for v in votes:
            code = code * 3 + v + 1
        counts[code] += 1
        truth[code][good] += 1
    post = quality_rules.fit(dict(counts), 5)
    right = sum(n for c, t in truth.items() for good, n in t.items() if (post[c] >= 0.5) == good)
    assert right / 4000 > 0.97
    assert quality_rules.unpack(0, 3) == [-1, -1, -1] and quality_rules.unpack(26, 3) == [1, 1, 1]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "mail a.b+c@x-y.example.com, a@b, x@y.z.", "aé1@b.c%d@e.f..g@h.i", "1.2.3.4 256.1.1.1 1.2.3.4.5 000.000.000.0255 01.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4041894974608795",
    "+1 (988) 555-2485 and +49 30 123 or +1234567890123456", "my IBAN DE89 3704 0044 0532 0130 00 here", "ssn 078-05-1120, tel", "no 378282246310005 context card 378282246310005", "🙂 é a@b.co 🙂 10.0.0.1",
    "a" * 3000 + "@" + "b." * 2000 + "c", "1" * 4000, "@" * 50, "..@..", None, "",
]


def test_personal_data(spark, nothing):
    r = random.Random(5)
    alphabet = list("0123456789") * 3 + list(". -@+()ab%é🙂\n") * 2 + ["4111111111111111", "a@b.c", "+1 555 123 4567", "10.1.2.3"]
    texts = PERSONAL + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for row in pii.pii_digest(df).collect():
        want = spans(texts[row["doc_id"]])
        assert row["spans"].split(",")[: len(want)] == want or (want == [] and not re.match("email|ip|card|phone", row["spans"]))
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for kind in PATTERNS:
            assert row[f"n_{kind}"] == sum(s.startswith(kind) for s in want)
    added = {r["doc_id"]: r["spans"] for r in pii.pii_digest(df).where("n_added > 0").collect()}
    assert "iban:8:35" in added[5] and "ssn:4:15" in added[6] and added[7].count("shortcard") == 2
    assert pii.pii_digest(nothing).count() == 0


def test_personal_data_in_long_texts(spark):
    """Many spans in one text: as many as there are, in their places, in linear time."""
    text = "x a@b.co 🙂 10.0.0.1, " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = pii.pii_digest(df).collect()
    want = spans(text)
    assert row["n_email"] == row["n_ip"] == 20_000 and row["spans"].split(",") == want
    (clean,) = pii.redact(df).collect()
    assert clean["text"] == "x [email] 🙂 [ip], " * 20_000
    assert pii.redact(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(0, "🙂 a@b.co and 10.0.0.1!", 9), (1, None, 9), (2, "clean", 5), (3, "x +4111111111111111 y", 0)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in pii.redact(df.withColumn("spans", F.lit(1))).collect()}
    assert rows[0]["text"] == "🙂 [email] and [ip]!" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[1]["text"] is None and rows[2]["text"] == "clean" and rows[3]["text"] == "x [card] y" or rows[3]["text"] == "x +[card] y"
    assert rows[2]["spans"] == 1


IBANS = {
    "pay DE89370400440532013000 BIC COBADEFFXXX": ["DE89370400440532013000"],
    "GB29 NWBK 6016 1331 9268 19 IN full": ["GB29 NWBK 6016 1331 9268 19"],
    "GB82WEST12345698765432 2024-01-01": ["GB82WEST12345698765432"],
    "NO9386011117947 NO9386011117947": ["NO9386011117947"] * 2,
    "🙂 GB20 DE89 3704 0044 0532 0130 00 X1": ["DE89 3704 0044 0532 0130 00"],
    "MT84MALT011000012345MTLCAST001S": ["MT84MALT011000012345MTLCAST001S"],
    "DE89370400440532013001 BIC, DE8937040044053201300 X, GB82WEST12345698765432X": [],
    "AA11 " * 2000: [],
}


def test_ibans_before_capitals_and_digits(spark):
    texts = list(IBANS)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in pii.pii_digest(df).collect():
        found = [s.split(":") for s in row["spans"].split(",") if s.startswith("iban")]
        t = texts[row["doc_id"]]
        assert [t[int(a) : int(b)] for _, a, b in found] == IBANS[t]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[0] == "pay [iban] BIC COBADEFFXXX" and clean[1] == "[iban] IN full" and clean[2] == "[iban] 2024-01-01"


def rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://A.Net", "http://a.net/", "https://x.example.net/en/1?q#f", "https://example.com/de/x", "http://example.com/den", "ftp://b.org/fr/", "http://b.org/frx",
        "http://m.casino-win.example.com:80/en/1", "http://xcasino-win.example.com/", "https://adult-x.example.org/fr/1", "http://u@host.com/a://b?c", "x://notexample.net/en/", "http://listed.io/a/?utm_source=z&b=2&a=1#k",
        "http://www.listed.io/a?a=1&b=2", "http://listed.io/a",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(5, urls[5], "h")], "page_id long, url string, host string")
    listed = url_filter.listed_sites(spark).union(spark.createDataFrame([("listed.io/a?a=1&b=2",), (None,), ("listed.io/a?a=1&b=2",)], "entry string"))
    rows = url_filter.url_filter(pages, listed).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        u = urls[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0] if "://" in u else ""
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (r["host"], r["path"]) == (host, path)
        found = rule(host, path)
        assert r["rule"] == (found[1] if found else None)
        hit = r["page_id"] in (11, 16, 17)
        assert r["verdict"] == (found[0] if found else "block" if hit else "allow"), u
    assert url_filter.url_filter(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_forms_of_entries(spark):
    """Entries mean the same with and without scheme, www., port, tracking parameters and last slash."""
    pages = ["http://www.listed.io/a?utm_source=1", "https://listed.io/a/#x", "http://m.listed.io/a", "http://listed.io/b", "http://listed.io/", "http://m.site.org/x?y", "http://xsite.org/", "http://q.io/?b=2&a=1"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    for entry, hit in {
        "http://www.listed.io/a": {0, 1}, "listed.io/a": {0, 1}, "LISTED.io/a/": {0, 1}, "https://listed.io:443/a?ref=x": {0, 1}, " listed.io/a ": {0, 1}, "listed.io/A": set(),
        "listed.io": {0, 1, 2, 3, 4}, "http://listed.io/": {0, 1, 2, 3, 4}, "site.org": {5}, "m.site.org/": {5}, "m.site.org/x": set(), "q.io?a=1&b=2": {7}, "": set(), "/a": set(), "http://": set(),
    }.items():
        got = url_filter.url_filter(df, spark.createDataFrame([(entry,)], "entry string")).where("listed is not null").collect()
        assert {r["page_id"] for r in got} == hit, entry


def test_listed_pages_as_in_sql(spark, tmp_path):
    import duckdb

    urls = ["https://www.example.com/ads/?utm_source=1&id=1", "http://example.com/ads?id=2", "http://EXAMPLE.org:80/spam", "http://m.example.org/spam", "https://example.net/tracking/pixel.gif#x", "http://a.b.doubleclick.net/x",
            "http://a.criteo.com/en", "http://notcriteo.com/", "https://x.casino-win.example.com/q?a=1", "http:///x", "criteo.com", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict", "listed"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({url_filter.OP9_SQL})").fetchall()
    got = [tuple(r) for r in url_filter.op9_url_filter(spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[0] for r in got if r[5]} == {0, 2, 6, 8}


def test_filter_of_a_long_list(spark, monkeypatch):
    """Too large to broadcast, it is joined by block, with the same result and as few false hits."""
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 64)
    listed = spark.range(40_000).select(F.concat(F.lit("http://site"), "id", F.lit(".example/p?x=1")).alias("entry"))
    pages = spark.range(0, 80_000, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.site"), "id", F.lit(".example/p/?x=1")).alias("url"))
    blocked = {r["page_id"] for r in url_filter.url_filter(pages, listed).where("verdict = 'block'").collect()}
    assert blocked == set(range(0, 40_000, 7))
    words = url_filter.bloom(listed.select(url_filter.canonical_entry(F.col("entry")).alias("entry")), 10_000)
    probes = spark.range(50_000, 60_000).select(F.concat(F.lit("other"), "id", F.lit("/")).alias("entry"))
    probes = probes.select(url_filter._block(F.col("entry"), 10_000).alias("block"), url_filter._mask(F.col("entry")).alias("mask"))
    assert probes.join(words, "block").where("word & mask = mask").count() < 500


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("site"), "id", F.lit("/")).alias("entry"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://site"), "id", F.lit("/x")).alias("url"))
    blocked = {r["page_id"] for r in url_filter.url_filter(pages, listed).where("verdict = 'block'").collect()}
    assert blocked == set(range(3000))


def bigrams(t):
    w = re.findall("[a-z0-9]+", t.lower())
    return set(zip(w, w[1:]))


def test_licenses(spark, nothing):
    r = random.Random(3)
    texts = [None, "", "MIT", "Released under the MIT License.", "released UNDER the mit license", "line\nLicensed under CC BY-NC 4.0.\nline", licenses._MIT, licenses._MIT.replace("copy", "duplicate"), "word " * 3000]
    for _ in range(60):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = "x"
        cut = r.randrange(len(words))
        texts.append(r.choice(["", "a b c\n\n"]) + " ".join(words[:cut]) + r.choice([" ", "\n"]) + " ".join(words[cut:]))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, unit int")
    want = set()
    for i, t in enumerate(texts):
        t = t or ""
        paragraphs = re.split(r"\n[ \t]*\n", t)
        units = [("line", k, x) for k, x in enumerate(t.split("\n"))] + [("paragraph", k, x) for k, x in enumerate(paragraphs) if "\n" in x]
        units += [("text", 0, t)] if len(paragraphs) > 1 else []
        for kind, k, body in units:
            g = bigrams(body)
            best = max(((2 * len(g & bigrams(x)) / (len(g) + len(bigrams(x))), -n, name) for n, (name, x) in enumerate(licenses.TEMPLATES) if g), default=(0, 0, ""))
            if best[0] >= 0.8:
                want.add((i, kind, k, best[2], round(best[0], 6)))
    assert {tuple(r) for r in licenses.scan_licenses(df).collect()} == want and len(want) > 30
    assert licenses.scan_licenses(nothing).count() == 0


def test_texts_that_are_not_looked_at_have_no_notice():
    """What keeps most of a template's bigrams has one of the words that are looked for."""
    r = random.Random(1)
    words = set(licenses._keys(80))
    pattern = re.compile(licenses._one_of(sorted(words)) + r"\b")
    assert all(pattern.fullmatch(w) for w in words) and not pattern.fullmatch("licen") and not pattern.fullmatch("licensing")
    for _, text in licenses.TEMPLATES:
        grams = sorted(bigrams(text))
        least = licenses._least(len(grams), 80)
        free = [g for g in grams if not words & set(g)]
        assert len(free) < least  # without any of the words too few bigrams can be shared
        for _ in range(20):
            assert any(words & set(g) for g in r.sample(grams, least))


def matched(body):
    g = bigrams(body)
    return any(2 * len(g & bigrams(x)) >= 0.8 * (len(g) + len(bigrams(x))) for _, x in licenses.TEMPLATES if g)


def notices(t):
    """All runs of words outside matched units, best per first word, then of those that overlap the one that shares most."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    left = []
    for p in re.split(r"\n[ \t]*\n", t):
        for line in p.split("\n"):
            left += [None if any(map(matched, (t, p, line))) else w for w in words(line)]
    found = []
    for s in range(len(left)):
        own = []
        for n, (name, x) in enumerate(licenses.TEMPLATES):
            target, g = bigrams(x), set()
            for e in range(s, min(s + int((len(words(x)) - 1) * 1.5), len(left) - 1)):
                g.add((left[e], left[e + 1]))
                both = len(g) + len(target)
                if 200 * len(g & target) >= 80 * both:
                    own.append((-2.0 * len(g & target) / both, s, e, n, name, len(g & target)))
        for n in {r[3] for r in own}:
            found.append(min(r for r in own if r[3] == n))
    chosen = []
    for r in sorted(found, key=lambda r: (-r[5], r)):
        if all(r[1] > x[2] + 1 or x[1] > r[2] + 1 for x in chosen):
            chosen.append(r)
    return {("notice", r[1], r[4], round(-r[0], 6)) for r in chosen}


def test_notices_inside_other_text(spark, nothing):
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["the", "of", "software", "license", "and", str(r.randrange(999)), str(r.randrange(999))]) for _ in range(n))
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    whole, bsd = licenses.TEMPLATES[-3][1], licenses.TEMPLATES[-1][1]
    halves = whole.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE").split("\n\n")
    texts = [
        f"{prose(100)}\n\n" + "\n\n".join(wrap(x, 12) for x in halves) + f"\n\n{prose(60)}",
        f"{prose(90)}\n{wrap(bsd, 11)}\n{prose(90)}",
        "This code is released under the MIT License. See the file for more.\nLicensed under CC BY 4.0.\nAll of it is licensed under CC BY-NC 4.0, and that is that.",
        "Ours is released under the MIT License, theirs of course is licensed under the Apache License, Version 2.0, and so on.",
        prose(300), "the license", None, "",
    ]
    for _ in range(25):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = "x"
        text = wrap(f"{prose(r.randint(0, 30))} {' '.join(words)} {prose(r.randint(0, 30))}", r.randint(5, 40))
        texts.append(text.replace("\n", "\n\n", r.randint(0, 2)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for i, *row in licenses.embedded_notices(df).collect():
        got[i].add(tuple(row))
    for i, t in enumerate(texts):
        assert got[i] == notices(t or ""), t
    names = {i: sorted(x[2] for x in rows) for i, rows in got.items()}
    assert names[0] == ["mit"] and names[1] == ["bsd"] and names[2] == ["cc-by-nc-4.0", "mit"] and names[3] == ["apache-2.0", "mit"]
    assert licenses.embedded_notices(nothing).count() == 0


def test_query_reports_embedded_notices(spark, tmp_path):
    text = "This code is released under the MIT License. See the file for more.\nLicensed under CC BY 4.0."
    spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Counter((r["doc_id"], r["unit"], r["unit_no"], r["license"]) for r in licenses.op5_licenses(spark, str(tmp_path)).collect())
    assert rows == {(1, "line", 1, "cc-by-4.0"): 2, (1, "notice", 3, "mit"): 2}


def test_mix_deviation_and_rows(spark, docs, nothing):
    rows, df = docs
    got = mixing.mix_sources(df, block=500).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    for source in {r["source"] for r in got}:
        own = sorted((r["place"], r["block"], r["slot"], r["n_chars"]) for r in got if r["source"] == source)
        assert own[0][0] == 0 and all(b == p // 500 for p, b, *_ in own)
        assert [s for _, _, s, _ in own] == sorted(s for _, _, s, _ in own)
    assert mixing.mix_sources(nothing).count() == 0


def earliest_deadlines(weights, slots):
    """Who gets each slot, worked out slot by slot over all sources in exact fractions."""
    total, done, out = sum(weights.values()), dict.fromkeys(weights, 0), []
    for t in range(slots):
        able = [x for x in weights if weights[x] and done[x] * total // weights[x] <= t]
        out.append(min(able, key=lambda x: (-(-(done[x] + 1) * total // weights[x]), x)))
        done[out[-1]] += 1
    return out


def some_weights(n):
    r = random.Random(n)
    out = {f"s{i:04}": Fraction(r.choice([0, 1, 2, 3, 5, 50])) for i in range(n)}
    return out | {"s0000": Fraction(2 * n)}


@pytest.mark.parametrize("n", [1, 3, 20, 100, 1000])
def test_schedule_is_edf_within_a_block_of_the_target(n):
    weights = some_weights(n)
    total = sum(weights.values())
    slots, q = mixing.shares(weights)
    assert all(Fraction(q[x], slots) == w / total for x, w in weights.items())
    at = mixing.place(slots, q, slots)
    mine = {t: x for x, own in at.items() for t in own}
    few = min(slots, 400)
    assert [mine[t] for t in range(few)] == earliest_deadlines(weights, few) and sorted(mine) == list(range(slots))
    for x, own in at.items():
        assert weights[x] and len(own) == q[x]
        w = weights[x] / total
        assert all(abs(k - t * w) < 1 and abs(k + 1 - (t + 1) * w) < 1 for k, t in enumerate(own))


def test_weights_without_a_common_denominator():
    weights = {f"s{i}": Fraction((i + 1) ** 0.5) for i in range(50)} | {"none": Fraction(0), "least": Fraction(1, 10**12)}
    slots, q = mixing.shares(weights, 1 << 12)
    total = sum(weights.values())
    assert slots == sum(q.values()) == 1 << 12 and q["none"] == 0 and q["least"] == 1
    assert all(abs(Fraction(q[x], slots) - w / total) < Fraction(2, slots) for x, w in weights.items())
    assert mixing.shares({"a": Fraction(0)}) == (0, {"a": 0})


def test_mix_by_brute_force(spark):
    """Rows' places, blocks and slots over several hyperperiods, with sources of weight zero."""
    r = random.Random(8)
    names = [None, "a", "b", "c", "z0", "z1"]
    rows = [(i, r.choice(names), "x" * r.choice([0, 3, 10, 25, 90])) for i in range(700)] + [(3, "a", "again")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 AS slot", "8 AS src", "9 AS piece", "1 AS chars", "2 AS at", "3 AS q")
    targets = spark.createDataFrame([(None, 0.25), ("a", 0.5), ("b", 0.1), ("b", 0.1), ("c", 0.05), ("z0", 0.0), ("gone", 5.0)], "source string, weight double")
    got = mixing.mix_sources(docs, targets, block=40).collect()
    assert Counter((x["doc_id"], x["source"], x["text"], x["src"], x["piece"], x["chars"], x["at"], x["q"]) for x in got) == Counter((*x, 8, 9, 1, 2, 3) for x in rows)
    weights = {"": Fraction(5), "a": Fraction(10), "b": Fraction(4), "c": Fraction(1)}
    order, blocks = earliest_deadlines(weights, 20), {}
    for x in {y["source"] or "" for y in got}:
        own = sorted(((y["place"], y["n_chars"], y["block"], y["slot"]) for y in got if (y["source"] or "") == x))
        total = 0
        for p, n, b, _ in own:
            assert p == total and b == p // 40
            total += n
        blocks[x] = {b: s for _, _, b, s in own}
    last = 0
    for x in weights:
        at = [t for t in range(20) if order[t] == x]
        every = lambda b: b // len(at) * 20 + at[b % len(at)]
        assert all(s == every(b) for b, s in blocks[x].items())
        size = sum(len(t) for _, y, t in rows if (y or "") == x)
        last = max(last, every(size // 40))
    for x in ("z0", "z1"):
        size = sum(len(t) for _, y, t in rows if y == x)
        assert all(s == last + 1 + b for b, s in blocks[x].items())
        last += size // 40 + 1


def share_errors(rows, weights):
    """The most that a source is off its weight, in blocks, at any slot before the first one has run out."""
    at = {x: sorted(r["slot"] for r in rows if r["source"] == x) for x in weights}
    end, total = min(max(own) for own in at.values()), sum(weights.values())
    out = {}
    for x, own in at.items():
        done, out[x] = 0, 0.0
        for t in range(end):
            done += done < len(own) and own[done] == t
            out[x] = max(out[x], abs(done - (t + 1) * weights[x] / total))
    return out


@pytest.mark.parametrize("given", [True, False])
def test_mix_keeps_target_weights_over_many_periods(spark, given):
    # One document a block, ten periods: a fixed period with forced slots was four blocks short in each.
    counts = {"hot": 5000} | {f"s{i}": 560 for i in range(9)}
    rows = [(f"{x}-{k}", x, "x" * 10) for x, n in counts.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    weights = {x: 0.5 if x == "hot" else 0.5 / 9 for x in counts} if given else {x: n**0.5 for x, n in counts.items()}
    targets = spark.createDataFrame(list(weights.items()), "source string, weight double") if given else None
    got = mixing.mix_sources(docs, targets, block=10).collect()
    assert len(got) == len(rows) == len({r["slot"] for r in got})
    assert max(share_errors(got, weights).values()) < 1.001


def test_mix_without_any_weight(spark):
    docs = spark.createDataFrame([(k, x, "x" * 10) for x in "ab" for k in range(5)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.0), ("c", 5.0)], "source string, weight double")
    got = mixing.mix_sources(docs, targets, block=10).collect()
    assert len(got) == 10 == len({r["slot"] for r in got}) and max(r["slot"] for r in got if r["source"] == "a") < min(r["slot"] for r in got if r["source"] == "b")
