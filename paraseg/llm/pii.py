"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow from fixed patterns and checks. Wider patterns give candidates; four labelers
(strict pattern, gazetteer, context around the span, shape) vote for or against each, or abstain. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind; its posteriors
train a naive Bayes classifier over span features. Candidates it accepts are added where no base span lies.

All work on texts is done with built-in functions. Only the counts by feature combination, at most a few thousand rows
whatever the corpus, come to the driver, where EM runs.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
# Possessive forms of the base patterns: they match the same and never go back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)+"
NUMBER = r"\+?+[0-9](?:[().\x20-]{0,3}[0-9])++"
SECRET = r"(?i:token|secret|password|api[_-]?key)\x20{0,3}[=:]\x20{0,3}\"[^\"\n]++\""
# Words and prefixes that speak for a kind, or against personal data.
TOP_DOMAINS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "ai", "app", "dev", "co", "me", "tv", "eu", "uk", "us", "ca", "mx", "br",
    "ar", "cl", "au", "nz", "jp", "cn", "kr", "in", "sg", "hk", "tw", "de", "at", "ch", "fr", "be", "nl", "lu", "es", "pt", "it", "gr", "ie", "dk",
    "se", "no", "fi", "pl", "cz", "sk", "hu", "ro", "bg", "hr", "si", "rs", "ua", "ru", "tr", "il", "ae", "sa", "za", "ng", "ke", "eg",
]
COUNTRY_CODES = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30)"
RESERVED_IP = r"^(0|10|127|169\.254|192\.168|255)\."
HINTS = {"email": "mail|contact|write|@", "ip": "ip|server|host|address|from", "card": "card|visa|pay|credit", "phone": "tel|phone|call|mobile|fax", "secret": "auth|login|config"}
AGAINST = r"(version|isbn|issn|doi|page|order|invoice|serial|build|figure|table|chapter|section|id|no\.|nr\.)\W*$"
UNITS = r"^\s?(%|px|km|kg|cm|mm|ms|gb|mb|kb|usd|eur|percent|pages|items|€|\$)(\W|$)"
CONTEXT_CHARS = 24
THRESHOLD = 0.9
SMOOTHING = 0.1
ROUNDS = 50
FEATURES = ["kind", "pattern", "gazetteer", "context", "shape", "length", "digits", "spaced"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also if ``body`` reads it in a lambda."""
    return F.transform(F.array(value), body)[0]


#: Steps of running sums and of binary search: for arrays of up to 2**31 items.
POWERS = [1 << k for k in range(31)]


def running(values: Column, combine) -> Column:
    """Running totals of an array: in each round, every item takes in the one a power of two before it.

    A round makes one array, so an array of n items takes n log n steps; appending to an array n times copies it n times.
    """
    taken = lambda all_, step: F.transform(all_, lambda x, i: F.when(i >= step, combine(x, F.get(all_, i - step))).otherwise(x))
    rounds = lambda n: F.filter(F.array(*map(F.lit, POWERS)), lambda step: step < n)
    return _let(values, lambda own: _let(F.size(own), lambda n: F.aggregate(rounds(n), own, taken)))


def below(ascending: Column, value: Column) -> Column:
    """How many items of an ascending array are less than ``value``, by binary search."""
    steps = F.filter(F.array(*map(F.lit, reversed(POWERS))), lambda step: step <= F.size(ascending))
    move = lambda at, step: F.when((at + step <= F.size(ascending)) & (F.get(ascending, at + step - 1) < value), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), move)


def _wide(text: Column) -> Column:
    """A text with four bytes a character, so that a place in it is found without reading what is before."""
    return F.encode(text, "UTF-32")


def _cut(wide: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(wide, start * 4 + 1, F.greatest(end - start, F.lit(0)) * 4), "UTF-32")


def _located(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: start, end (code points, end exclusive) and value."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ends = lambda values: running(F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda gap, value: F.length(gap) + F.length(value)), lambda a, b: a + b)
    span = lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
    return _let(found, lambda values: F.zip_with(values, ends(values), span))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def worth(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b)
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))


NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _kind(kind: str, found: Column, holds, needed: Column) -> Column:
    spans = F.filter(found, lambda s: F.coalesce(holds(s["value"]), F.lit(False))) if holds else found
    spans = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(needed, spans).otherwise(F.array().cast(NO_SPANS))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``candidates``: arrays of spans. A null text has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    numbers, at, plus = F.regexp_like(text, F.lit("[0-9][^A-Za-z]{0,3}[0-9]")), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    many = lambda value: F.length(_digits(value)).between(9, 15)
    base = F.concat(
        _kind("email", _located(text, EMAIL), None, at),
        _kind("ip", _located(text, IP), _octets, numbers & F.contains(text, F.lit("."))),
        _kind("card", _located(text, CARD), _luhn, numbers),
        _kind("phone", _located(text, PHONE), many, plus),
    )
    wide = at | F.regexp_like(text, F.lit(r"[\[(]at[\])]"))
    numbered = F.transform(
        F.filter(_located(text, NUMBER), lambda s: F.length(_digits(s["value"])) >= 7),
        lambda s: F.struct(
            F.when(F.regexp_like(s["value"], F.lit(r"^[0-9]+(\.[0-9]+){3}$")), "ip")
            .when(F.regexp_like(s["value"], F.lit(r"^[0-9 -]+$")) & F.length(_digits(s["value"])).between(13, 19), "card")
            .otherwise("phone").alias("kind"),
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        ),
    )
    secret = F.regexp_like(text, F.lit(r"[=:]\x20{0,3}\""))
    wider = F.concat(
        _kind("email", _located(text, WIDE_EMAIL), None, wide),
        F.when(numbers, numbered).otherwise(F.array().cast(NO_SPANS)),
        _kind("secret", _located(text, SECRET), None, secret),
    )
    docs = docs.withColumns({"base": base, "candidates": wider})

    def judged(wide: Column) -> Column:
        before = lambda s: F.lower(_cut(wide, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"]))
        after = lambda s: F.lower(_cut(wide, s["end"], s["end"] + CONTEXT_CHARS))
        vote = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *_votes(s["kind"], s["value"], before(s), after(s)))
        return F.transform("candidates", vote)

    return docs.withColumn("candidates", _let(_wide(F.when(F.size("candidates") > 0, text).otherwise("")), judged))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def _votes(kind: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """The labelers' votes and the features of a span."""
    like = lambda text, pattern: F.regexp_like(text, F.lit(pattern))
    pick = lambda of: F.coalesce(*(F.when(kind == k, x) for k, x in of.items()), F.lit(0))
    digits = _digits(value)
    pattern = pick({
        "email": _vote(like(value, "^" + EMAIL + "$"), F.lit(False)),
        "ip": _vote(_octets(value), ~_octets(value)),
        "card": _vote(_luhn(value), ~_luhn(value)),
        "phone": _vote(F.startswith(value, F.lit("+")) & F.length(digits).between(9, 15), ~F.startswith(value, F.lit("+")) | (F.length(digits) > 15)),
        "secret": F.lit(1),
    })
    known = F.array_contains(F.array(*map(F.lit, TOP_DOMAINS)), F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)))
    gazetteer = pick({
        "email": _vote(known, ~known),
        "ip": _vote(~like(value, RESERVED_IP), like(value, RESERVED_IP)),
        "card": _vote(like(digits, CARD_ISSUERS), ~like(digits, CARD_ISSUERS)),
        "phone": _vote(like(value, COUNTRY_CODES), ~like(value, COUNTRY_CODES)),
    })
    hinted = F.coalesce(*(F.when(kind == k, like(before, f"({words})")) for k, words in HINTS.items()), F.lit(False))
    context = _vote(hinted, like(before, AGAINST) | like(after, UNITS))
    shape = pick({
        "email": _vote(F.length(value).between(6, 80), F.length(value) > 80),
        "ip": _vote(like(value, r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), ~like(value, r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "card": _vote(like(value, r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"), F.lit(False)),
        "phone": _vote(like(value, r"^\+[0-9]{1,3}[ -]"), like(value, r"\.")),
        "secret": _vote(like(value, r"\"[^\" ]{16,}\"$"), like(value, r"\"[^\"]{1,6}\"$")),
    })
    return [
        pattern.alias("pattern"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"),
        F.least(F.length(value) / 4, F.lit(10)).cast("int").alias("length"), F.least(F.length(digits) / 2, F.lit(10)).cast("int").alias("digits"),
        like(value, "[ ()-]").cast("int").alias("spaced"),
    ]


VOTES = ["pattern", "gazetteer", "context", "shape"]


def fit(found: DataFrame, rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of the span classifier, by ``kind:feature:value`` and ``kind`` alone, from all candidates of ``found``.

    ``rounds`` of expectation maximisation at most; with none, the first guess from the strict pattern trains the classifier.
    """
    rows = found.select(F.explode("candidates").alias("c")).groupBy(*(F.col(f"c.{n}").alias(n) for n in FEATURES)).count().collect()
    rows = sorted((tuple(r[n] for n in FEATURES), r["count"]) for r in rows)
    weights: dict[str, float] = {}
    for kind in sorted({r[0][0] for r in rows}):
        own = [(dict(zip(FEATURES, values)), n) for values, n in rows if values[0] == kind]
        # The strict pattern speaks first; EM then learns how far the others can be trusted.
        soft = [0.5 + 0.4 * r["pattern"] + 0.02 * (r["gazetteer"] + r["context"] + r["shape"]) for r, _ in own]
        for _ in range(rounds):
            yes = sum(p * n for p, (_, n) in zip(soft, own))
            no = sum((1 - p) * n for p, (_, n) in zip(soft, own))
            said: dict[tuple, list[float]] = {}
            for p, (r, n) in zip(soft, own):
                for name in VOTES:
                    cell = said.setdefault((name, r[name]), [0.0, 0.0])
                    cell[0] += p * n
                    cell[1] += (1 - p) * n
            after = []
            for r, _ in own:
                odds = log((yes + SMOOTHING) / (no + SMOOTHING))
                for name in VOTES:
                    a, b = said[name, r[name]]
                    odds += log((a + SMOOTHING) / (yes + 3 * SMOOTHING)) - log((b + SMOOTHING) / (no + 3 * SMOOTHING))
                after.append(1 / (1 + exp(-max(-40.0, min(40.0, odds)))))
            change, soft = max(abs(a - b) for a, b in zip(after, soft)), after
            if change < 1e-9:
                break
        yes = sum(p * n for p, (_, n) in zip(soft, own))
        no = sum((1 - p) * n for p, (_, n) in zip(soft, own))
        weights[kind] = log((yes + SMOOTHING) / (no + SMOOTHING))
        for name in FEATURES[1:]:
            values = sorted({r[name] for r, _ in own})
            for value in values:
                a = sum(p * n for p, (r, n) in zip(soft, own) if r[name] == value)
                b = sum((1 - p) * n for p, (r, n) in zip(soft, own) if r[name] == value)
                weights[f"{kind}:{name}:{value}"] = log((a + SMOOTHING) / (yes + len(values) * SMOOTHING)) - log((b + SMOOTHING) / (no + len(values) * SMOOTHING))
    return weights


def probability(span: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability that a candidate is personal data."""
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    odds = F.coalesce(F.try_element_at(table, span["kind"]), F.lit(0.0))
    for name in FEATURES[1:]:
        key = F.concat_ws(":", span["kind"], F.lit(name), span[name].cast("string"))
        odds = odds + F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def with_spans(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``found`` with ``spans``: base spans and accepted candidates clear of them, by kind as listed, then start."""
    # Base spans by start, and the furthest end up to each: what a candidate meets is told by the last one before its end.
    ordered = F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))

    def apart(base: Column) -> Column:
        starts, ends = base["starts"], base["ends"]
        meets = lambda s: F.coalesce(F.get(ends, below(starts, s["end"]) - 1) > s["start"], F.lit(False))
        return F.filter("candidates", lambda s: ~meets(s))

    tables = lambda spans: F.struct(spans["start"].alias("starts"), running(spans["end"], F.greatest).alias("ends"))
    clear = _let(ordered, lambda spans: _let(tables(spans), apart))
    added = F.filter(clear, lambda s: probability(s, weights) >= THRESHOLD)
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    plain = lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return found.withColumn("spans", F.array_sort(F.concat(F.transform("base", plain), F.transform(added, plain))))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of spans that overlap, the first to start counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def joined(parts: Column) -> Column:
        wide, own, ends = parts["wide"], parts["spans"], parts["ends"]
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        name = lambda s: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        # What is left between the spans so far and a span that begins after them; one that begins earlier only adds to them.
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(_cut(wide, before(i), s["start"]), name(s))).otherwise("")
        rest = _cut(wide, F.element_at(ends, -1), (F.octet_length(wide) / 4).cast("int"))
        return F.concat(F.array_join(F.transform(own, piece), ""), rest)

    parts = lambda own: F.struct(_wide(text).alias("wide"), own.alias("spans"), running(own["end"], F.greatest).alias("ends"))
    return F.when(F.size(spans) > 0, _let(ordered, lambda own: _let(parts(own), joined))).otherwise(text)
