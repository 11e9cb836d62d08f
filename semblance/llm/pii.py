"""Personal data by weak supervision.

Fixed patterns give the base spans.  Besides, looser candidates of several forms
are voted on by three labelers (form, gazetteer, context), each for, against or
silent.  Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is, and its posteriors train a naive Bayes classifier on
span features, which decides on the candidates that the patterns do not cover.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm import spans
from semblance.llm.text import body, lowered, named, picked

# Fixed patterns.  A run fails or matches from its first character, so a look-behind (or the last match's end) spares
# later starts; possessive loops match the same, without backtracking or recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

# Looser forms: (kind, pattern).
LOOSE = (
    ("spelled_email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[(\[]?at[)\]]?\x20?[A-Za-z0-9-]{2,64}\x20?[(\[]?dot[)\]]?\x20?[a-z]{2,6}(?![A-Za-z0-9])"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local_phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    ("person", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]{1,40}(?![A-Za-z])"),
)
KINDS = (*BASE, *(k for k, _ in LOOSE))
LEAD = 40  # code points before a span that the context labeler reads

# Fixed lists of the gazetteer and the context labeler.
DOMAINS = r"\b(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
COUNTRIES = r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE)"
NAMES = r"\b(?:Adams|Brown|Davis|Garcia|Johnson|Jones|Martin|Miller|Moore|Smith|Taylor|Thomas|Walker|White|Williams|Wilson)$"
CUES = {
    "email": "mail|contact|write", "spelled_email": "mail|contact|write|reach", "ip": "ip|host|address|server|login", "card": "card|visa|mastercard|amex|pay|credit",
    "phone": "phone|call|tel|mobile|fax|contact", "local_phone": "phone|call|tel|mobile|fax|contact", "national_id": "ssn|social|security|identity|id",
    "iban": "iban|account|bank|transfer", "person": "contact|signed|patient|dear|name|by",
}
AGAINST = r"version|isbn|issn|order|invoice|page|chapter|example of|section|serial"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a number of at most 19 digits is right."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.ascii(c) - 48 + F.when(i % 2 == 1, F.ascii(c) - 48 - F.when(F.ascii(c) > 52, 9).otherwise(0)).otherwise(0))
    return F.aggregate(figures, F.lit(0), lambda total, d: total + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    number = digits(value)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255))
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


def candidates(text: Column) -> tuple[Column, Column]:
    """(base, loose): the valid matches of the fixed patterns, and all other candidates."""
    some = text.rlike(r"[0-9@]|\b(?:Mr|Mrs|Ms|Dr|Prof)\.|dot")
    found = [(k, spans.matches(text, p, k)) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))]

    def right(kind: str, hits: Column) -> Column:
        return F.filter(hits, lambda s: valid(kind, s["value"]))

    base = F.concat(*[right(k, hits) for k, hits in found])
    loose = F.concat(*[spans.matches(text, p, k) for k, p in LOOSE])
    return F.when(some, base).otherwise(spans.none()), F.when(some, loose).otherwise(spans.none())


def of_kind(kind: Column, table: dict[str, Column], other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def votes(span: Column, text: Column) -> dict[str, Column]:
    """The labelers' votes, 1 for, -1 against, 0 silent, and the classifier's features; all of few values."""
    kind, value = span["kind"], span["value"]
    lead = F.lower(F.substring(text, F.greatest(span["start"] - LEAD, F.lit(0)) + 1, F.least(span["start"], F.lit(LEAD))))
    number = digits(value)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    form = of_kind(kind, {
        "national_id": yes(~number.rlike("^(?:000|666|9)|^[0-9]{3}00|0000$")), "local_phone": yes(number.rlike("^[2-9][0-9]{2}[2-9]")),
        "iban": yes(F.length(F.regexp_replace(value, " ", "")).between(15, 34)), "spelled_email": yes(value.rlike(r"[(\[]at[)\]]|\x20at\x20")),
    }, F.lit(1))
    listed = of_kind(kind, {
        "email": yes(value.rlike(DOMAINS)), "spelled_email": yes(value.rlike(DOMAINS)), "iban": yes(value.rlike(COUNTRIES)), "person": yes(value.rlike(NAMES)),
        "card": yes(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
    }, F.lit(0))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, lead.rlike(rf"\b(?:{words})")).otherwise(cue)
    context = F.when(lead.rlike(rf"\b(?:{AGAINST})"), -1).when(cue, 1).otherwise(0)
    length = F.least(F.floor(F.length(value) / 6), F.lit(6)).cast("int")
    share = F.floor(4 * F.length(number) / F.length(value)).cast("int")
    # Kind, length and share of digits hang together, so they are one feature.
    shape = F.concat_ws(":", kind, length.cast("string"), share.cast("string"))
    return {"shape": shape, "form": form, "listed": listed, "context": context}


LABELERS = ("form", "listed", "context")
FEATURES = ("shape", "form", "listed", "context")


def voted(text: Column, hits: Column) -> Column:
    return F.transform(hits, lambda s: s.withField("vote", F.struct(*[v.alias(k) for k, v in votes(s, text).items()])))


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list, dict]:
    """Prior, P(vote | class) for each labeler, and the posterior of each vote pattern, by expectation-maximisation.

    Starts from the share of votes for; counts are smoothed by one, so silent labelers stay neutral.
    """
    post = {p: min(0.95, max(0.05, 0.5 + 0.25 * sum(p))) for p in patterns}
    prior, tables = 0.5, []
    for _ in range(rounds):
        total, yes = sum(patterns.values()), sum(n * post[p] for p, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        tables = []
        for j in range(len(LABELERS)):
            own = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            # One labeler alone cannot turn: it is right more often than wrong before any row is seen.
            own[1, 1] += 2.0
            own[-1, 0] += 2.0
            for p, n in patterns.items():
                own[p[j], 1] += n * post[p]
                own[p[j], 0] += n * (1 - post[p])
            sums = {y: sum(own[v, y] for v in (-1, 0, 1)) for y in (0, 1)}
            tables.append({k: x / sums[k[1]] for k, x in own.items()})
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[p[j], 1] / t[p[j], 0]) for j, t in enumerate(tables))
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return prior, tables, post


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """The classifier: a bias and a weight for each feature value; at most a few thousand counts leave the cluster."""
    text = picked(docs, text_col).select(body(text_col).alias("t"))
    base, loose = candidates(F.col("t"))
    hits = text.select("t", F.concat(base, loose).alias("hits")).select(F.explode(voted(F.col("t"), F.col("hits"))).alias("s"))
    counts = [r.asDict() for r in hits.groupBy(*[F.col(f"s.vote.{k}").alias(k) for k in FEATURES]).agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns: dict = defaultdict(float)
    for r in counts:
        patterns[tuple(r[k] for k in LABELERS)] += r["n"]
    prior, tables, post = reliabilities(dict(patterns))
    sums: dict = defaultdict(lambda: [1.0, 1.0])
    totals = [1.0, 1.0]
    for r in counts:
        p = post[tuple(r[k] for k in LABELERS)]
        for y, w in ((1, p), (0, 1 - p)):
            totals[y] += w * r["n"]
            for k in FEATURES:
                sums[k, str(r[k])][y] += w * r["n"]
    bias = math.log(totals[1] / totals[0])
    weights = {k: math.log(s[1] / totals[1]) - math.log(s[0] / totals[0]) for k, s in sums.items()}
    return {"bias": bias, "weights": weights, "prior": prior, "reliabilities": tables}


def probability(vote: Column, model: dict) -> Column:
    total = F.lit(model["bias"])
    for (feature, value), w in sorted(model["weights"].items()):
        total = total + F.when(vote[feature].cast("string") == value, w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, found (arrays of kind, start, stop, value).

    ``base`` are the valid matches of the fixed patterns, ``found`` looser candidates outside them to which the
    classifier gives ``least`` or more and against which no labeler but one at most has voted.  A null text is empty,
    repeated rows each give a row, ids may be null, an empty table stays empty, other columns are not read.  Offsets
    are in code points, stop exclusive.
    """
    text = picked(docs, id_col, text_col).select(named(id_col).alias("doc_id"), body(text_col).alias("t"))
    base, loose = candidates(F.col("t"))
    based = text.select("doc_id", "t", base.alias("base"), loose.alias("loose"))
    apart = based.select("doc_id", "base", voted(F.col("t"), spans.outside(F.col("loose"), F.col("base"))).alias("loose"))
    against = lambda v: sum(F.when(v[k] < 0, 1).otherwise(0) for k in LABELERS)
    sure = F.filter("loose", lambda s: (probability(s["vote"], model) >= least) & (against(s["vote"]) <= 1))
    return apart.select("doc_id", "base", F.transform(sure, lambda s: s.dropFields("vote")).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", *spans.digest("base", "found", BASE, KINDS))
