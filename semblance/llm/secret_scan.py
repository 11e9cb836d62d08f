"""Secret scan: fixed patterns, and character Markov models for what they miss.

Two first-order character models, one of random strings and one of ordinary
identifiers, are counted over labelled samples.  A token is a secret when the
log-likelihood ratio of the two speaks for random by a margin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm import spans
from semblance.llm.text import body, named, picked

# Fixed patterns.  Runs that are too short for hex and access fail wherever they begin, so their lengths stand in the pattern.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "markov")

EDGE = r"\p{L}\p{N}+/_=-"
TOKEN = rf"(?<![{EDGE}])[A-Za-z0-9+/_=-]{{20,}}+(?![{EDGE}])"  # what the models judge
# Identifiers to learn from: letters only, or words and short numbers joined by signs (utf8mb4_general, x86_64-linux, report-2024-05).
LETTERS = r"[A-Za-z][A-Za-z_/+=-]{11,}+"
PART = r"(?:[A-Za-z]++(?:[0-9]{1,2}[A-Za-z]{2,}+)?[0-9]{0,4}+|[0-9]{1,4}+)"
NUMBERED = rf"(?=[A-Za-z][A-Za-z0-9_/+=-]{{11}})[A-Za-z]++(?:[0-9]{{1,2}}[A-Za-z]{{2,}}+)?[0-9]{{0,4}}+(?:[_/+=-]++{PART})++"
ORDINARY = rf"(?<![{EDGE}])(?:{LETTERS}|{NUMBERED})(?![{EDGE}])"

SYMBOLS = 96  # 0 is the start, then the printable ASCII characters
# Shares of a row that follow the class's symbols whatever stands before, and of those that are spread evenly.  As shares they do not depend on the corpus size.
BACK_OFF, EVEN = 0.3, 0.05
MARGIN = 12.0  # nats by which a token must be likelier as a random string


def codes(token: Column) -> Column:
    """Symbols of a token of printable ASCII, after a start symbol."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.greatest(F.least(F.ascii(c) - 32, F.lit(SYMBOLS - 1)), F.lit(0))))


def base_spans(text: Column) -> Column:
    assigned = F.filter(spans.matches(text, ASSIGN, "assign", 1), lambda s: F.length(s["value"]) >= MIN_ASSIGNED)
    return F.concat(assigned, spans.matches(text, ACCESS, "access"), spans.matches(text, HEX, "hex"))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples (token, random) of a corpus: values that the patterns find, and long identifiers outside these."""
    text = picked(docs, text_col).select(body(text_col).alias("t"))
    found = text.select(base_spans(F.col("t")).alias("base"), spans.matches(F.col("t"), ORDINARY, "ordinary").alias("words"))
    sample = lambda random: lambda s: F.struct(s["value"].alias("token"), F.lit(random).alias("random"))
    both = F.concat(F.transform("base", sample(True)), F.transform(spans.outside(F.col("words"), F.col("base")), sample(False)))
    return found.select(F.explode(both).alias("s")).select("s.token", "s.random")


def train(labelled: DataFrame, token_col: str = "token", random_col: str = "random") -> list[float]:
    """Log-likelihood ratios by previous and next symbol, row by row; at most SYMBOLS**2 counts a class leave the cluster.

    A row's smoothing is a share of its total, so a corpus and copies of it give one model; a class without samples is
    uniform.  Null and empty tokens and null labels teach nothing.
    """
    known = labelled.select(named(token_col).cast("string").alias("token"), named(random_col).alias("random")).where("token != '' AND random IS NOT NULL")
    c = known.select("random", codes(F.col("token")).alias("c"))
    steps = c.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * SYMBOLS + b)).alias("step"))
    n = {True: [0] * SYMBOLS**2, False: [0] * SYMBOLS**2}
    for r in steps.groupBy("random", "step").count().collect():
        n[r["random"]][r["step"]] += r["count"]
    rows = {k: [sum(v[i * SYMBOLS : (i + 1) * SYMBOLS]) for i in range(SYMBOLS)] for k, v in n.items()}
    columns = {k: [sum(v[i::SYMBOLS]) for i in range(SYMBOLS)] for k, v in n.items()}

    def chance(k: bool, i: int) -> float:
        row, every = rows[k][i // SYMBOLS], sum(rows[k])
        any_row = (1 - EVEN) * (columns[k][i % SYMBOLS] / every) + EVEN / SYMBOLS if every else 1 / SYMBOLS
        return (1 - BACK_OFF) * (n[k][i] / row) + BACK_OFF * any_row if row else any_row

    return [math.log(chance(True, i)) - math.log(chance(False, i)) for i in range(SYMBOLS**2)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, positive for random."""
    table = spans.constant([round(x, 6) for x in model], "double")
    c = codes(token)
    steps = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * SYMBOLS + b)
    return F.aggregate(steps, F.lit(0.0), lambda total, s: total + F.get(table, s))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, found (arrays of kind, start, stop, value).

    ``base`` are the matches of the fixed patterns, ``found`` tokens of 20 characters or more with a letter and a
    digit, outside them, that the models call random.  A null text is empty, repeated rows each give a row, ids may be
    null, an empty table stays empty, other columns are not read.  Offsets are in code points, stop exclusive.
    """
    text = picked(docs, id_col, text_col).select(named(id_col).alias("doc_id"), body(text_col).alias("t"))
    based = text.select("doc_id", base_spans(F.col("t")).alias("base"), spans.matches(F.col("t"), TOKEN, "markov").alias("tokens"))
    mixed = F.filter("tokens", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    apart = based.select("doc_id", "base", spans.outside(mixed, F.col("base")).alias("tokens"))
    return apart.select("doc_id", "base", F.filter("tokens", lambda s: ratio(s["value"], model) >= margin).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", *spans.digest("base", "found", BASE, KINDS))
