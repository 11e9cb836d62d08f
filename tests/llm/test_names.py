"""Extra columns whose names clash with used ones, in any spelling of case, and ids of other kinds."""

import brute
import public_tokenizers
import pytest

from semblance.llm import decontaminate, divergence, exact, language, licenses, lines, pieces, pii, quality, secret_scan, simhash, substring

MODEL = public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["Text", "DOC_ID", "Score", "N_LINES", "__id", "__at", "__h", "__lines", "rid", "h", "Lang", "SOURCE", "id", "t", "words"]
ROWS = [(i, f"line one of many documents\nthe {w} word {i} stands here", "en", "s") for i, w in enumerate(["first", "second", "third", "fourth"])] + [(None, None, None, None)]


def plain(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clashing(spark, rows=ROWS):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{e}` string" for e in EXTRA))


def test_results_do_not_see_other_columns(spark):
    one, two = plain(spark), clashing(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(4)], "doc_id long, quality int, QUALITY string")
    for run in (
        lambda d: secret_scan.scan(d, secret_scan.train(secret_scan.samples(d))), lambda d: pii.scan(d, pii.train(d)), lambda d: exact.digest(exact.exact_duplicates(d)),
        lambda d: lines.digest(lines.kept(d)), lambda d: substring.digest(substring.repeats(d)), licenses.scan, lambda d: simhash.near_duplicates(d),
        lambda d: language.identify(d, language.train(d)), divergence.audit,
        lambda d: decontaminate.windows_hit(d, plain(spark).selectExpr("cast(doc_id AS string) AS item_id", "text")), lambda d: pieces.encode(d, MODEL),
    ):
        assert sorted(map(str, run(two).collect())) == sorted(map(str, run(one).collect()))
    assert quality.digest(quality.score(two, quality.train(two, labels))).count() == len(ROWS)


def test_other_columns_stay(spark):
    kept = lines.kept(clashing(spark))
    assert kept.columns == [c for c in clashing(spark).columns if c != "N_LINES"] + ["n_lines", "n_dropped"]
    scored = quality.score(clashing(spark), quality.train(plain(spark), spark.createDataFrame([(0, 1)], "doc_id long, quality int")))
    assert scored.columns == [c for c in clashing(spark).columns if c != "Score"] + ["score"]


@pytest.mark.parametrize("kind", ["string", "double", "date", "long"])
def test_repeats_with_ids_of_any_kind(spark, kind):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(3, passage + " tail"), (1, "head " + passage), (2, passage), (None, passage), (None, "alone")]
    cast = {"string": "concat('k', id)", "double": "id / 2", "date": "date_add(DATE '2020-01-01', id)", "long": "IF(id = 3, 9223372036854775807, id)"}[kind]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr(f"{cast} AS doc_id", "text")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring.repeats(df).collect())
    names = {r[0]: r[1] for r in spark.createDataFrame([(1,), (2,), (3,)], "id int").selectExpr("id", f"{cast} AS doc_id").collect()}
    want = brute.repeats([(9 if d is None else d, t) for d, t in rows])
    assert got == sorted((str(names.get(d)), n, r, k) for d, n, r, k in want)
