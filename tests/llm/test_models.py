"""Operators 3 and 8 and the pipeline."""

import random
import struct
import zlib

import brute
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from semblance.llm import pieces, quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, y string, block string, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", None, "z") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_as_the_library(spark, library):
    rnd = random.Random(6)
    odd = ["", " ", "  ", "\n", "\n\n a", "a  b   c    d", " lead", "trail ", "▁", "a▁b ▁ c", "été 日本語 😀 \U0001f9ff", "\x00\x01\x7f", "�", "é", "\tx\r\n", "<s> </s> <unk> <0x0A>",
           "ﬁ ｆｕｌｌ Ａ", "  　", "0123456789 12,345.67", "a" * 3_000, "ab" * 2_000, "the " * 5_000, " " * 100, "​‍", "İıſK", "hello\x85world\x1c"]
    mixed = ["".join(rnd.choice("abcdefghij ktheingonr \n▁é日.,") for _ in range(rnd.randrange(400))) for _ in range(150)]
    rows = list(enumerate([*odd, *mixed, None]))
    got = {r.doc_id: r for r in pieces.encode(frame(spark, rows), MODEL).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[d].ids == struct.pack(f"<{len(ids)}I", *ids) and got[d].n_tokens == len(ids), t
        assert got[d].decoded == library.decode(ids), t


def test_pieces_of_very_many_odd_texts(library):
    """Ten thousand short texts of letters, marks, spaces, digits, signs and rare characters, in batches."""
    rnd = random.Random(16)
    kinds = ["abcdefghij ktheingonr", "ABC the of ing", " \n\t\r", "0123456789.,-", "▁ ▁", "éüßñçÄ", "日本語한국", "\x00\x7f�\u200b\u0301", "😀🏽\U0001f9ff", "!?@#$%&*()[]{}<>\"'`~"]
    texts = ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randrange(60))) for _ in range(10_000)]
    own = pieces.Pieces(open(MODEL, "rb").read())
    for at in range(0, len(texts), 1_000):
        part = texts[at : at + 1_000]
        n, ids, decoded = (c.to_pylist() for c in own.encode_all(part))
        own.check()
        theirs = library.encode(part, add_bos=True, add_eos=True)
        assert ids == [struct.pack(f"<{len(i)}I", *i) for i in theirs] and n == [len(i) for i in theirs]
        assert decoded == library.decode(theirs)


def test_pieces_in_small_batches(spark, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["", "a b", None, "longer than a batch " * 9, "", "é", ""])]
    plain = pieces.encode(frame(spark, rows), MODEL).collect()
    monkeypatch.setattr(pieces, "BATCH", 3)
    own = pieces.Pieces(open(MODEL, "rb").read())
    assert [own.encode(t or "") for _, t in rows] == [(bytes(r.ids), r.decoded) for r in plain]


def test_pieces_of_empty_and_repeated_rows(spark):
    assert pieces.encode(frame(spark, []), MODEL).count() == 0
    got = pieces.digest(pieces.encode(frame(spark, [(None, "a"), (None, "a")]), MODEL)).collect()
    assert len(got) == 2 and got[0] == got[1]


def test_a_disagreement_is_an_error(monkeypatch):
    own = pieces.loaded(open(MODEL, "rb").read())
    monkeypatch.setattr(own, "merged", lambda cut: [5] * len(cut))
    own.encode("some new words never seen 84621")
    with pytest.raises(ValueError):
        own.check()
    pieces._LOADED.clear()


def test_memory_of_cuts_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    own = pieces.Pieces(open(MODEL, "rb").read())
    for i in range(10):
        own.encode(f"w{i} x{i} y{i}")
        own.check()
        assert len(own.ids) <= 8


def test_quality_on_held_out_documents(spark):
    spoken = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.digest(quality.score(spoken, quality.train(spoken, labels)))
    rows = scored.join(labels, "doc_id").collect()
    assert scored.count() == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    good, bad = [r for r in held if r.quality == 1], [r for r in held if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) >= 0.98 and sum(r.predicted for r in bad) / len(bad) <= 0.2
    ranks = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in good for b in bad]
    assert sum(ranks) / len(ranks) >= 0.97


def test_quality_curve_is_fitted_on_unseen_margins(spark):
    """Labels without any relation to the text: scores of a small sample stay near the share of label 1."""
    rnd = random.Random(8)
    docs = frame(spark, [(i, " ".join(f"w{rnd.randrange(3_000)}" for _ in range(60))) for i in range(300)])
    labels = spark.createDataFrame([(i, rnd.randrange(2)) for i in range(300)], "doc_id long, quality int")
    assert quality.labelled(docs, labels, "doc_id", "text", "quality", quality.SAMPLE).select("block").distinct().count() >= 5
    scores = [r.score for r in quality.score(docs, quality.train(docs, labels)).where(quality.held_out("doc_id")).collect()]
    assert len(scores) > 30 and 0.25 < min(scores) and max(scores) < 0.75
    few = quality.train(docs, labels.where("doc_id < 6"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, few).collect())


def test_quality_is_fitted_in_few_jobs_whatever_the_partitions(spark):
    """Weights are averaged in the cluster: no job for each shuffle partition, and one row of them for each block at the driver."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(200)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        for k, v in zip(held, ("64", "false")):
            spark.conf.set(k, v)
        context.setJobGroup("quality in few jobs", "")
        model = quality.train(docs, labels)
        assert len(context.statusTracker().getJobIdsForGroup("quality in few jobs")) < 32
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert abs(model.weight).max() > 0 and model.slope > 0


def test_quality_of_odd_rows(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice("clean words of some prose here".split()) for _ in range(40))) for i in range(100)]
    bad = [(200 + i, " ".join(rnd.choice("### $$$ !!!".split()) for _ in range(40))) for i in range(100)]
    labels = spark.createDataFrame([(d, int(d < 200), "x") for d, _ in good + bad] + [(None, 1, ""), (5, None, ""), (1, 1, "")], "doc_id long, quality int, text string")
    docs = frame(spark, good + bad + [(900, None), (901, ""), (None, "clean words"), (902, "### !!! " * 20_000), (902, "### $$$")])
    got = [r for r in quality.score(docs, quality.train(docs, labels)).collect() if r.doc_id is None or r.doc_id >= 900]
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 5 and by[900] == by[901] and by[902] < 0.3 < by[None] and all(0 <= r.score <= 1 for r in got)
    none = labels.where("quality = 3")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert min(r.score for r in quality.score(docs, quality.train(docs, labels.where("quality = 1"))).collect()) > 0.9
    empty = frame(spark, [])
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (quality.score(docs, quality.train(docs, x)).select("doc_id", "score") for x in (labels, turned))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_pipeline_stages(spark, library):
    """Each stage against the plain version on what its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    rows = plain(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "quality":
            assert set(plain(out)) <= set(rows) and 0 < out.count() < len(rows)
        elif name == "lines":
            assert plain(out) == sorted((d, t) for d, _, _, t in brute.line_dedup(rows))
        elif name == "near_duplicates":
            text = dict(rows)
            assert plain(out) == sorted((d, text[d]) for d, _, c in brute.near(rows) if c == d)
        elif name == "benchmark":
            clean = {d for d, _, hit, _ in brute.leaks(rows, items) if not hit}
            assert plain(out) == sorted(x for x in rows if x[0] in clean) and len(clean) < len(rows)
        else:
            ids = {d: library.encode(t, add_bos=True, add_eos=True) for d, t in rows}
            assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in out.collect()} == {d: (len(i), brute.sha(struct.pack(f"<{len(i)}I", *i))) for d, i in ids.items()}
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        rows = plain(docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, out.collect()))


def test_pipeline_on_odd_rows(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(None, None, None, None, None), (None, "a line that is long enough to count", "en", None, 3), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50_000, None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= len(table)


def test_registered():
    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in entry.queries()
