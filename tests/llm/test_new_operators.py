"""Operators 11 to 13: language, vector codes and source divergence."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from compare import compare, connect

import __spark_entry__ as entry
from semblance.llm import codes, divergence, language, queries
from semblance.llm.text import picked

FOLDER = "/root/testdata/sf0.001"


# -- language ------------------------------------------------------------------


def folded(text):
    """Letters in lower case, one gap (0) for each run of the rest, a gap at both ends."""
    import unicodedata

    out = [0]
    for c in text:
        p = ord(c.lower()[0]) if unicodedata.category(c)[0] == "L" else 0
        if p or out[-1]:
            out.append(p)
    return out if not out[-1] else out + [0]


def plain_grams(text):
    x, out = folded(text), []
    if not any(x):
        return out
    for n in language.SIZES:
        for i in range(len(x) - n + 1):
            h = 0
            for p in x[i : i + n]:
                h = (h * 0x01000193 + p) % 2**32
            h = (h + n * 0x632BE5AB) % 2**32
            out.append(((h ^ h >> 15) * 0x9E3779B1 % 2**32) >> 32 - language.BITS)
    return out


TEXTS = [
    ("en", "the cat and the dog are in the house with the bird"), ("en", "this is the house that the man has built"), ("en", "where are the children now"),
    ("de", "der Hund und die Katze sind in dem Haus mit dem Vogel"), ("de", "das ist das Haus, das der Mann gebaut hat"), ("de", "wo sind die Kinder jetzt"),
    ("fr", "le chat et le chien sont dans la maison avec l'oiseau"), ("fr", "c'est la maison que l'homme a construite"), (None, "кошка и собака"), ("fr", None),
]


def lang_frame(spark, rows):
    """With extra columns whose names clash with helpers and with the case of used ones."""
    return spark.createDataFrame([(i, t, lang, "x", 1.0, "y", 3) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, Text string, score double, rid string, feature int")


def test_language_features_in_any_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = ["", "a", "  ", "1 2", "Aé ß İ ǅ 日本語", "x" * 50, "\n\na\n\n", "".join(rnd.choice("abC  .é日") for _ in range(500))]
    for step in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(language, "STEP", step)
        for t in texts:
            got = [int(f) for part in language.grams(t) for f in part]
            assert sorted(got) == sorted(plain_grams(t)), (step, t)


def test_language_as_brute_force(spark):
    model = language.train(lang_frame(spark, TEXTS))
    n, docs = defaultdict(Counter), Counter(lang for lang, _ in TEXTS if lang)
    for lang, t in TEXTS:
        if lang:
            n[lang].update(plain_grams(t or ""))
    names = sorted(docs)
    assert model.languages == names
    cost = {k: defaultdict(lambda k=k: 0) for k in names}
    scaled = lambda p: int(np.rint(np.float64(-np.log(p) * language.SCALE)))
    for k in names:
        total = sum(n[k].values()) + language.SMOOTHING * 2**language.BITS
        cost[k] = {f: scaled((c + language.SMOOTHING) / total) for f, c in n[k].items()}
        cost[k][None] = scaled(language.SMOOTHING / total)
    asked = [(None, t) for t in ["the dog", "der Hund", "le chien dans la maison", "Haus house maison", None, "", "123 !?", "x", "кошка", "the dog"]]
    got = {r.doc_id: r for r in language.identify(lang_frame(spark, asked), model).collect()}
    assert len(got) == len(asked)
    for i, (_, t) in enumerate(asked):
        grams = plain_grams(t or "")
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = {k: scaled(docs[k] / sum(docs.values())) + sum(cost[k].get(f, cost[k][None]) for f in grams) for k in names}
        best = min(names, key=lambda k: (total[k], k))
        odds = sum(math.exp(-(total[k] - total[best]) / language.SCALE / math.sqrt(len(grams))) for k in names)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / odds)
    assert (got[0].lang_pred, got[1].lang_pred, got[2].lang_pred) == ("en", "de", "fr")


def test_language_is_told_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["op11_language"](spark, FOLDER).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_reads_no_held_out_row(spark):
    rows = [("aa" if zlib.crc32(str(i).encode()) % 5 else "held", "some text") for i in range(60)]
    assert language.train(language.learnable(lang_frame(spark, rows))).languages == ["aa"]


def test_language_ties_empty_tables_and_many_languages(spark, monkeypatch):
    same = language.train(lang_frame(spark, [("b", "same words"), ("a", "same words")]))
    got = language.identify(lang_frame(spark, [(None, "same")]), same).first()
    assert (got.lang_pred, got.score) == ("a", 0.5)
    empty = language.train(lang_frame(spark, []))
    assert empty.languages == [] and language.identify(lang_frame(spark, []), empty).count() == 0
    got = language.identify(lang_frame(spark, [(None, "word"), ("x", None)]), empty).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    monkeypatch.setattr(language, "MOST", 1)
    with pytest.raises(ValueError):
        language.train(lang_frame(spark, TEXTS))


def test_language_of_a_long_text_and_many_languages_in_a_task(spark, monkeypatch):
    model = language.train(lang_frame(spark, TEXTS))
    long = [(None, "le chat et la maison " * 50_000)]
    assert language.identify(lang_frame(spark, long), model).first().lang_pred == "fr"
    monkeypatch.setattr(language, "HELD", 1)
    assert np.array_equal(language.train(lang_frame(spark, TEXTS)).cost, model.cost)


# -- vector codes --------------------------------------------------------------


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{index: (codes, error)} and the codebooks; rows are (vec_id, vector, label) with distinct non-null ids."""
    kept = [i for i, (_, v, _) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda i: rows[i][0])
    if not kept:
        return {}, []
    x = {i: [math.floor(c * 1024) for c in rows[i][1]] for i in kept}
    size = len(x[kept[0]]) // parts
    out, books = {i: ([], 0) for i in kept}, []
    for p in range(parts):
        own = {i: x[i][p * size : (p + 1) * size] for i in kept}
        book = [own[i] for i in kept[:entries]]
        nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book))  # noqa: E731, B023
        for _ in range(rounds):
            held = defaultdict(list)
            for v in own.values():
                held[nearest(v)[1]].append(v)
            book = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else b for e, b in enumerate(book)]
        for i, v in own.items():
            d, e = nearest(v)
            out[i] = (out[i][0] + [e], out[i][1] + d)
        books += [v for c in book for v in c]
    return out, books


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, Label string, rid int, error int")


def check_codes(spark, rows, **how):
    want, books = plain_codes(rows, **how)
    found, got_books = codes.compress(vectors(spark, rows), block=how.pop("block", 4), **how)
    got = sorted((r.vec_id, r.codes, r.error, r.label) for r in found.collect())
    assert got == sorted((rows[i][0], c, e, rows[i][2]) for i, (c, e) in want.items())
    assert got_books.sha256() == brute.sha(",".join(map(str, books)))


def test_codes_as_brute_force(spark):
    rnd = random.Random(5)
    clouds = [[rnd.gauss(0, 3) for _ in range(8)] for _ in range(3)]
    rows = [(i * 3, [rnd.choice(clouds)[j] + rnd.gauss(0, 0.2) for j in range(8)], i % 3) for i in range(90)]
    rows += [(1000 + i, [0.25] * 8, 7) for i in range(40)]  # a vector of very many rows
    rows += [(2000, None, 1), (2001, [None] * 8, 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("inf")] + [0.0] * 7, 1), (2004, [-0.0001] * 8, 2)]
    check_codes(spark, rows, entries=12)
    check_codes(spark, rows, entries=256)
    check_codes(spark, rows, entries=1, rounds=1)


def test_codes_with_ties_and_floors(spark):
    # Entries at equal distance, and means of negative numbers.
    rows = [(i, [x / 1024] * 4, 0) for i, x in enumerate([-2, 2, 0, 0, -3, 3, -1, 1, 0])]
    check_codes(spark, rows, entries=2)


def test_codes_of_odd_rows(spark):
    assert codes.digest(*codes.compress(vectors(spark, []))).count() == 0
    none, books = codes.compress(vectors(spark, [(1, None, 1), (2, [], 1)]))
    assert none.count() == 0 and books.sha256() == brute.sha("")
    # Null and equal ids, null labels, another length: each row of the usual length gives a row.
    rows = [(None, [1.0] * 4, None), (5, [2.0] * 4, None), (5, [2.0] * 4, None), (5, [1.0] * 4, 3), (6, [1.0] * 8, 3), (7, [1.0] * 3, 3), (8, [], 3)]
    found, _ = codes.compress(vectors(spark, rows), entries=2)
    assert sorted((r.vec_id or 0, r.codes) for r in found.collect()) == [(0, [0] * 4), (5, [0] * 4), (5, [1] * 4), (5, [1] * 4)]
    with pytest.raises(Exception, match="exact sums"):
        codes.compress(vectors(spark, [(1, [1e6] * 4, 1)]))


def test_shortlists_keep_every_nearest_entry():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        book = rnd.integers(-20, 20, (30, 3))
        x = rnd.integers(-25, 25, 3) + rnd.integers(0, 6, (10, 3))
        listed = codes.shortlists(x.min(axis=0)[None], x.max(axis=0)[None], book)[0]
        away = np.square(x[:, None] - book[None]).sum(axis=2)
        assert listed[away.argmin(axis=1)].all() and listed[np.flatnonzero((away == away.min(axis=1, keepdims=True)).any(axis=0))].all()


def test_hilbert_neighbours_are_one_step_apart():
    for size, bits in ((2, 4), (3, 3)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * size), axis=-1).reshape(-1, size)
        keys = [k.tobytes() for k in codes.hilbert_keys(points, bits)]
        assert len(set(keys)) == len(points)
        order = sorted(range(len(points)), key=lambda i: keys[i])
        assert np.abs(np.diff(points[order], axis=0)).sum(axis=1).max() == 1


# -- source divergence ---------------------------------------------------------


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", "y", 1) for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, TERM string, Source string, n long")


def plain_audit(rows, min_docs=3, top=200):
    import re

    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, s, t in rows:
        lang, s, w = lang or "", s or "", term.findall((t or "").translate(brute.FOLD))
        n[lang, s].update(w)
        docs[lang].update(set(w))
        groups[lang].add(s)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, a: 1 + 10**9 * (c + 1) // (a + len(kept))  # noqa: E731, B023
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources - {s}]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(items)[:most])]
    return sorted(out)


def odd_texts(seed, n):
    rnd = random.Random(seed)
    words = ["a", "the", "The", "étude", "日本", "eightchr", "ninechars", "sixteencharacter", "seventeencharacte", "x" * 33, "x" * 34, "y" * 70, "ß" * 9, "Ä", "ä"]
    return [(rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", "s2", "é", None]), rnd.choice([" ", "1", "\x00", "_\n"]).join(rnd.choices(words, k=rnd.randrange(30)))) for _ in range(n)]


def test_divergence_as_brute_force(spark):
    rows = odd_texts(2, 120) + [("en", "s1", None), ("xx", "alone", ""), ("yy", "a", "one"), ("yy", "b", "two")]
    assert sorted(map(tuple, divergence.audit(doc_frame(spark, rows)).collect())) == plain_audit(rows)


def test_divergence_in_small_pieces(spark, monkeypatch):
    """Tiles, shards, chunks and slices of one document change nothing."""
    monkeypatch.setattr(divergence, "TERMS", 3)
    rows = [(lang, f"{s}{i % 5}", t) for i, (lang, s, t) in enumerate(odd_texts(4, 80))]
    rows += [("en", "s2", "the étude " * 400 + "z" * 300)] * 3
    plain = picked(doc_frame(spark, rows), "lang", "source", "text").na.fill("")
    whole = sorted(map(tuple, divergence.counts(plain).collect()))
    assert sorted(map(tuple, divergence.counts(plain, chunk=64).collect())) == whole
    assert sorted(map(tuple, divergence.audit(doc_frame(spark, rows), top=4).collect())) == plain_audit(rows, top=4)


def test_divergence_tiles_of_many_sources(spark):
    """More sources than a tile holds; terms that two tiles lack are added in one step."""
    rows = [("en", f"s{i:03d}", f"{w} {w} common") for i in range(divergence.TILE + 40) for w in [f"w{i // 60}"]]
    rows = [(a, b, c.replace("0", "x").replace("1", "y").replace("2", "z")) for a, b, c in rows]
    got = [tuple(r) for r in divergence.audit(doc_frame(spark, rows)).collect()]
    assert sorted(got) == plain_audit(rows)


def test_divergence_ties_repeats_and_empty_tables(spark):
    assert divergence.audit(doc_frame(spark, [])).count() == 0
    rows = [("en", s, "b a") for s in ("s2", "s1", "s0") for _ in range(2)]
    assert sorted(map(tuple, divergence.audit(doc_frame(spark, rows)).collect())) == plain_audit(rows)


def test_shares_in_two_ways():
    rnd = random.Random(1)
    total = [rnd.randrange(1, 2**52) for _ in range(300)]
    count = [rnd.randrange(1, t + 1) for t in total]
    got = divergence._shares(np.array(count, np.uint64), np.array(total, np.uint64))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(count, total)]


def test_shares_in_expressions(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(1, t + 1), t) for t in [rnd.randrange(1, 2**52) for _ in range(300)]]
    df = spark.createDataFrame(rows, "c long, t long")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(divergence._share(F.col("c"), F.col("t"))).collect()] == [1 + 10**9 * c // t for c, t in rows]


def test_radix_order_is_stable():
    rnd = np.random.default_rng(2)
    high, low = rnd.integers(0, 3, 500).astype(np.uint64) << np.uint64(61), rnd.integers(0, 1 << 40, 500).astype(np.uint64) % np.uint64(7)
    order = divergence.radix_order([high, low])
    assert order.tolist() == sorted(range(500), key=lambda i: (int(high[i]), int(low[i]), i))


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_source_divergence"])
def test_queries_beside_duckdb(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) is None
