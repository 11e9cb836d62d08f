"""Operators 2, 5, 6 and 10 beside their brute-force versions, with the awkward rows."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from semblance.llm import exact, graph, lines, simhash, substring

SCHEMA = "doc_id long, text string, rid string, id string, h string, first string, name string, n_lines string"


def frame(spark, rows):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", None, "y", None, "z", "w") for d, t in rows], SCHEMA)


def prose(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rnd.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Shared passages, copies, near copies, short, empty and very long texts; ids out of order."""
    passage, other, base = prose(1, 70), prose(2, 55), prose(3, 300)
    out = [" ".join(prose(100 + i, 30) + passage + prose(200 + i, 20 + i)) for i in range(6)]
    out += [" ".join(prose(300 + i, i) + other) for i in range(4)]
    out += [" ".join(base), "\t ".join(base), " ".join(base[:250]), " ".join(base[:100] + ["changed"] + base[101:]), " ".join(base[1:] + ["tail"])]
    out += [None, "", " \n\t", "word", "Word", " ".join(passage[:49]), " ".join(passage[:50]), " ".join(["again"] * 120), "again " * 60]
    out += [" ".join(prose(9, 30_000) + passage), "no break " * 60, "no break " * 60]
    line = "A line that many documents have in common"
    out += [f"{i}\n{line}\n  {line.upper()}\t\nshort\n\n" for i in range(4)] + [f"{line}\n{line}", f"one\n{line} only\ntwo"]
    order = random.Random(5).sample(range(1000), len(out))
    return list(zip(order, out))


def test_substring_repeats(spark, rows):
    got = {r.doc_id: r for r in substring.repeats(frame(spark, rows)).collect()}
    for d, n, gone, kept in brute.repeats(rows):
        r = got[d]
        assert (r.n_words, r.n_removed, r.kept) == (n, gone, kept)
        assert sum(s.stop - s.start for s in r.repeats) == gone
        assert all(a.stop < b.start for a, b in zip(r.repeats, r.repeats[1:]))


def test_substring_other_sizes(spark, rows):
    for size, gram in ((12, 3), (9, 9)):
        got = {r.doc_id: r.kept for r in substring.repeats(frame(spark, rows), size=size, gram=gram).collect()}
        assert got == {d: kept for d, _, _, kept in brute.repeats(rows, size)}


def test_windows_come_once_for_a_text(spark):
    """A text of one repeated word has one window, so that no shuffle is needed to drop the others."""
    docs = spark.createDataFrame([(1, "a " * 400), (2, " ".join(f"w{i % 60}" for i in range(300)))], "id long, text string")
    opened = docs.join(substring.listed(substring.stretches(docs, 50, 8), "g1", "open"), "id").select("id", "text", "open")
    got = [tuple(r) for r in substring.windows(opened, 50, 8).collect()]
    assert len(got) == len(set(got)) and sum(r[0] == 1 for r in got) == 1 and sum(r[0] == 2 for r in got) == 60


def test_substring_without_broadcasts(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "ROWS_TO_SEND", -1)
    got = {r.doc_id: r.n_removed for r in substring.repeats(frame(spark, rows)).collect()}
    assert got == {d: gone for d, _, gone, _ in brute.repeats(rows)}


def test_substring_null_and_repeated_ids(spark):
    text = " ".join(prose(1, 60))
    got = substring.repeats(frame(spark, [(5, text), (5, text), (None, text), (None, text), (7, "x")])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (False, 0), (True, 60), (True, 60)]


def test_exact(spark, rows):
    more = rows + [(2000, "w o\nr d"), (2001, "w  ord")]
    for block in (exact.BLOCK, 7):
        got = {r.doc_id: r for r in exact.exact_duplicates(frame(spark, more), block=block).collect()}
        for i, want in brute.exact(more).items():
            r = got[more[i][0]]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == want


def test_exact_names_by_text_where_hashes_meet(spark, rows, monkeypatch):
    """With a hash of two values nearly every block shares its hash; the answer stays."""
    monkeypatch.setattr(exact, "block_hash", lambda b: F.pmod(F.xxhash64(b), F.lit(2)))
    got = {r.doc_id: r.keep_id for r in exact.exact_duplicates(frame(spark, rows), block=50).collect()}
    assert got == {rows[i][0]: v[0] for i, v in brute.exact(rows).items()}


def test_exact_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(exact, "NAMES", 3)
    got = {r.doc_id: r.group_size for r in exact.exact_duplicates(frame(spark, rows), block=40).collect()}
    assert got == {rows[i][0]: v[1] for i, v in brute.exact(rows).items()}


def test_exact_repeated_rows_and_null_ids(spark):
    got = exact.exact_duplicates(frame(spark, [(1, "a b"), (1, "a b"), (1, "a  b"), (None, "ab"), (None, None), (3, "")])).collect()
    ab = [r for r in got if r.group_size == 4]
    assert len(got) == 6 and len(ab) == 4 and sum(r.kept for r in ab) == 1 and {r.keep_id for r in ab} == {1}
    assert sorted((r.doc_id is None, r.kept) for r in got if r.group_size == 2) == [(False, True), (True, False)]


def test_lines(spark, rows):
    got = {r.doc_id: r for r in lines.kept(frame(spark, rows)).collect()}
    for d, n, gone, text in brute.line_dedup(rows):
        assert (got[d].n_lines, got[d].n_dropped, got[d].text) == (n, gone, text)
    assert sum(r.n_dropped for r in got.values()) > 5 and got[rows[0][0]].rid == "x"


def test_lines_without_filters(spark, rows, monkeypatch):
    monkeypatch.setattr(lines, "FILTER_BYTES", -1)
    monkeypatch.setattr(lines, "ROWS_TO_SEND", -1)
    got = {r.doc_id: r.text for r in lines.kept(frame(spark, rows)).collect()}
    assert got == {d: text for d, _, _, text in brute.line_dedup(rows)}


def test_lines_null_and_repeated_ids(spark):
    line = "exactly the very same line"
    got = lines.kept(frame(spark, [(1, line), (1, line), (2, f"{line}\nb"), (None, line), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in got) == [(0, "", 0), (0, "", 1), (1, "", 1), (1, "", 1), (2, f"{line}\nb", 0)]


def test_lines_in_and_out(spark, rows, monkeypatch):
    """Documents put in and taken out leave the state of the documents that remain."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    docs = frame(spark, rows)
    half, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = lines.insert(lines.build(half), rest)
    assert {r.doc_id: r.text for r in lines.kept(docs, index).collect()} == {d: t for d, _, _, t in brute.line_dedup(rows)}
    back = lines.delete(index, rest.select("doc_id"))
    want = brute.line_dedup([r for r in rows if r[0] % 2 == 0])
    assert {r.doc_id: r.text for r in lines.kept(half, back).collect()} == {d: t for d, _, _, t in want}
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, lines.build(half).counts.collect()))


def test_shards_follow_an_index_that_grows(spark, monkeypatch):
    """A large batch on a small index is dealt over as many shards as a fresh build of both has."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    first = frame(spark, [(-1, "one line that is long enough to count")])
    docs = frame(spark, [(d, "\n".join(f"a line number {i} that stands in all of them" for i in range(d % 3, 60))) for d in range(6)])
    small = lines.build(first)
    index, fresh = lines.insert(small, docs), lines.build(docs.union(first))
    assert small.bits == 0 and index.bits == fresh.bits > 3
    assert {r.shard for r in index.filters.collect()} == {r.shard for r in fresh.filters.collect()}
    text = lambda at: {r.doc_id: r.text for r in lines.kept(docs, at).collect()}
    assert text(index) == text(fresh)
    assert lines.delete(index, docs.select("doc_id")).counts.collect() == small.counts.collect()


def test_cuckoo_filter():
    import numpy as np

    rnd = np.random.default_rng(1)
    keys, others = rnd.integers(-(1 << 62), 1 << 62, 5_000), rnd.integers(-(1 << 62), 1 << 62, 50_000)
    held = lines.CuckooFilter.holding(keys)
    assert held.has(keys).all() and held.has(others).mean() < 0.001
    held.delete(keys[:2_500])
    assert held.has(keys[2_500:]).all() and held.has(keys[:2_500]).mean() < 0.001
    again = lines.CuckooFilter.unpack(held.pack())
    assert again.has(keys[2_500:]).all()


def test_simhash(spark, rows):
    base = prose(7, 400)
    near = [(3000 + i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(0, 40, 4)]
    got = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(frame(spark, rows + near))).collect()}
    want = brute.near(rows + near)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fp:016x}", c) for d, fp, c in want}
    assert sum(c != d for d, _, c in want) > 5


def test_links_lose_none(spark):
    """Random flips of up to six bits around a few centres, against all pairs."""
    rnd = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            fp = centre
            for b in rnd.sample(range(64), rnd.randrange(7)):
                fp ^= 1 << b
            fps.add(fp - (1 << 64) if fp >> 63 else fp)
    df = spark.createDataFrame([(x, x) for x in fps], "fp long, label long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 4}
    with pytest.raises(ValueError):
        simhash.links(df, distance=5)


def reachable(fps, distance):
    """{fingerprint: the smallest one reachable over pairs within the distance}."""
    out, left, mask = {}, set(fps), (1 << 64) - 1
    while left:
        group, front = set(), {min(left)}
        while front:
            group |= front
            left -= front
            front = {b for b in left if any(((a ^ b) & mask).bit_count() <= distance for a in front)}
        out |= dict.fromkeys(group, min(group))
    return out


@pytest.mark.parametrize("hot", [None, 3])
def test_classes_of_near_copies(spark, monkeypatch, hot):
    """Dense groups, with and without buckets that are tied by points; never more edges than fingerprints and classes ask for."""
    rnd, fps = random.Random(8), set()
    for _ in range(4):
        centre = rnd.getrandbits(64)
        for _ in range(150):
            fp = centre
            for b in rnd.sample(range(40, 64), rnd.randrange(6)):
                fp ^= 1 << b
            fps.add(fp - (1 << 64) if fp >> 63 else fp)
    df = simhash.materialised(spark.createDataFrame([(x,) for x in fps], "fp long"))
    if hot:
        plain = simhash.links
        monkeypatch.setattr(simhash, "links", lambda c, d, s: plain(c, d, s, hot))
    for distance in (4, 3, 2):
        got = {r.fp: r.label for r in simhash.classes(df, distance).collect()}
        assert got == reachable(fps, distance)


def test_ties_are_links_and_connect_all(spark):
    rnd = random.Random(4)
    fps = [rnd.getrandbits(63) & ~0xFF | rnd.getrandbits(8) for _ in range(5)]
    fps = sorted({f ^ rnd.getrandbits(8) for f in fps for _ in range(20)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for distance in (0, 1, 2, 3, 4):
        edges = [(r.a, r.b) for r in simhash.ties(df, distance).collect()]
        assert all((a ^ b).bit_count() <= distance for a, b in edges)
        label = {f: f for f in fps} | ({r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} if edges else {})
        assert label == reachable(fps, distance)


def test_simhash_null_and_repeated_ids(spark):
    got = simhash.near_duplicates(frame(spark, [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "q r s t u v"), (9, None), (2, "  ")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("2", "2"), ("4", "4"), ("4", "4"), ("9", "2"), ("None", "4"), ("None", "None")]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(300, 200), (250, 300)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {200: 200, 300: 200, 250: 200}


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert substring.repeats(docs).count() == exact.exact_duplicates(docs).count() == lines.kept(docs).count() == simhash.near_duplicates(docs).count() == 0
