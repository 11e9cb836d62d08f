"""One query for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semblance.llm import codes, decontaminate, divergence, exact, language, licenses, lines, pieces, pii, quality, secret_scan, simhash, substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_secret_scan")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(secret_scan.samples(docs))))


OP2 = """
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
    k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS key FROM s),
    f AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING min(doc_id) < max(doc_id)),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM k JOIN f USING (key) WHERE doc_id > first),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
    r AS (SELECT p.doc_id, p.pos, p.word, g.pos IS NOT NULL AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos)
    SELECT w.doc_id, CAST(len(any_value(words)) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
           sha256(coalesce(string_agg(word, ' ' ORDER BY r.pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM w LEFT JOIN r ON w.doc_id = r.doc_id GROUP BY w.doc_id"""


@query("op2_substring_dedup", OP2)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return substring.digest(substring.repeats(table(spark, folder, "documents")))


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.digest(quality.score(docs, quality.train(docs, table(spark, folder, "labels"))))


@query("op4_pii")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.digest(pii.scan(docs, pii.train(docs)))


OP5 = """
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                      regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm ORDER BY c DESC, doc_id)"""


@query("op5_exact_dedup", OP5)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return exact.digest(exact.exact_duplicates(table(spark, folder, "documents")))


OP6 = """
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    d AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM d GROUP BY doc_id"""


@query("op6_line_dedup", OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digest(lines.kept(table(spark, folder, "documents")))


OP7 = """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
    bs AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM bs),
    sizes AS (SELECT DISTINCT n FROM bw),
    ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n),
    dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM ds),
    hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.key = bw.key),
    pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
    np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
    ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN np ON d.doc_id = np.doc_id LEFT JOIN ni ON d.doc_id = ni.doc_id"""


@query("op7_decontaminate", OP7)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.windows_hit(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op8_pieces")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces.digest(pieces.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


@query("op9_licenses")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, folder, "documents")))


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, folder, "documents")))


@query("op11_language")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.digest(language.identify(docs, language.train(language.learnable(docs))))


def _op12() -> str:
    """Four rounds and the last assignment, a pair of tables each."""
    part = "list_slice(x, p * len(x) // 4 + 1, (p + 1) * len(x) // 4)"
    steps = [f"""
    WITH v AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, p, {part} AS x FROM v, range(4) t(p)),
    c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < 256)"""]
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (
        SELECT vec_id, p, x, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT vec_id, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c{k} ON parts.p = c{k}.p)
        GROUP BY vec_id, p, x)""")
        if k < 4:
            steps.append(f"""m{k} AS MATERIALIZED (
        SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM (
            SELECT p, best.e AS e, pos, sum(x[pos]) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) GROUP BY ALL) GROUP BY p, e),
    c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.p = m{k}.p AND c{k}.e = m{k}.e)""")
    steps.append("""r AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
    s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c4)""")
    return ",\n    ".join(steps) + """
    SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), s"""


OP12 = _op12()


@query("op12_vector_codes", OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return codes.digest(*codes.compress(table(spark, folder, "embeddings")))


OP13 = """
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
    size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    own AS MATERIALIZED (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY ALL),
    total AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source),
    p AS MATERIALIZED (
        SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
               1 + 1000000000::HUGEINT * (coalesce(own.n, 0) + 1) // (coalesce(total.total, 0) + size.v) AS p,
               1 + 1000000000::HUGEINT * (kept.n + 1) // (size.total + size.v) AS q
        FROM groups g JOIN size ON size.lang = g.lang JOIN kept ON kept.lang = g.lang LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
        LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
    gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(gaps.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source),
    parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts) WHERE part = 'pair' OR rank <= 200"""


@query("op13_source_divergence", OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
