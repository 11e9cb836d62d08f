"""Preparation, sampling, classifiers and the synthesiser."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORDER_SCHEMA, Tables, check, one_row, r, rounded
from semblance.operators import dependence
from semblance.operators import learn as L
from semblance.operators import prepare as P
from semblance.operators import synth as Y
from semblance.operators import trees
from semblance.operators.profile import TableSchema
from semblance.session import written

TOKEN = "CASE WHEN priority IS NULL OR priority IN ('nan', '<NA>') THEN '__missing__' ELSE priority END"
WORDS = """words AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS idx FROM (
    SELECT DISTINCT 'priority' AS c, priority AS v FROM order_rows WHERE priority IS NOT NULL UNION SELECT DISTINCT 'status', status FROM order_rows))"""


def encoder(t: Tables):
    return P.fit_encoder(t("order_rows"), ["cust", "total"], ["priority", "status"])


@check(
    "minmax_fit",
    f"""WITH {WORDS} SELECT 'cust' AS column_name, NULL AS value, round(min(cust), 4) AS low, round(max(cust), 4) AS high, CAST(NULL AS BIGINT) AS idx FROM order_rows
        UNION ALL SELECT 'total', NULL, round(min(total), 4), round(max(total), 4), NULL FROM order_rows UNION ALL SELECT c, v, NULL, NULL, idx FROM words""",
    ("order_rows",),
)
def minmax_fit(t: Tables):
    enc = encoder(t)
    ranges = enc.ranges_frame().select(
        F.col("column").alias("column_name"), F.lit(None).cast("string").alias("value"), r(F.col("min"), 4).alias("low"), r(F.col("max"), 4).alias("high"),
        F.lit(None).cast("bigint").alias("idx"),
    )
    words = enc.dictionary.select(
        F.col("column").alias("column_name"), "value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "idx"
    )
    return ranges.unionByName(words)


SCALED = """SELECT id, least(1, greatest(0, (cust - c0) / (c1 - c0 + 1e-8))) AS cust, CASE WHEN total IS NOT NULL THEN least(1, greatest(0, (total - t0) / (t1 - t0 + 1e-8))) END AS total, priority, status
    FROM {t}, (SELECT min(cust) AS c0, max(cust) AS c1, min(total) AS t0, max(total) AS t1 FROM order_rows)"""


@check(
    "minmax_transform",
    f"""WITH {WORDS}, s AS ({SCALED.format(t='order_syn')}) SELECT id, round(cust, 6) AS cust, round(total, 6) AS total, p.idx AS priority, q.idx AS status
        FROM s LEFT JOIN words p ON p.c = 'priority' AND p.v = s.priority LEFT JOIN words q ON q.c = 'status' AND q.v = s.status""",
    ("order_rows", "order_syn"),
)
def minmax_transform(t: Tables):
    """Fitted on one table, applied to another: values are clipped, unseen categories become null."""
    return rounded(P.encode(t("order_syn"), encoder(t), ["priority", "status"]), cust=6, total=6)


@check(
    "minmax_inverse",
    f"""WITH s AS ({SCALED.format(t='order_rows')}) SELECT id, round(cust * (c1 - c0) + c0, 2) AS cust, CASE WHEN total IS NOT NULL THEN round(total * (t1 - t0) + t0, 2) END AS total,
        priority, status FROM s, (SELECT min(cust) AS c0, max(cust) AS c1, min(total) AS t0, max(total) AS t1 FROM order_rows)""",
    ("order_rows",),
)
def minmax_inverse(t: Tables):
    enc = encoder(t)
    return rounded(P.decode(P.encode(t("order_rows"), enc, ["priority", "status"]), enc, ["priority", "status"]), cust=2, total=2)


@check(
    "encode_roundtrip",
    f"WITH {WORDS} SELECT id, priority AS value, idx, priority AS back FROM order_rows LEFT JOIN words ON c = 'priority' AND v = priority",
    ("order_rows",),
)
def encode_roundtrip(t: Tables):
    df = t("order_rows").select("id", F.col("priority").alias("value"), "priority")
    enc = P.fit_encoder(df, [], ["priority"])
    coded = P.encode(df, enc, ["priority"]).withColumn("idx", F.col("priority"))
    return P.decode(coded, enc, ["priority"]).withColumnRenamed("priority", "back")


@check(
    "dictionary_chunked",
    "SELECT 'c_name' AS column_name, c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS idx FROM (SELECT DISTINCT c_name FROM customer)",
)
def dictionary_chunked(t: Tables):
    """The large-dictionary path: distinct values cut into chunks, numbered without one global sort."""
    return P.dictionary(t("customer"), ["c_name"], chunks=8).withColumnRenamed("column", "column_name")


@check(
    "training_frame",
    f"SELECT CAST(cust AS DOUBLE) AS cust, round(coalesce(total, (SELECT median(total) FROM order_rows)), 4) AS total, {TOKEN} AS priority, status FROM order_rows",
    ("order_rows",),
)
def training_frame(t: Tables):
    return rounded(P.training_frame(t("order_rows"), ORDER_SCHEMA), total=4)


@check(
    "stratified_split",
    "SELECT status, count(*) AS n, CAST(floor(count(*) * 0.3e0 + 0.5e0) AS BIGINT) AS n_test FROM order_rows GROUP BY status",
    ("order_rows",),
)
def stratified_split(t: Tables):
    parts = P.stratified_split(t("order_rows"), "status", "id")
    return parts.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))


@check(
    "one_hot",
    f"""SELECT id, 'priority' AS column_name, {TOKEN} AS token FROM order_rows UNION ALL SELECT id, 'status', status FROM order_rows
        UNION ALL SELECT id, 'cust', CAST(cust AS VARCHAR) FROM order_rows""",
    ("order_rows",),
)
def one_hot(t: Tables):
    """A few categories, and as many as there are customers."""
    return P.one_hot(t("order_rows").select("id", "priority", "status", "cust"), ["priority", "status", "cust"]).withColumnRenamed("column", "column_name")


@check("class_weight", "SELECT round(count(*) FILTER (status <> 'F') / greatest(count(*) FILTER (status = 'F'), 1), 6) AS class_weight FROM order_rows", ("order_rows",))
def class_weight(t: Tables):
    return rounded(P.class_weight(t("order_rows"), "status", "F"), class_weight=6)


@check(
    "condition_weights",
    f"""WITH n AS (SELECT c, v, count(*) AS n FROM (SELECT 'priority' AS c, priority AS v FROM order_rows UNION ALL SELECT 'status', status FROM order_rows)
        WHERE v IS NOT NULL GROUP BY c, v) SELECT c AS column_name, v AS value, n, round(ln(n + 1) / sum(ln(n + 1)) OVER (PARTITION BY c), 6) AS weight FROM n""",
    ("order_rows",),
)
def condition_weights(t: Tables):
    out = P.condition_weights(t("order_rows"), ["priority", "status"])
    return rounded(out.withColumnRenamed("column", "column_name").withColumnRenamed("count", "n"), weight=6)


@check("conditional_sample", "SELECT count(*) AS n_draws, count(*) AS n_numbers, 0 AS n_mismatches, true AS near_weights FROM order_rows", ("order_rows",))
def conditional_sample(t: Tables):
    """Draws are numbered without gaps, their rows have the drawn value, and shares follow the weights within five deviations."""
    df = t("order_rows")
    drawn = P.conditional_sample(df, ["priority", "status"], "id", df.count())
    met = drawn.join(df, "id").select("draw", "column", "value", F.when(F.col("column") == "priority", F.col("priority")).otherwise(F.col("status")).alias("held"))
    n = df.count()
    shares = met.groupBy("column", "value").agg(F.count(F.lit(1)).alias("got")).join(P.condition_weights(df, ["priority", "status"]), ["column", "value"], "right")
    near = shares.agg(F.bool_and(F.abs(F.coalesce("got", F.lit(0)) - F.col("weight") * n / 2) <= 5 * F.sqrt(F.col("weight") * n / 2))).first()[0]
    facts = met.agg(
        F.count(F.lit(1)).alias("n_draws"), F.countDistinct("draw").alias("n_numbers"),
        F.count(F.when(~F.col("held").eqNullSafe(F.col("value")), 1)).alias("n_mismatches"),
    )
    return facts.withColumn("near_weights", F.lit(near))


@check(
    "mode_normalize",
    "SELECT l_orderkey, l_linenumber, true AS inside, true AS back FROM lineitem",
)
def mode_normalize(t: Tables):
    """Every value has a mode and an offset within one, and mode and offset give the value back where it is not clipped."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    modes = P.fit_modes(df, "l_extendedprice")
    out = P.mode_normalized(df, "l_extendedprice", modes, F.concat_ws(":", "l_orderkey", "l_linenumber"))
    pick = lambda k: F.element_at(F.array(*[F.lit(m[k]) for m in modes]), F.col("l_extendedprice_mode"))
    offset = F.col("l_extendedprice_offset")
    back = F.abs(offset * 4 * pick(2) + pick(1) - F.col("l_extendedprice")) < 1e-6
    return out.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice_mode").between(1, len(modes)) & offset.between(-1, 1)).alias("inside"),
        (back | (F.abs(offset) == 1)).alias("back"),
    )


MANY_MODES = "l_linenumber * 10 + l_discount * 10 + l_tax * 10 + (l_partkey % 11) / 11"


@check(
    "mode_recovery",
    f"SELECT CAST(l_linenumber AS INTEGER) AS mode, count(*) AS n, round(avg({MANY_MODES}), 6) + 0e0 AS mean FROM lineitem GROUP BY l_linenumber",
)
def mode_recovery(t: Tables):
    """Seven heaps of values that lie apart: as many modes are found, and each row is drawn to its own heap's."""
    df = t("lineitem").selectExpr("l_orderkey", "l_linenumber", f"CAST({MANY_MODES} AS DOUBLE) AS x")
    out = P.mode_normalized(df, "x", P.fit_modes(df, "x"), F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return rounded(out.groupBy(F.col("x_mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), mean=6)


# A score with ties and a label, both from the whole of orders.
SCORED = "SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, round(o_totalprice / 1000, 0) + (o_custkey % 7) AS score, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS prediction FROM {orders}"


@check(
    "binary_metrics",
    f"""WITH s AS ({SCORED.replace('{orders}', 'orders')}), k AS (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) AS rk FROM s),
      a AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM k),
      c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
            count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM s)
      SELECT tn, fp, fn, tp, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fn), 6) AS recall_minority,
             round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(auc, 6) AS auc FROM c, a""",
)
def binary_metrics(t: Tables):
    scored = t.spark.sql(SCORED, orders=t("orders"))
    return rounded(L.binary_metrics(scored), f1=6, recall_minority=6, accuracy=6, auc=6)


# Held-out rows of each class beside a fifth of the class, both tables together where there are two.
HELD_OUT = """SELECT CAST(floor(count(*) FILTER (status <> 'F') * 0.2e0 + 0.5e0) AS BIGINT) AS n_negative,
    CAST(floor(count(*) FILTER (status = 'F') * 0.2e0 + 0.5e0) AS BIGINT) AS n_positive FROM {t}"""
BOTH_ORDERS = "(SELECT status FROM order_rows UNION ALL SELECT status FROM order_syn)"


def held_out(frame):
    """Sizes of the part that the learner scores."""
    return frame.where("is_test").agg(F.count(F.when(F.col("__y") == 0, 1)).alias("n_negative"), F.count(F.when(F.col("__y") == 1, 1)).alias("n_positive"))


@check("gbt_real")
def gbt_real(t: Tables, rounds: int = L.ROUNDS):
    """The metrics of all orders, rows with nulls included; boosted trees are beyond SQL, their split has an oracle below."""
    return L.train_real(t("order_rows"), "status", "F", "id", rounds)[1]


@check("gbt_real_split", HELD_OUT.format(t="order_rows"), ("order_rows",))
def gbt_real_split(t: Tables):
    return held_out(L.real_parts(t("order_rows"), "status", "F", "id")[0])


@check("gbt_mixed")
def gbt_mixed(t: Tables, rounds: int = L.ROUNDS):
    return L.train_mixed(t("order_rows"), t("order_syn"), "status", "F", "id", rounds=rounds)[1]


@check("gbt_mixed_split", HELD_OUT.format(t=BOTH_ORDERS), ("order_rows", "order_syn"))
def gbt_mixed_split(t: Tables):
    return held_out(L.mixed_parts(t("order_rows"), t("order_syn"), "status", "F", "id")[0])


# The first boosted split on all orders: derivatives at a margin of zero, cut points by counting, every cut both ways, every category by its own.
FIRST_SPLIT = f"""
    WITH r AS (SELECT CAST(cust AS DOUBLE) AS cust, total, {TOKEN} AS priority, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS y FROM order_rows),
    d AS (SELECT DISTINCT cust, total FROM r),
    v AS (SELECT 0 AS k, 'cust' AS name, cust AS x FROM d WHERE cust IS NOT NULL UNION ALL SELECT 1, 'total', total FROM d WHERE total IS NOT NULL),
    s AS (SELECT k, name, list_sort(list(x)) AS xs, count(DISTINCT x) AS n FROM v GROUP BY k, name),
    cuts AS (SELECT DISTINCT k, name, unnest(CASE WHEN n <= 256 THEN list_distinct(xs) ELSE list_transform(range(1, 256), lambda i: xs[1 + i * len(xs) // 256]) END) AS cut,
                    xs[1] AS least, n FROM s),
    u AS (SELECT (CASE WHEN y = 1 THEN -0.5e0 ELSE 0.5e0 END) AS g, 0.25e0 AS h, cust, total, priority FROM r),
    whole AS (SELECT sum(g) AS g, sum(h) AS h FROM u),
    x AS (SELECT 0 AS k, cust AS x, g, h FROM u UNION ALL SELECT 1, total, g, h FROM u),
    num AS (SELECT k, name, cut, null_left, sum(g) FILTER (x < cut OR (x IS NULL AND null_left)) AS g, sum(h) FILTER (x < cut OR (x IS NULL AND null_left)) AS h
            FROM cuts JOIN x USING (k), (VALUES (true), (false)) w(null_left) WHERE n > 256 OR cut > least GROUP BY k, name, cut, null_left),
    cat AS (SELECT 2 AS k, 'priority' AS name, priority AS category, whole.g - sum(u.g) AS g, whole.h - sum(u.h) AS h FROM u, whole GROUP BY priority, whole.g, whole.h),
    way AS (SELECT k, name, cut, NULL AS category, null_left, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM num UNION ALL SELECT k, name, NULL, category, false, g, h FROM cat),
    got AS (SELECT way.*, whole.g - way.g AS rg, whole.h - way.h AS rh,
                   way.g * way.g / (way.h + 1) + (whole.g - way.g) * (whole.g - way.g) / (whole.h - way.h + 1) - whole.g * whole.g / (whole.h + 1) AS gain FROM way, whole)
    SELECT name AS column_name, cut, category, null_left, round(gain, 6) AS gain, round(-0.3e0 * g / (h + 1), 6) + 0e0 AS left_value, round(-0.3e0 * rg / (rh + 1), 6) + 0e0 AS right_value
    FROM got WHERE h >= 1 AND rh >= 1 ORDER BY got.gain DESC, k, cut, null_left DESC LIMIT 1"""


@check("gbt_first_split", FIRST_SPLIT, ("order_rows",))
def gbt_first_split(t: Tables):
    """One round of depth one: the split that the boosted trees begin with, nulls and categories included."""
    df = t("order_rows").withColumn("__y", (F.col("status") == "F").cast("int"))
    frame, numeric, text = L.feature_frame(df, ["cust", "total", "priority"], ["__y"])
    model = trees.boost(frame, numeric, text, "__y", rounds=1, depth=1)
    tree, names = model.trees[0], ["cust", "total", "priority"]
    c, at = int(tree.col[1]), int(tree.at[1])
    cut = float(model.code.cuts[c][at - 1]) if c < 2 else None
    category = None if c < 2 else frame.where(F.xxhash64("t0") == at).first()["t0"]
    y = frame.agg(F.sum("__y"), F.count(F.lit(1))).first()
    # The gain follows from the leaves: each is -rate * G / (H + 1).
    parts = {i: (-tree.value[i] / 0.3, None) for i in (1, 2, 3)}
    goes = F.col(numeric[c]) < cut if c < 2 else F.col("t0") != category
    left = F.coalesce(goes, F.lit(bool(tree.null_left[1])))
    h = {1: y[1] / 4, 2: frame.where(left).count() / 4}
    h[3] = h[1] - h[2]
    gain = sum(parts[i][0] ** 2 * (h[i] + 1) * (1 if i > 1 else -1) for i in (1, 2, 3))
    out = t.spark.createDataFrame(
        [(names[c], cut, category, bool(tree.null_left[1]), float(gain), float(tree.value[2]), float(tree.value[3]))],
        "column_name string, cut double, category string, null_left boolean, gain double, left_value double, right_value double",
    )
    return rounded(out, gain=6, left_value=6, right_value=6)


@check("features_and_label", f"SELECT id, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS y, CAST(cust AS DOUBLE) AS cust, total, {TOKEN} AS priority FROM order_rows", ("order_rows",))
def features_and_label(t: Tables):
    """The features apart from the label, as the classifiers take them: numbers with their nulls, categories as tokens."""
    df = t("order_rows").withColumn("y", (F.col("status") == "F").cast("int"))
    return L.feature_frame(df, ["cust", "total", "priority"], ["id", "y"])[0].toDF("id", "y", "cust", "total", "priority")


@check(
    "last_shared_label",
    """SELECT max(v) AS label, count(*) AS n_shared FROM (SELECT priority AS v FROM order_rows WHERE priority IS NOT NULL INTERSECT SELECT priority FROM order_syn)""",
    ("order_rows", "order_syn"),
)
def last_shared_label(t: Tables):
    found, shared = L.last_shared_label(t("order_rows"), t("order_syn"), "priority")
    return t.spark.createDataFrame([(found, shared)], "label string, n_shared long")


@check("mia_auc")
def mia_auc(t: Tables):
    return one_row(t.spark, auc=L.membership_auc(t("order_rows").drop("id"), t("order_syn").drop("id")))


@check("tstr_f1")
def tstr_f1(t: Tables):
    return one_row(t.spark, f1=L.synthetic_to_real_f1(t("order_rows"), t("order_syn"), ORDER_SCHEMA))


SPANS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, v AS item, round((sum(n) OVER (ORDER BY v) - n) / sum(n) OVER (), 6) AS lo, round(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 6) AS hi
        FROM (SELECT {e} AS v, count(*) AS n FROM order_rows GROUP BY 1)"""
    for c, e in (("priority", TOKEN), ("status", "status"))
)


@check(
    "synth_fit",
    f"""SELECT 'cust' AS column_name, NULL AS item, round(min(cust), 6) + 0e0 AS lo, round(max(cust), 6) + 0e0 AS hi FROM order_rows UNION ALL
        SELECT 'total', NULL, round(min(total), 6), round(max(total), 6) FROM order_rows UNION ALL SELECT * FROM ({SPANS})""",
    ("order_rows",),
)
def synth_fit(t: Tables):
    """Each category's interval of probabilities and each numeric column's range."""
    model = Y.fit(t("order_rows"), ORDER_SCHEMA)
    ends = t.spark.createDataFrame([(c, None, m.knots[0], m.knots[-1]) for c, m in model.numeric.items()], "column_name string, item string, lo double, hi double")
    spans = model.categories.select(F.col("column").alias("column_name"), F.col("value").alias("item"), "lo", "hi")
    return rounded(ends.unionByName(spans), lo=6, hi=6)


def kept_inside(t: Tables, drawn, conditions: dict):
    """Per column: drawn rows, rows outside what the real table holds, and rows that meet the condition."""
    real = P.training_frame(t("order_rows"), ORDER_SCHEMA)
    ends = real.agg(*[f(c).alias(f"{k}_{c}") for c in ORDER_SCHEMA.numeric for k, f in (("low", F.min), ("high", F.max))]).first()
    known = {c: [r[0] for r in real.select(c).distinct().collect()] for c in ("priority", "status")}
    outside = [F.count(F.when(~F.col(c).between(ends[f"low_{c}"], ends[f"high_{c}"]) | F.col(c).isNull(), 1)) for c in ORDER_SCHEMA.numeric]
    outside += [F.count(F.when(~F.coalesce(F.col(c), F.lit("")).isin(known[c]), 1)) for c in known]
    names = [*ORDER_SCHEMA.numeric, *known]
    outside = [o for c, o in zip(names, outside) if c in drawn.columns]
    names = [c for c in names if c in drawn.columns]
    met = [F.count(F.when(F.col(c) == conditions[c], 1)) if c in conditions else F.count(F.lit(1)) for c in names]
    cells = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), o.alias("n_outside"), m.alias("n_met")) for c, o, m in zip(names, outside, met)]
    return drawn.select(*[F.col(c) for c in drawn.columns]).agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")


def inside(*columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, 0 AS n_outside, count(*) AS n_met FROM order_rows" for c in columns)


INSIDE = inside("cust", "total", "priority", "status")


@check("synth_generate", INSIDE, ("order_rows",))
def synth_generate(t: Tables):
    """As many rows as the real table has, every column inside what that holds."""
    df = t("order_rows")
    return kept_inside(t, Y.generate(t.spark, Y.fit(df, ORDER_SCHEMA), df.count()), {})


@check("synth_conditional", INSIDE, ("order_rows",))
def synth_conditional(t: Tables):
    df = t("order_rows")
    return kept_inside(t, Y.generate(t.spark, Y.fit(df, ORDER_SCHEMA), df.count(), condition={"status": "F"}), {"status": "F"})


LINES = TableSchema(("discount", "tax"), ("flag", "ship", "size"), (), "status")
LINE_ROWS = """SELECT l_discount AS discount, l_tax AS tax, l_returnflag AS flag, CAST(l_linenumber AS VARCHAR(10)) AS size,
    CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS ship, l_linestatus AS status FROM lineitem"""
LINE_COLUMNS = ("discount", "flag", "ship", "size", "status", "tax")
ENTROPY = "(SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM l GROUP BY {}))"


@check(
    "column_information",
    f"WITH l AS ({LINE_ROWS}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(greatest({ENTROPY.format(a)} + {ENTROPY.format(b)} - {ENTROPY.format(a + ', ' + b)}, 0), 6) + 0e0 AS information"
        for i, a in enumerate(LINE_COLUMNS) for b in LINE_COLUMNS[i + 1 :]
    ),
)
def column_information(t: Tables):
    """Mutual information of every pair of columns, from which the generator's tree is chosen."""
    df = t.spark.sql(LINE_ROWS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t("lineitem"))
    found, columns = dependence.mutual_information(df, LINES)
    pairs = [(*sorted((columns[i], columns[j])), v) for (i, j), v in found.items()]
    return rounded(t.spark.createDataFrame(pairs, "column_a string, column_b string, information double"), information=6)


@check(
    "tree_synth_pairs",
    "SELECT count(*) AS n_rows, 3 AS n_edges, true AS within_chance, CAST(count(*) FILTER (status = 'F') AS BIGINT) AS n_given, true AS given_within_chance FROM order_rows",
    ("order_rows",),
)
def tree_synth_pairs(t: Tables):
    """Joint shares of the drawn rows on every edge of the tree, and below a condition, within chance of the real ones."""
    real = P.training_frame(t("order_rows"), ORDER_SCHEMA)
    model = dependence.fit(t("order_rows"), ORDER_SCHEMA)
    n, n_given = real.count(), real.where("status = 'F'").count()

    def near(real_rows, drawn, size):
        ok = True
        a, b = (dependence.states(x.select(*model.columns), model.columns, model.numbers) for x in (real_rows, drawn))
        for i, j in model.edges:
            want = a.groupBy(f"s{i}", f"s{j}").agg((F.count(F.lit(1)) / size).alias("want"))
            got = b.groupBy(F.col(f"s{i}").alias("__i"), F.col(f"s{j}").alias("__j")).agg((F.count(F.lit(1)) / size).alias("got"))
            both = want.join(got, (F.col(f"s{i}") == F.col("__i")) & (F.col(f"s{j}") == F.col("__j")), "full").na.fill(0.0, ["want", "got"])
            # Eight deviations, and a rounded value may stand in the next bin.
            ok &= both.where(F.abs(F.col("got") - F.col("want")) > 8 * F.sqrt((F.col("want") + 1 / size) / size) + 0.1 * F.col("want")).isEmpty()
        return ok

    drawn, given = dependence.generate(t.spark, model, n), dependence.generate(t.spark, model, n_given, condition={"status": "F"})
    drawn, given = written(drawn), written(given)
    # Below a condition only the edges at the given column keep their real joint counts; along the tree all do.
    at = model.columns.index("status")
    near_given = near(real.where("status = 'F'"), given, n_given) if all(at in e for e in model.edges) else given.where("status != 'F'").isEmpty()
    return one_row(t.spark, n_rows=drawn.count(), n_edges=len(model.edges), within_chance=near(real, drawn, n), n_given=given.count(), given_within_chance=near_given)


@check(
    "synth_marginals",
    """SELECT 'name' AS column_name, count(*) * 100 AS n_rows, 0 AS n_unknown, 0 AS n_missing, true AS within_chance FROM customer
       UNION ALL SELECT 'cust', count(*) * 40, 0, 0, true FROM orders""",
)
def synth_marginals(t: Tables):
    """Columns of very many categories: all are drawn, no others, each as often as its share asks, within eight deviations."""
    names = t("customer").selectExpr("c_name AS name", "c_mktsegment AS label")
    keys = t("orders").selectExpr("concat('c', o_custkey) AS cust", "o_orderstatus AS label")
    out = None
    for df, c, times in ((names, "name", 100), (keys, "cust", 40)):
        n = df.count()
        drawn = Y.generate(t.spark, Y.fit(df, TableSchema((), (c,), (), "label")), n * times).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("got"))
        want = df.groupBy(F.col(c).alias("value")).agg((F.count(F.lit(1)) * times).alias("want"))
        both = want.join(drawn, "value", "full").select(F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("got", F.lit(0)).alias("got"))
        found = both.agg(
            F.sum("got").alias("n_rows"), F.count(F.when(F.col("want") == 0, 1)).alias("n_unknown"), F.count(F.when(F.col("got") == 0, 1)).alias("n_missing"),
            F.bool_and(F.abs(F.col("got") - F.col("want")) <= 8 * F.sqrt("want")).alias("within_chance"),
        ).select(F.lit(c).alias("column_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out
