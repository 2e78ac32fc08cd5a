"""Contract queries over row-wise projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions import scalars
from fieldglass.operators import skew
from fieldglass.plans.registry import cents, query, rounded


@query("derive_outcome", """
WITH x AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS h, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 50 END AS a FROM orders
)
SELECT o_orderkey, h AS home, a AS away, h IS NOT NULL AND a IS NOT NULL AS is_completed, h > a AS home_win, a > h AS away_win, h = a AS is_tie, h - a AS point_differential, h + a AS total_points,
  CASE WHEN h > a THEN 'HOME_WIN' WHEN h < a THEN 'AWAY_WIN' WHEN h = a THEN 'TIE' ELSE 'NOT_PLAYED' END AS game_result FROM x
""")
def derive_outcome(t):
    played = F.col("o_orderstatus") != "P"
    rows = t.orders.select(
        "o_orderkey", F.when(played, F.floor(F.col("o_totalprice") / 10000)).alias("home"), F.when(played, F.col("o_custkey") % 50).alias("away")
    )
    return scalars.derive_outcome(rows, "home", "away")


@query("filter_valid", """
SELECT event_id, user_id FROM events
WHERE value IS NOT NULL AND coalesce(CAST(event_type = 'error' AS INTEGER), 0) = 0 AND (event_type IN ('view', 'purchase') OR value >= 50)
""")
def filter_valid(t):
    rows = t.events.select(
        "event_id", "user_id", "value", (F.col("event_type") == "error").cast("int").alias("is_error"),
        F.col("event_type").isin("view", "purchase").cast("int").alias("is_core"), (F.col("value") >= 50).cast("int").alias("is_large"),
    )
    return scalars.filter_valid(rows, ["value"], ["is_error"], ["is_core", "is_large"]).select("event_id", "user_id")


@query("classify_flags", """
SELECT o_orderkey, coalesce(o_totalprice BETWEEN 50000 AND 300000, false) AS is_competitive, coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS is_final,
  CASE WHEN month(o_orderdate) <= 6 THEN 'early' WHEN month(o_orderdate) <= 9 THEN 'middle' ELSE 'late' END AS phase FROM orders
""")
def classify_flags(t):
    return t.orders.select(
        "o_orderkey",
        scalars.flag(F.col("o_totalprice").between(50000, 300000)).alias("is_competitive"),
        scalars.flag(F.nullif("o_orderstatus", F.lit("P")) == "F").alias("is_final"),
        scalars.bucket_label(F.month("o_orderdate"), [(6, "early"), (9, "middle")], "late").alias("phase"),
    )


@query("threshold_diff", """
WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 15 AS BIGINT) AS a, CAST(o_custkey % 15 AS BIGINT) AS b FROM orders)
SELECT o_orderkey, CAST(a <= 6 AS INTEGER) AS short_a, CAST(b <= 6 AS INTEGER) AS short_b, CAST(a <= 6 AS INTEGER) - CAST(b <= 6 AS INTEGER) AS short_diff,
  CAST(a >= 13 AS INTEGER) - CAST(b >= 13 AS INTEGER) AS bye_diff FROM x
""")
def threshold_diff(t):
    a, b = F.col("o_orderkey") % 15, F.col("o_custkey") % 15
    short, bye = scalars.threshold_diff(a, b, low=6), scalars.threshold_diff(a, b, low=None, high=13)
    return t.orders.select(
        "o_orderkey", short["a_flag"].alias("short_a"), short["b_flag"].alias("short_b"), short["flag_diff"].alias("short_diff"), bye["flag_diff"].alias("bye_diff")
    )


@query("hinge_features", """
WITH x AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity AS q, coalesce(nullif(lower(trim(nullif(l_returnflag, 'A'))), ''), 'unknown') AS category FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, category, CASE WHEN category <> 'unknown' THEN greatest(q - 30, 0) ELSE 0 END AS above_30,
  CASE WHEN category <> 'unknown' THEN greatest(10 - q, 0) ELSE 0 END AS below_10 FROM x
""")
def hinge_features(t):
    category = scalars.category(F.nullif("l_returnflag", F.lit("A")))
    known = category != "unknown"
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", category.alias("category"),
        scalars.hinge(q, 30, "above", known).alias("above_30"), scalars.hinge(q, 10, "below", known).alias("below_10"),
    )


@query("clean_text", """
SELECT p_partkey, nullif(trim(CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END), '') AS clean_name, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type END AS allowed_type FROM part
""")
def clean_text(t):
    padded = F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return t.part.select(
        "p_partkey", scalars.clean_text(padded).alias("clean_name"), scalars.allow_list(F.col("p_type"), ["ECONOMY", "SMALL"]).alias("allowed_type")
    )


@query("numeric_or_reject", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value FROM events WHERE event_type <> 'error'
""")
def numeric_or_reject(t):
    blank = F.col("event_type") == "error"
    text = F.get_json_object("props", "$.k")
    rows = t.events.select(
        "event_id", F.when(~blank, text).alias("k"), F.when(~blank, F.col("value").cast("string")).alias("value")
    )
    return scalars.numeric_or_reject(rows, ["k", "value"])


@query("assign_split", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1997 THEN 'DEVELOPMENT' WHEN year(o_orderdate) <= 1999 THEN 'VALIDATION' ELSE 'HOLDOUT' END AS split,
  o_orderstatus <> 'P' AND year(o_orderdate) <= 1999 AS is_eligible FROM orders
""")
def assign_split(t):
    year = F.year("o_orderdate")
    return t.orders.select(
        "o_orderkey", scalars.assign_split(year, [(1997, "DEVELOPMENT"), (1999, "VALIDATION")], "HOLDOUT").alias("split"),
        ((F.col("o_orderstatus") != "P") & (year <= 1999)).alias("is_eligible"),
    )


@query("local_date", """
SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS local_day, CAST(ts AS DATE) AS utc_day FROM events
""")
def local_date(t):
    return t.events.select(
        "event_id", scalars.local_date(F.col("ts"), "America/New_York").alias("local_day"), F.to_date("ts").alias("utc_day")
    )


@query("rating_probability", """
WITH r AS (SELECT c_custkey, 1500 + c_acctbal / 50 AS own, 1500 + ((c_custkey * 37) % 400) AS other, CAST(c_custkey % 3 AS DOUBLE) * 20 AS adv, c_custkey % 4 AS seasons FROM customer),
g AS (SELECT *, 1500 + (own - 1500) * pow(0.6, seasons) AS reg FROM r)
SELECT c_custkey, round(reg, 6) AS regressed_rating, round(1 / (1 + pow(10, (other - (reg + adv)) / 400)), 9) AS win_probability, round((reg - other) * ln(10) / 400, 6) AS rating_log_odds, round(adv * ln(10) / 400, 6) AS venue_log_odds,
  CASE WHEN abs(reg + adv - other) < 25 THEN 'toss_up' WHEN abs(reg + adv - other) < 75 THEN 'slight_edge' WHEN abs(reg + adv - other) < 150 THEN 'clear_edge' ELSE 'strong_edge' END AS matchup FROM g
""")
def rating_probability(t):
    rows = t.customer.select(
        "c_custkey", (F.lit(1500) + F.col("c_acctbal") / 50).alias("own"), (F.lit(1500) + (F.col("c_custkey") * 37) % 400).cast("double").alias("other"),
        ((F.col("c_custkey") % 3).cast("double") * 20).alias("adv"), (F.col("c_custkey") % 4).alias("seasons"),
    ).withColumn("reg", scalars.regress_rating(F.col("own"), F.col("seasons")))
    parts = scalars.explain_rating(F.col("reg"), F.col("other"), F.col("adv"))
    return rows.select(
        "c_custkey", rounded("reg").alias("regressed_rating"),
        rounded(scalars.rating_probability(F.col("reg"), F.col("other"), F.col("adv")), 9).alias("win_probability"),
        rounded(parts["rating_log_odds"]).alias("rating_log_odds"), rounded(parts["venue_log_odds"]).alias("venue_log_odds"), parts["matchup"].alias("matchup"),
    )


@query("route_fallback", """
SELECT d.doc_id, round(CASE WHEN quality IS NOT NULL THEN 0.7 * (n_chars / (n_chars + 2000.0::DOUBLE)) + 0.3 * quality ELSE 0.5 END, 6) AS prediction,
  CASE WHEN quality IS NOT NULL THEN 'PRIMARY' ELSE 'FALLBACK' END AS prediction_mode, CASE WHEN quality IS NOT NULL THEN 'COMPLETE_INPUTS' ELSE 'MISSING_INPUTS' END AS route_reason
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def route_fallback(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    primary = F.lit(0.7) * (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))) + F.lit(0.3) * F.col("quality")
    out = scalars.route_fallback(rows, F.col("quality").isNotNull(), primary, F.lit(0.5))
    return out.withColumn("prediction", rounded("prediction")).drop("n_chars", "quality")


@query("score_split", """
SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) + (o_custkey % 21 - 10)) / 2 AS home_score, (CAST(round(o_totalprice * 100) AS BIGINT) - (o_custkey % 21 - 10)) / 2 AS away_score,
  CASE WHEN o_custkey % 21 - 10 >= 0 THEN 'HOME' ELSE 'AWAY' END AS winner FROM orders
""")
def score_split(t):
    columns = scalars.score_split(cents("o_totalprice"), F.col("o_custkey") % 21 - 10)
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in columns.items()])


@query("impact_score", """
WITH x AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
    CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'Out' WHEN 1 THEN 'Doubtful' WHEN 2 THEN 'Questionable' END AS st,
    CASE l_returnflag WHEN 'R' THEN 'DNP' WHEN 'A' THEN 'LIMITED' ELSE 'FULL' END AS pr,
    CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN 'STARTER' WHEN 1 THEN 'PRIMARY_BACKUP' WHEN 2 THEN 'RESERVE' ELSE 'OTHER' END AS tier,
    CASE WHEN l_linestatus = 'O' THEN l_discount * 10 END AS usage, l_linenumber AS games FROM lineitem
), y AS (
  SELECT *, CASE WHEN st IS NULL THEN 0 WHEN st = 'Out' THEN 1 ELSE greatest(0, least(1, CASE st WHEN 'Doubtful' THEN 0.75::DOUBLE ELSE 0.35::DOUBLE END + CASE pr WHEN 'DNP' THEN 0.10::DOUBLE WHEN 'LIMITED' THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END)) END AS sev,
    CASE tier WHEN 'STARTER' THEN 1.0::DOUBLE WHEN 'PRIMARY_BACKUP' THEN 0.55::DOUBLE WHEN 'RESERVE' THEN 0.25::DOUBLE ELSE 0.40::DOUBLE END AS depth, least(games / 4, 1.0::DOUBLE) AS rel FROM x
), z AS (SELECT *, CASE WHEN usage IS NOT NULL THEN rel * usage + (1 - rel) * depth ELSE depth END AS imp FROM y)
SELECT l_orderkey, l_linenumber, l_partkey, round(sev, 6) AS severity, round(imp, 6) AS importance, round(sev * imp, 6) AS impact FROM z
""")
def impact_score(t):
    q = F.col("l_quantity").cast("long")
    status = F.when(q % 4 == 0, "Out").when(q % 4 == 1, "Doubtful").when(q % 4 == 2, "Questionable")
    practice = scalars.map_codes(F.col("l_returnflag"), {"R": "DNP", "A": "LIMITED"}, unmapped=F.lit("FULL"))
    tier = F.when(q % 5 == 0, "STARTER").when(q % 5 == 1, "PRIMARY_BACKUP").when(q % 5 == 2, "RESERVE").otherwise("OTHER")
    usage = F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 10)
    columns = scalars.impact_columns(status, practice, tier, usage, F.col("l_linenumber"), scalars.IMPACT_WEIGHTS)
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", *[rounded(c).alias(n) for n, c in columns.items()]
    )


@query("pair_features", """
SELECT o_orderkey, a + b AS cents_sum, a - b AS cents_difference FROM (
  SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS a, CAST(round(c_acctbal * 100) AS BIGINT) AS b FROM orders JOIN customer ON c_custkey = o_custkey)
""")
def pair_features(t):
    balance = t.customer.select(F.col("c_custkey").alias("o_custkey"), cents("c_acctbal").alias("away_cents"))
    rows = skew.join_lookup(t.orders.select("o_orderkey", "o_custkey", cents("o_totalprice").alias("home_cents")), balance, "o_custkey", "inner")
    return rows.select("o_orderkey", *[c.alias(n) for n, c in scalars.pair_features(["cents"]).items()])


@query("clip_share", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, least(nullif(l_quantity, 50) / 40, 1.0::DOUBLE) AS share, coalesce(nullif(l_quantity, 50) / 40 > 1, false) AS was_capped FROM lineitem
WHERE l_quantity <> 50 UNION ALL SELECT l_orderkey, CAST(l_linenumber AS BIGINT), l_partkey, NULL, false FROM lineitem WHERE l_quantity = 50
""")
def clip_share(t):
    columns = scalars.clip_share(F.nullif("l_quantity", F.lit(50.0)) / 40)
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", *[c.alias(n) for n, c in columns.items()])


@query("render_text", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' is final.' WHEN o_totalprice >= 300000 THEN 'Order ' || o_orderkey || ' is large.' ELSE 'Order ' || o_orderkey || ' is open.' END AS text_en,
  CASE WHEN o_orderstatus = 'F' THEN 'El pedido ' || o_orderkey || ' del cliente ' || o_custkey || ' es final.' WHEN o_totalprice >= 300000 THEN 'El pedido ' || o_orderkey || ' es grande.' ELSE 'El pedido ' || o_orderkey || ' sigue abierto.' END AS text_es FROM orders
""")
def render_text(t):
    final, large, always = F.col("o_orderstatus") == "F", F.col("o_totalprice") >= 300000, F.lit(True)
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    columns = scalars.render_text({
        "text_en": [
            (final, "Order %d of customer %d is final.", [key, who]), (large, "Order %d is large.", [key]), (always, "Order %d is open.", [key]),
        ],
        "text_es": [
            (final, "El pedido %d del cliente %d es final.", [key, who]), (large, "El pedido %d es grande.", [key]), (always, "El pedido %d sigue abierto.", [key]),
        ],
    })
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in columns.items()])


@query("guardrail_status", """
WITH f AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_discount < 0.025 AS a, l_tax > 0.06 AS b, l_quantity < 5 AS c FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, a AS flag_low_edge, b AS flag_high_value, c AS flag_few_books,
  concat_ws(',', CASE WHEN a THEN 'low_edge' END, CASE WHEN b THEN 'high_value' END, CASE WHEN c THEN 'few_books' END) AS violations,
  CASE WHEN a THEN 'low_edge' WHEN b THEN 'high_value' WHEN c THEN 'few_books' ELSE 'PUBLISH' END AS status FROM f
""")
def guardrail_status(t):
    columns = scalars.classify_rules([
        ("low_edge", F.col("l_discount") < 0.025), ("high_value", F.col("l_tax") > 0.06), ("few_books", F.col("l_quantity") < 5),
    ])
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", *[c.alias(n) for n, c in columns.items()])


@query("before_event", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < l_shipdate
""")
def before_event(t):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_shipdate")
    rows = skew.join_lookup(rows, orders, "l_orderkey", "inner")
    return scalars.before_event(rows, "l_shipdate", ["o_orderdate"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("market_sides", """
WITH x AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'h2h' WHEN 'A' THEN 'spreads' ELSE 'totals' END AS m,
    CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'Over' ELSE 'Under' END WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'B' ELSE 'C' END AS name, l_quantity - 25 AS point FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m = 'totals' THEN lower(name) WHEN name = 'A' THEN 'home' WHEN name = 'B' THEN 'away' ELSE 'other' END AS side,
  CASE m WHEN 'spreads' THEN abs(point) WHEN 'totals' THEN point END AS market_line FROM x
""")
def market_sides(t):
    market = scalars.map_codes(F.col("l_returnflag"), {"R": "h2h", "A": "spreads"}, unmapped=F.lit("totals"))
    third = F.col("l_partkey") % 3
    name = (
        F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "Over").otherwise("Under"))
        .when(third == 0, "A").when(third == 1, "B").otherwise("C")
    )
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
        scalars.outcome_side(name, F.lit("A"), F.lit("B")).alias("side"), scalars.market_line(market, F.col("l_quantity") - 25).alias("market_line"),
    )


@query("conform_cast", """
SELECT try_cast(substr(c_name, 10) AS BIGINT) AS customer_number, try_cast(c_mktsegment AS BIGINT) AS segment_number, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS note FROM customer
""")
def conform_cast(t):
    raw = t.customer.select(
        F.substring("c_name", 10, 20).alias("customer_number"), F.col("c_mktsegment").alias("segment_number"), F.col("c_acctbal").cast("string").alias("balance")
    )
    schema = T.StructType([
        T.StructField("customer_number", T.LongType()), T.StructField("segment_number", T.LongType()),
        T.StructField("balance", T.DoubleType()), T.StructField("note", T.StringType()),
    ])
    return scalars.conform_schema(raw, schema)
