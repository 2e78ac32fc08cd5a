"""Contract queries over ordered history: windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.operators import asof, joins, topk, windows
from fieldglass.plans.registry import cents, query, rounded


@query("best_with_consensus", """
WITH x AS (
  SELECT *, l_extendedprice / l_quantity AS unit_price FROM lineitem
), y AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY unit_price DESC, l_suppkey, l_orderkey, l_linenumber) AS rn,
    count(*) OVER (PARTITION BY l_partkey) AS n, avg(unit_price) OVER (PARTITION BY l_partkey) AS a,
    min(unit_price) OVER (PARTITION BY l_partkey) AS lo
  FROM x
)
SELECT l_partkey, l_suppkey AS best_l_suppkey, l_orderkey AS best_l_orderkey, CAST(l_linenumber AS BIGINT) AS best_l_linenumber,
  round(unit_price, 9) AS best_unit_price, n AS offer_count, round(a, 4) AS average_unit_price, round(lo, 9) AS minimum_unit_price
FROM y WHERE rn = 1
""")
def best_with_consensus(t):
    rows = t.lineitem.select(
        "l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )
    keys = ["l_suppkey", "l_orderkey", "l_linenumber"]
    best = windows.best_with_consensus(rows, "l_partkey", "unit_price", keys, keys)
    return best.withColumns({
        "best_unit_price": rounded("best_unit_price", 9),
        "average_unit_price": rounded("average_unit_price", 4),
        "minimum_unit_price": rounded("minimum_unit_price", 9),
    })


@query("normalise_within", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS order_total,
  round(CAST(round(l_extendedprice * 100) AS BIGINT) / nullif(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT), 0), 9) AS share
FROM lineitem
""")
def normalise_within(t):
    rows = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", cents("l_extendedprice").alias("price")
    )
    out = windows.normalise_within(rows, "l_orderkey", "price", "share", "order_total")
    return out.withColumn("share", rounded("share", 9))


@query("rolling_prior", """
WITH x AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders)
SELECT o_custkey, o_orderkey,
  count(*) OVER w4 AS games_last_4, CAST(sum(price) OVER w4 AS BIGINT) / nullif(count(*) OVER w4, 0) AS price_last_4,
  count(*) OVER w8 AS games_last_8, CAST(sum(price) OVER w8 AS BIGINT) / nullif(count(*) OVER w8, 0) AS price_last_8,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS games_before
FROM x
WINDOW w4 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
       w8 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
""")
def rolling_prior(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", cents("o_totalprice").alias("price"))
    out = windows.rolling_prior(
        rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["price"], [4, 8]
    )
    return out.drop("o_orderdate", "price")


@query("running_history", """
WITH x AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS amount FROM events)
SELECT user_id, event_id, ts, amount, row_number() OVER w AS rows_so_far,
  lag(ts) OVER w AS previous_ts,
  CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT)
    / count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS amount_last_4,
  CAST(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS BIGINT) AS day_gap
FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def running_history(t):
    rows = t.events.select("user_id", "event_id", "ts", cents("value").alias("amount"))
    return windows.running_history(rows, "user_id", ["ts", "event_id"], "ts", "amount", 4)


@query("latest_per_key", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def latest_per_key(t):
    rows = t.events.select("user_id", "event_id", "ts", "event_type", "value")
    return windows.latest_per_key(rows, "user_id", ["ts", "event_id"])


@query("newest_snapshot", """
SELECT user_id, event_id, CAST(ts AS DATE) AS day, event_type FROM (
  SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS newest FROM events) WHERE CAST(ts AS DATE) = newest
""")
def newest_snapshot(t):
    rows = t.events.select("user_id", "event_id", F.to_date("ts").alias("day"), "event_type")
    return windows.newest_snapshot(rows, "user_id", "day")


@query("latest_snapshot", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)
""")
def latest_snapshot(t):
    return topk.latest_snapshot(t.events.select("event_id", "user_id", F.to_date("ts").alias("day")), "day")


@query("rank_ties", """
WITH x AS (SELECT n_nationkey, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT *, rank() OVER (ORDER BY customers DESC) AS nation_rank,
  row_number() OVER (ORDER BY customers DESC, n_nationkey) AS nation_order FROM x
""")
def rank_ties(t):
    counts = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    rows = joins.complete_left(t.nation.select("n_nationkey", "n_name"), counts, "n_nationkey", ["customers"])
    rows = windows.rank_summary(rows, "customers", "nation_rank")
    return windows.rank_summary(rows, "customers", "nation_order", ["n_nationkey"])


@query("rank_whole_table", """
SELECT c_custkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS balance, rank() OVER (ORDER BY CAST(floor(c_acctbal / 100) AS BIGINT) DESC) AS balance_rank,
  row_number() OVER (ORDER BY CAST(floor(c_acctbal / 100) AS BIGINT) DESC, c_custkey) AS balance_order
FROM customer
""")
def rank_whole_table(t):
    rows = t.customer.select("c_custkey", F.floor(F.col("c_acctbal") / 100).alias("balance"))
    rows = windows.global_rank(rows, "balance", "balance_rank")
    return windows.global_rank(rows, "balance", "balance_order", ties=["c_custkey"])


@query("max_drawdown", """
WITH x AS (
  SELECT user_id, ts, event_id, CAST(round(value * 100) AS BIGINT) - 4000 AS profit FROM events
), r AS (
  SELECT *, CAST(sum(profit) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM x
), p AS (
  SELECT *, greatest(0, max(run) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS peak FROM r
)
SELECT user_id, count(*) AS row_count, CAST(sum(profit) AS BIGINT) AS total, CAST(max(greatest(peak - run, 0)) AS BIGINT) AS max_drawdown
FROM p GROUP BY user_id
""")
def max_drawdown(t):
    rows = t.events.select("user_id", "ts", "event_id", (cents("value") - 4000).alias("profit"))
    out = windows.max_drawdown(rows, "user_id", ["ts", "event_id"], "profit")
    return out.withColumns({c: F.col(c).cast("long") for c in ("total", "max_drawdown")})


def _user_days(t):
    value = F.col("value") / 10
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("v"), F.sum(value * value).alias("v2")
    )


_DECAY_SQL = """
WITH d AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value / 10) AS v, sum(value * value / 100) AS v2 FROM events GROUP BY ALL
), e AS (
  SELECT a.user_id, a.day, coalesce(sum(b.n * pow(2, -(a.day - b.day) / 7.0)), 0) AS pn,
    coalesce(sum(b.v * pow(2, -(a.day - b.day) / 7.0)), 0) AS pv, coalesce(sum(b.v2 * pow(2, -(a.day - b.day) / 7.0)), 0) AS pv2
  FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND b.day < a.day GROUP BY ALL
)"""


@query("decayed_prior", _DECAY_SQL + """
SELECT user_id, day, round(pn, 6) AS prior_n, round(pv, 6) AS prior_v FROM e
""")
def decayed_prior(t):
    out = windows.decayed_prior(_user_days(t), "user_id", "day", 7.0, ["n", "v"])
    return out.select("user_id", "day", rounded("prior_n").alias("prior_n"), rounded("prior_v").alias("prior_v"))


@query("decayed_prior_long", """
WITH d AS (
  SELECT nullif(o_orderpriority, '5-LOW') AS priority, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL
)
SELECT a.priority, a.day, round(coalesce(sum(b.v * pow(2, -(a.day - b.day)::DOUBLE)), 0), 4) AS prior_v
FROM d a LEFT JOIN d b ON b.priority IS NOT DISTINCT FROM a.priority AND b.day < a.day GROUP BY a.priority, a.day
""")
def decayed_prior_long(t):
    days = t.orders.groupBy(
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"), F.to_date("o_orderdate").alias("day")
    ).agg(F.sum("o_totalprice").alias("v"))
    out = windows.decayed_prior(days, "priority", "day", 1.0, ["v"])
    return out.select("priority", "day", rounded("prior_v", 4).alias("prior_v"))


@query("shrink_rating", _DECAY_SQL + """, l AS (
  SELECT day, sum(n) AS n, sum(v) AS v, sum(v2) AS v2 FROM d GROUP BY day
), p AS (
  SELECT a.day, coalesce(sum(b.n * pow(2, -(a.day - b.day) / 7.0)), 0) AS ln, coalesce(sum(b.v * pow(2, -(a.day - b.day) / 7.0)), 0) AS lv,
    coalesce(sum(b.v2 * pow(2, -(a.day - b.day) / 7.0)), 0) AS lv2
  FROM l a LEFT JOIN l b ON b.day < a.day GROUP BY ALL
), m AS (
  SELECT day, coalesce(lv / nullif(ln, 0), 0) AS mean,
    greatest(coalesce(sqrt(greatest(lv2 / nullif(ln, 0) - (lv / nullif(ln, 0)) * (lv / nullif(ln, 0)), 0)), 0.05), 0.05) AS sd FROM p
), s AS (
  SELECT user_id, day, mean, sd, pn, (pn * coalesce(pv / nullif(pn, 0), mean) + 20 * mean) / (pn + 20) AS shrunk FROM e JOIN m USING (day)
)
SELECT user_id, day, round(shrunk, 6) AS shrunk_mean, round(100 + 15 * (shrunk - mean) / sd, 5) AS rating_index,
  round(15 / sqrt(greatest(pn + 20, 1)), 6) AS rating_standard_error FROM s
""")
def shrink_rating(t):
    days = _user_days(t)
    sums = ["n", "v", "v2"]
    entity = windows.decayed_prior(days, "user_id", "day", 7.0, sums)
    pooled_days = days.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums])
    pooled = windows.decayed_prior(pooled_days, [], "day", 7.0, sums).select(
        "day", *[F.col(f"prior_{c}").alias(f"pooled_prior_{c}") for c in sums]
    )
    out = windows.shrink_rating(entity, pooled, "day", "prior_n", "prior_v", "prior_v2", 20.0)
    return out.select(
        "user_id", "day", rounded("shrunk_mean").alias("shrunk_mean"), rounded("rating_index", 5).alias("rating_index"),
        rounded("rating_standard_error").alias("rating_standard_error"),
    )


@query("trend_class", """
WITH y AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total
  FROM orders GROUP BY ALL
), p AS (
  SELECT *, lag(total) OVER w AS previous_total, lag(order_year) OVER w AS previous_year FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY order_year)
)
SELECT o_custkey, order_year, total, previous_total,
  CASE WHEN previous_total IS NULL THEN 'NEW' WHEN previous_year <> order_year - 1 THEN 'MODEL_CHANGED'
       WHEN abs(total - previous_total) < 5000000 THEN 'UNCHANGED' WHEN total > previous_total THEN 'INCREASE' ELSE 'DECREASE' END AS trend
FROM p
""")
def trend_class(t):
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("order_year")).agg(
        F.sum(cents("o_totalprice")).alias("total")
    )
    # One row per customer and year, so a customer's group is a handful of years.
    along = F.lag(F.struct("total", "order_year")).over(
        windows.Window.partitionBy("o_custkey").orderBy("order_year")
    )
    rows = yearly.withColumn("__p", along)
    return rows.select(
        "o_custkey", "order_year", "total", F.col("__p.total").alias("previous_total"),
        windows.trend_class(
            F.col("total"), F.col("__p.total"), F.col("__p.order_year") == F.col("order_year") - 1, 5_000_000
        ).alias("trend"),
    )


@query("contributions_long", """
WITH s AS (
  SELECT s_suppkey, s_acctbal, s_nationkey, coalesce(n, 0) AS parts FROM supplier
  LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey
), c AS (
  SELECT s_suppkey, 'acctbal' AS feature_name, s_acctbal * 0.0005 AS contribution FROM s UNION ALL
  SELECT s_suppkey, 'nation', (s_nationkey - 12) * 0.03 FROM s UNION ALL
  SELECT s_suppkey, 'parts', parts * -0.01 FROM s
)
SELECT s_suppkey, feature_name, round(contribution, 9) AS contribution,
  row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(contribution) DESC, feature_name) AS importance_rank FROM c
""")
def contributions_long(t):
    parts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.countDistinct("l_partkey").alias("parts"))
    rows = joins.complete_left(t.supplier, parts, "s_suppkey", ["parts"])
    out = windows.contributions_long(rows, ["s_suppkey"], {
        "acctbal": F.col("s_acctbal") * 0.0005,
        "nation": (F.col("s_nationkey") - 12) * F.lit(0.03),
        "parts": F.col("parts") * F.lit(-0.01),
    })
    return out.withColumn("contribution", rounded("contribution", 9))


@query("asof_strict", """
WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT user_id, event_id, ts, view_event_id, view_ts, view_value FROM (
  SELECT p.user_id, p.event_id, p.ts, v.event_id AS view_event_id, v.ts AS view_ts, v.value AS view_value,
    row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC NULLS LAST) AS rn
  FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts < p.ts) WHERE rn = 1
""")
def asof_strict(t):
    events = t.events
    purchases = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("view_event_id"), F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    return asof.asof_join(
        purchases, views, "user_id", "ts", "view_ts", ["view_event_id"], ["view_event_id", "view_ts", "view_value"]
    )


def _with_nulls(t):
    """Events under a coarse key; every 5th key and every 11th time is null, and whole seconds make ties."""
    return t.events.select(
        F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 50).alias("key"), "event_id", "event_type", "value",
        F.when(F.col("event_id") % 11 != 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("ts"),
    )


_NULLS_SQL = """
WITH n AS (
  SELECT CASE WHEN user_id % 5 <> 0 THEN user_id % 50 END AS key, event_id, event_type, value,
    CASE WHEN event_id % 11 <> 0 THEN CAST(date_trunc('hour', ts) AS TIMESTAMP) END AS ts FROM events
), v AS (SELECT * FROM n WHERE event_type = 'view'), p AS (SELECT * FROM n WHERE event_type = 'purchase')
"""


@query("asof_nulls", _NULLS_SQL + """, r AS (
  SELECT strict, p.key, p.event_id, p.ts, v.event_id AS view_event_id,
    row_number() OVER (PARTITION BY strict, p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC NULLS LAST) AS rn
  FROM (VALUES (true), (false)) AS m(strict) CROSS JOIN p
  LEFT JOIN v ON v.key = p.key AND (v.ts < p.ts OR (NOT strict AND v.ts = p.ts)))
SELECT strict, key, event_id, ts, view_event_id FROM r WHERE rn = 1
""")
def asof_nulls(t):
    events = _with_nulls(t)
    purchases = events.where("event_type = 'purchase'").select("key", "event_id", "ts")
    views = events.where("event_type = 'view'").select("key", F.col("event_id").alias("view_event_id"), F.col("ts").alias("view_ts"))
    parts = [
        asof.asof_join(purchases, views, "key", "ts", "view_ts", ["view_event_id"], ["view_event_id"], strict=strict)
        .withColumn("strict", F.lit(strict)) for strict in (True, False)
    ]
    return parts[0].unionByName(parts[1])


@query("latest_before_nulls", _NULLS_SQL + """, r AS (
  SELECT p.key, p.event_id, v.event_id AS view_event_id,
    row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC NULLS LAST) AS rn
  FROM p LEFT JOIN v ON v.key = p.key AND v.ts > p.ts AND v.ts < p.ts + INTERVAL 3 DAYS)
SELECT key, event_id, view_event_id FROM r WHERE rn = 1
""")
def latest_before_nulls(t):
    events = _with_nulls(t)
    entry = events.where("event_type = 'purchase'").select("key", "event_id", "ts", F.expr("ts + INTERVAL 3 DAYS").alias("until"))
    views = events.where("event_type = 'view'").select("key", F.col("event_id").alias("view_event_id"), F.col("ts").alias("view_ts"))
    out = asof.latest_before(entry, views, "key", "ts", "until", "view_ts", ["view_event_id"], ["view_event_id"])
    return out.select("key", "event_id", "view_event_id")


@query("latest_before_deadline", """
WITH s AS (SELECT * FROM events WHERE event_type = 'signup'), c AS (SELECT * FROM events WHERE event_type = 'click')
SELECT user_id, event_id, click_event_id, click_ts, movement,
  CASE WHEN movement > 0 THEN 'UP' WHEN movement < 0 THEN 'DOWN' WHEN movement = 0 THEN 'FLAT' END AS direction,
  click_event_id IS NOT NULL AS is_closing, minutes_after
FROM (
  SELECT s.user_id, s.event_id, c.event_id AS click_event_id, c.ts AS click_ts,
    CAST(round(c.value * 100) AS BIGINT) - CAST(round(s.value * 100) AS BIGINT) AS movement,
    CAST(date_diff('minute', s.ts, c.ts) AS BIGINT) AS minutes_after,
    row_number() OVER (PARTITION BY s.event_id ORDER BY c.ts DESC NULLS LAST, c.event_id DESC NULLS LAST) AS rn
  FROM s LEFT JOIN c ON c.user_id = s.user_id AND c.ts > s.ts AND c.ts < s.ts + INTERVAL 1 DAY) WHERE rn = 1
""")
def latest_before_deadline(t):
    from fieldglass.functions.scalars import minute_difference

    events = t.events.withColumn("amount", cents("value"))
    entry = events.where("event_type = 'signup'").select(
        "user_id", "event_id", "ts", "amount", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("deadline")
    )
    clicks = events.where("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_event_id"), F.col("ts").alias("click_ts"), F.col("amount").alias("click_amount")
    )
    found = asof.latest_before(
        entry, clicks, "user_id", "ts", "deadline", "click_ts", ["click_event_id"],
        ["click_event_id", "click_ts", "click_amount"],
    )
    movement = F.col("click_amount") - F.col("amount")
    return found.select(
        "user_id", "event_id", "click_event_id", "click_ts", movement.alias("movement"),
        F.when(movement > 0, "UP").when(movement < 0, "DOWN").when(movement == 0, "FLAT").alias("direction"),
        F.col("click_event_id").isNotNull().alias("is_closing"),
        minute_difference(F.col("ts"), F.col("click_ts")).alias("minutes_after"),
    )


@query("snapshot_asof", """
WITH d AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
m AS (
  SELECT a.o_orderkey, a.o_custkey, a.day, max(b.day) AS snapshot_day FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND b.day < a.day GROUP BY ALL
)
SELECT m.o_orderkey, m.o_custkey, m.day, d.day AS snapshot_day, d.o_orderkey AS snapshot_orderkey
FROM m JOIN d ON d.o_custkey = m.o_custkey AND d.day = m.snapshot_day
""")
def snapshot_asof(t):
    spine = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    snaps = spine.select("o_custkey", F.col("day").alias("snapshot_day"), F.col("o_orderkey").alias("snapshot_orderkey"))
    return asof.snapshot_asof(spine, snaps, "o_custkey", "day", "snapshot_day", strict=True)


@query("trailing_n_keyed", """
WITH h AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS amount,
    row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), ts, event_id) AS rn FROM events
), k AS (
  SELECT user_id, day, min(rn) - 1 AS before FROM h GROUP BY ALL
)
SELECT k.user_id, k.day, count(h.rn) AS count_last_4, CAST(sum(amount) AS BIGINT) / nullif(count(h.rn), 0) AS mean_last_4,
  round(stddev_samp(amount), 1) AS sd_last_4
FROM k LEFT JOIN h ON h.user_id = k.user_id AND h.rn <= k.before AND h.rn > k.before - 4 GROUP BY ALL
""")
def trailing_n_keyed(t):
    history = t.events.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", cents("value").alias("amount"))
    targets = history.select("user_id", "day").distinct()
    out = asof.trailing_n(targets, history, "day", ["ts", "event_id"], "amount", [4], by="user_id")
    return out.withColumn("sd_last_4", rounded("sd_last_4", 1))


@query("trailing_n", """
WITH h AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS price,
    row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
), k AS (SELECT day, min(rn) - 1 AS before FROM h GROUP BY day)
SELECT k.day,
  count(*) FILTER (WHERE h.rn > k.before - 32) AS count_last_32,
  CAST(sum(price) FILTER (WHERE h.rn > k.before - 32) AS BIGINT) / nullif(count(*) FILTER (WHERE h.rn > k.before - 32), 0) AS mean_last_32,
  round(stddev_samp(price) FILTER (WHERE h.rn > k.before - 32), 1) AS sd_last_32,
  count(*) FILTER (WHERE h.rn > k.before - 64) AS count_last_64,
  CAST(sum(price) FILTER (WHERE h.rn > k.before - 64) AS BIGINT) / nullif(count(*) FILTER (WHERE h.rn > k.before - 64), 0) AS mean_last_64,
  round(stddev_samp(price) FILTER (WHERE h.rn > k.before - 64), 1) AS sd_last_64,
  count(*) FILTER (WHERE h.rn > k.before - 128) AS count_last_128,
  CAST(sum(price) FILTER (WHERE h.rn > k.before - 128) AS BIGINT) / nullif(count(*) FILTER (WHERE h.rn > k.before - 128), 0) AS mean_last_128,
  round(stddev_samp(price) FILTER (WHERE h.rn > k.before - 128), 1) AS sd_last_128
FROM k LEFT JOIN h ON h.rn <= k.before AND h.rn > k.before - 128 GROUP BY k.day, k.before
""")
def trailing_n(t):
    history = t.orders.select(F.to_date("o_orderdate").alias("day"), "o_orderkey", cents("o_totalprice").alias("price"))
    targets = history.select("day").distinct()
    out = asof.trailing_n(targets, history, "day", ["o_orderkey"], "price", [32, 64, 128])
    return out.withColumns({c: rounded(c, 1) for c in ("sd_last_32", "sd_last_64", "sd_last_128")})
