"""Contract queries over ratings, learning, back-tests and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, bootstrap, isotonic as steps, learn, ratings, reshape, skew, trees, windows
from fieldglass.plans.contract_aggregates import _SCORED, _losses
from fieldglass.plans.registry import cents, query, rounded
from fieldglass.session import land


def _matches(t, part: str):
    """Nation against nation per market segment and month (or year).

    A nation's score is the value of its customers' orders in the segment.  The
    pairing rotates with the round and uses each nation at most once.
    """
    round_no = (F.year("o_orderdate") * 12 + F.month("o_orderdate") if part == "month" else F.year("o_orderdate")).cast("long")
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), round_no.alias("round"), cents("o_totalprice").alias("v"))
    per_customer = orders.groupBy("c_custkey", "round").agg(F.sum("v").alias("v"))
    customers = t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("long").alias("nation"))
    totals = per_customer.join(customers, "c_custkey").groupBy("c_mktsegment", "round", "nation").agg(F.sum("v").alias("v"))
    slot = (F.col("nation") + F.col("round") * 5) % 25
    pairs = totals.where(slot < 24).withColumn("pair", slot % 12).withColumn("is_home", slot < 12)
    sides = pairs.groupBy("c_mktsegment", "round", "pair").agg(
        F.max(F.when(F.col("is_home"), F.col("nation"))).alias("home_team"), F.max(F.when(~F.col("is_home"), F.col("nation"))).alias("away_team"),
        F.max(F.when(F.col("is_home"), F.col("v"))).alias("home_score"), F.max(F.when(~F.col("is_home"), F.col("v"))).alias("away_score"),
    ).where("home_team IS NOT NULL AND away_team IS NOT NULL")
    season = F.floor((F.col("round") - 1) / 12) if part == "month" else F.floor(F.col("round") / 2)
    return sides.select(
        F.concat_ws("_", "c_mktsegment", F.col("round").cast("string"), F.col("pair").cast("string")).alias("game_id"),
        "c_mktsegment", "round", "pair", season.alias("season"), "home_team", "away_team", "home_score", "away_score",
        (F.col("round") % 6 == 0).alias("is_neutral"),
    )


_ONE_SETTING = "SELECT 0 AS pid, 20.0::DOUBLE AS k, 48.0::DOUBLE AS adv, 0.6::DOUBLE AS ret"


def _ratings_cte(part: str, settings: str = _ONE_SETTING) -> str:
    """The rating recursion in SQL, one step per round, for each parameter row.

    ``m`` are the matches, ``st`` the rating of every nation after each step.
    """
    number = "year(o_orderdate) * 12 + month(o_orderdate)" if part == "month" else "year(o_orderdate)"
    season = "(h.round - 1) // 12" if part == "month" else "h.round // 2"
    regressed = "CASE WHEN r.before IS NOT NULL AND r.before <> r.season THEN 1500 + ({0}.rating - 1500) * g.ret ELSE {0}.rating END"
    return f"""
WITH RECURSIVE g AS ({settings}), v AS (
  SELECT c_mktsegment, CAST({number} AS BIGINT) AS round, CAST(c_nationkey AS BIGINT) AS nation, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
), s AS (SELECT *, (nation + round * 5) % 25 AS slot FROM v), m AS (
  SELECT h.c_mktsegment, h.round, h.slot AS pair, {season} AS season, h.nation AS home, a.nation AS away, h.round % 6 = 0 AS neutral,
    CASE WHEN h.v > a.v THEN 1.0::DOUBLE WHEN h.v < a.v THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score
  FROM s h JOIN s a ON h.c_mktsegment = a.c_mktsegment AND h.round = a.round AND a.slot = h.slot + 12 WHERE h.slot < 12
), rounds AS (SELECT c_mktsegment, round, season, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round) AS step, lag(season) OVER (PARTITION BY c_mktsegment ORDER BY round) AS before
  FROM (SELECT DISTINCT c_mktsegment, round, season FROM m)
), side AS (
  SELECT c_mktsegment, round, home AS nation, true AS is_home, score FROM m UNION ALL SELECT c_mktsegment, round, away, false, score FROM m
), st AS (
  SELECT DISTINCT g.pid, c_mktsegment, 0::BIGINT AS step, nation, 1500.0::DOUBLE AS rating FROM v, g
  UNION ALL
  SELECT n.pid, n.c_mktsegment, n.step, n.nation, n.pre + CASE WHEN d.nation IS NULL THEN 0 WHEN d.is_home THEN n.k * (d.score - p.home_p) ELSE -n.k * (d.score - p.home_p) END
  FROM (
    SELECT st.pid, g.k, st.c_mktsegment, r.step, st.nation, r.round, {regressed.format("st")} AS pre
    FROM st JOIN rounds r ON r.c_mktsegment = st.c_mktsegment AND r.step = st.step + 1 JOIN g ON g.pid = st.pid
  ) n LEFT JOIN side d ON d.c_mktsegment = n.c_mktsegment AND d.round = n.round AND d.nation = n.nation
  LEFT JOIN (
    SELECT g.pid, m.c_mktsegment, m.round, m.home, m.away,
      1 / (1 + pow(10, (({regressed.format("b")}) - (({regressed.format("a")}) + CASE WHEN m.neutral THEN 0 ELSE g.adv END)) / 400)) AS home_p
    FROM m JOIN rounds r ON r.c_mktsegment = m.c_mktsegment AND r.round = m.round
    JOIN st a ON a.c_mktsegment = m.c_mktsegment AND a.nation = m.home AND a.step = r.step - 1
    JOIN st b ON b.c_mktsegment = m.c_mktsegment AND b.nation = m.away AND b.step = r.step - 1 AND b.pid = a.pid JOIN g ON g.pid = a.pid
  ) p ON p.pid = n.pid AND p.c_mktsegment = n.c_mktsegment AND p.round = n.round AND n.nation IN (p.home, p.away)
)"""


_POST = """
SELECT m.c_mktsegment, m.round, m.home AS home_team, m.away AS away_team, round(h.rating, 6) AS home_rating_post, round(a.rating, 6) AS away_rating_post
FROM m JOIN rounds r ON r.c_mktsegment = m.c_mktsegment AND r.round = m.round
JOIN st h ON h.c_mktsegment = m.c_mktsegment AND h.nation = m.home AND h.step = r.step JOIN st a ON a.c_mktsegment = m.c_mktsegment AND a.nation = m.away AND a.step = r.step
"""


_CFG = ratings.RatingConfig(k=20.0, advantage=48.0, retention=0.60)
_RATED = ["c_mktsegment", "round", "home_team", "away_team"]


def _rated(frame):
    return frame.select(*_RATED, rounded("home_rating_post").alias("home_rating_post"), rounded("away_rating_post").alias("away_rating_post"))


@query("pairwise_ratings", _ratings_cte("month") + _POST)
def pairwise_ratings(t):
    return _rated(ratings.pairwise_ratings(_matches(t, "month"), "c_mktsegment", ["round", "pair"], cfg=_CFG, keep=["round"]))


@query("ratings_by_round", _ratings_cte("year") + _POST)
def ratings_by_round(t):
    return _rated(ratings.ratings_by_round(_matches(t, "year"), "c_mktsegment", "round", cfg=_CFG))




@query("tune_ratings", _ratings_cte("month", """
  SELECT row_number() OVER () AS pid, k, adv, ret FROM (SELECT 15.0 + 5 * unnest(range(8))::DOUBLE AS k), (SELECT 35.0 + 5 * unnest(range(5))::DOUBLE AS adv), (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS ret)
""") + """, f AS (
  SELECT g.k, g.adv, g.ret, CASE WHEN m.season <= 1999 THEN 'DEVELOPMENT' ELSE 'VALIDATION' END AS period, m.score AS y,
    1 / (1 + pow(10, ((CASE WHEN r.before <> r.season THEN 1500 + (b.rating - 1500) * g.ret ELSE b.rating END)
      - ((CASE WHEN r.before <> r.season THEN 1500 + (a.rating - 1500) * g.ret ELSE a.rating END) + CASE WHEN m.neutral THEN 0 ELSE g.adv END)) / 400)) AS p
  FROM m JOIN rounds r ON r.c_mktsegment = m.c_mktsegment AND r.round = m.round
  JOIN st a ON a.c_mktsegment = m.c_mktsegment AND a.nation = m.home AND a.step = r.step - 1
  JOIN st b ON b.c_mktsegment = m.c_mktsegment AND b.nation = m.away AND b.step = r.step - 1 AND b.pid = a.pid JOIN g ON g.pid = a.pid WHERE m.score <> 0.5
)
SELECT k, adv AS advantage, ret AS retention, period, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss,
  round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM f GROUP BY ALL
""")
def tune_ratings(t):
    split = F.when(F.col("season") <= 1999, "DEVELOPMENT").otherwise("VALIDATION")
    out = ratings.tune_ratings(_matches(t, "month"), "c_mktsegment", ["round", "pair"], ratings.rating_grid(**ratings.GRID), split)
    return out.withColumns({c: rounded(c) for c in ("brier", "log_loss", "accuracy")})


@query("current_ratings", _ratings_cte("month") + """, p AS (
  SELECT c_mktsegment, home AS nation, round, season FROM m UNION ALL SELECT c_mktsegment, away, round, season FROM m
), c AS (SELECT c_mktsegment, nation, max(round) AS round, count(*) AS games_played, max(season) AS last_season FROM p GROUP BY ALL)
SELECT c.c_mktsegment, c.nation AS entity, round(st.rating, 6) AS rating, games_played, last_season, row_number() OVER (PARTITION BY c.c_mktsegment ORDER BY st.rating DESC, c.nation) AS rating_rank
FROM c JOIN rounds r ON r.c_mktsegment = c.c_mktsegment AND r.round = c.round JOIN st ON st.c_mktsegment = c.c_mktsegment AND st.nation = c.nation AND st.step = r.step
""")
def current_ratings(t):
    history = ratings.pairwise_ratings(_matches(t, "month"), "c_mktsegment", ["round", "pair"], cfg=_CFG, keep=["round", "pair"])
    current = ratings.current_ratings(history, "c_mktsegment", ["round", "pair"])
    # Ranked inside a league of at most 25 nations.
    order = windows.Window.partitionBy("c_mktsegment").orderBy(F.desc("rating"), "entity")
    return current.withColumn("rating_rank", F.row_number().over(order).cast("long")).withColumn("rating", rounded("rating"))


_DRAWS = " + ".join(f"CASE WHEN u >= {x} THEN 1 ELSE 0 END" for x in bootstrap.poisson_thresholds())


@query("bootstrap_mean", _SCORED + f""", b AS (
  SELECT ('0x' || md5(CAST(doc_id AS VARCHAR))[1:8])::BIGINT % {bootstrap.BLOCKS} AS b, count(*) AS n,
    sum(CAST(round(((p_b - y) * (p_b - y) - (p_a - y) * (p_a - y)) * 1e9) AS BIGINT)) AS s FROM s GROUP BY 1
), u AS (SELECT n, s, r, ('0x' || md5(b || ':' || r || ':7')[1:8])::BIGINT AS u FROM b, unnest(range(10000)) AS q(r)),
m AS (SELECT r, CAST(sum(w * s) AS DOUBLE) / sum(w * n) / 1e9 AS m FROM (SELECT n, s, r, {_DRAWS} AS w FROM u) GROUP BY r)
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM b) AS n, round((SELECT CAST(sum(s) AS DOUBLE) / sum(n) / 1e9 FROM b), 6) AS mean,
  round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m
""")
def bootstrap_mean(t):
    pairs = aggregates.paired_losses(_losses(t), ["doc_id"], "candidate", "loss", "length", "step", ["source"])
    out = bootstrap.bootstrap_mean(pairs, [], "loss_delta", "doc_id", replicates=10_000, seed=7)
    return out.withColumns({c: rounded(c) for c in ("mean", "ci_low", "ci_high")})


def _priced(t):
    price = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    lines = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity", "l_extendedprice", "l_discount", F.year("l_shipdate").cast("long").alias("ship_year"))
    return skew.join_lookup(lines, price, "l_partkey", "inner")


_RIDGE = """
WITH d AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity AS x1, p_retailprice AS x2, l_extendedprice AS y, CAST(year(l_shipdate) AS BIGINT) AS ship_year
  FROM lineitem JOIN part ON p_partkey = l_partkey
), f AS (SELECT DISTINCT ship_year AS fold FROM d WHERE ship_year > (SELECT min(ship_year) FROM d)), s AS (
  SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
  FROM d JOIN f ON ship_year < fold GROUP BY ALL
), a AS (SELECT unnest([0.0, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS setting), w AS (
  SELECT fold, setting, my, m1, m2, s1, s2,
    ((n * c1y / s1) * (n + setting) - (n * c12 / (s1 * s2)) * (n * c2y / s2)) / ((n + setting) * (n + setting) - pow(n * c12 / (s1 * s2), 2)) AS w1,
    ((n * c2y / s2) * (n + setting) - (n * c12 / (s1 * s2)) * (n * c1y / s1)) / ((n + setting) * (n + setting) - pow(n * c12 / (s1 * s2), 2)) AS w2 FROM s, a
), p AS (
  SELECT d.*, w.fold, w.setting, my, my + w1 * (x1 - m1) / s1 + w2 * (x2 - m2) / s2 AS prediction FROM d JOIN w ON d.ship_year = w.fold
)"""

_TWO = [learn.Candidate("two", ("l_quantity", "p_retailprice"))]
_ALPHAS = (0.0, 1.0, 10.0, 100.0, 1000.0)


def _years(rows) -> list[int]:
    """Every year of the rows that has an earlier one."""
    return sorted(r[0] for r in rows.select("ship_year").distinct().collect())[1:]


@query("backtest_ridge", _RIDGE + """
SELECT 'two' AS candidate, setting, fold, count(*) AS n, round(avg(abs(prediction - y)), 3) AS mae, round(sqrt(avg((prediction - y) * (prediction - y))), 3) AS rmse, round(avg(prediction - y), 3) AS bias,
  round(1 - avg((prediction - y) * (prediction - y)) / var_pop(y), 6) AS r2, round(avg(abs(my - y)), 3) AS baseline_mae FROM p GROUP BY ALL
""")
def backtest_ridge(t):
    rows = _priced(t)
    fits = learn.fit_ridge(rows, "ship_year", _years(rows), _TWO, _ALPHAS, "l_extendedprice")
    out = learn.backtest_ridge(rows, fits, "ship_year", "l_extendedprice")
    return out.withColumns({c: rounded(c, 3) for c in ("mae", "rmse", "bias", "baseline_mae")} | {"r2": rounded("r2")})


@query("oof_residuals", _RIDGE + """
SELECT l_orderkey, l_linenumber, l_partkey, fold, setting, round(prediction, 3) AS prediction, round(y - prediction, 3) AS residual FROM p WHERE setting = 100
""")
def oof_residuals(t):
    rows = _priced(t)
    fits = learn.fit_ridge(rows, "ship_year", _years(rows), _TWO, [100.0], "l_extendedprice")
    out = learn.oof_residuals(rows, fits, "ship_year", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "fold", "setting", rounded("prediction", 3).alias("prediction"), rounded("residual", 3).alias("residual"))


@query("ridge_coefficients", _RIDGE + """
SELECT 'two' AS candidate, setting, fold, 'l_quantity' AS feature_name, round(w1, 4) AS coefficient, round(m1, 6) AS train_mean, round(s1, 6) AS train_sd FROM w
UNION ALL SELECT 'two', setting, fold, 'p_retailprice', round(w2, 4), round(m2, 6), round(s2, 6) FROM w
""")
def ridge_coefficients(t):
    rows = _priced(t)
    fits = learn.fit_ridge(rows, "ship_year", _years(rows), _TWO, _ALPHAS, "l_extendedprice")
    out = learn.coefficients(t.spark, fits)
    return out.withColumns({"coefficient": rounded("coefficient", 4), "train_mean": rounded("train_mean"), "train_sd": rounded("train_sd")})


def _labelled(t):
    """Documents with labels; the source number plays the part of the season."""
    words = F.size(F.split("text", r"\\s+"))
    docs = t.documents.select(
        "doc_id", F.regexp_extract("source", r"([0-9]+)$", 1).cast("long").alias("period"),
        F.log1p("n_chars").alias("log_chars"), (F.length(F.regexp_replace("text", "[^0-9]+", "")) / F.length("text")).alias("digit_share"),
        F.when(F.col("lang") == "en", F.col("n_chars") / words).alias("word_length"), (F.col("lang") == "en").cast("double").alias("is_english"),
    )
    rows = docs.join(t.labels.select("doc_id", "quality"), "doc_id")
    # Folds, fits and predictions read the rows again, but not the texts.
    return rows if skew.is_small(rows) else land(rows, "labelled")


_FEATURES = ("log_chars", "digit_share", "word_length", "is_english")
#: All penalties of the reference's grid.
_CS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)


def _all_folds(rows) -> list[int]:
    """Every period of the labelled rows that has an earlier one."""
    found = rows.where("period is not null and quality is not null").select("period").distinct().collect()
    return sorted(r["period"] for r in found)[1:]


_NEWTON = """
WITH RECURSIVE d AS (
  SELECT d.doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS period, ln(1 + n_chars) AS x, CAST(quality AS DOUBLE) AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL
), f AS (SELECT DISTINCT period AS fold FROM d WHERE period > (SELECT min(period) FROM d)), c AS (SELECT unnest([0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0])::DOUBLE AS c),
s AS (SELECT fold, avg(x) AS m, stddev_pop(x) AS sd FROM d JOIN f ON d.period < f.fold GROUP BY fold),
z AS (SELECT s.fold, c.c, (d.x - s.m) / s.sd AS z, d.y FROM d JOIN s ON d.period < s.fold, c),
b AS (
  SELECT fold, c, 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1 FROM f, c
  UNION ALL
  SELECT fold, c, step + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT b.fold, b.c, b.step, b.b0, b.b1, b.c * sum(p - y) AS g0, b.c * sum((p - y) * z) + b.b1 AS g1,
      b.c * sum(p * (1 - p)) AS h00, b.c * sum(p * (1 - p) * z) AS h01, b.c * sum(p * (1 - p) * z * z) + 1 AS h11
    FROM (SELECT b.*, z.z, z.y, 1 / (1 + exp(-(b.b0 + b.b1 * z.z))) AS p FROM b JOIN z ON z.fold = b.fold AND z.c = b.c WHERE b.step < 12) b GROUP BY b.fold, b.c, b.step, b.b0, b.b1
  )
)"""


def _length_fits(t):
    rows = _labelled(t)
    return rows, learn.fit_logistic(rows, "period", _all_folds(rows), [learn.Candidate("length", ("log_chars",))], _CS, "quality")


@query("fit_logistic", _NEWTON + """
SELECT 'length' AS candidate, b.c AS setting, b.fold, 'log_chars' AS feature_name, round(b1, 6) AS coefficient, round(m, 6) AS train_mean, round(sd, 6) AS train_sd FROM b JOIN s USING (fold) WHERE step = 12
""")
def fit_logistic(t):
    out = learn.coefficients(t.spark, _length_fits(t)[1])
    return out.withColumns({c: rounded(c) for c in ("coefficient", "train_mean", "train_sd")})


@query("backtest_logistic", _NEWTON + """, p AS (
  SELECT b.c, b.fold, d.y, 1 / (1 + exp(-(b0 + b1 * (d.x - m) / sd))) AS p FROM b JOIN s USING (fold) JOIN d ON d.period = b.fold WHERE step = 12
)
SELECT 'length' AS candidate, c AS setting, fold, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier,
  round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss,
  round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM p GROUP BY ALL
""")
def backtest_logistic(t):
    rows, fits = _length_fits(t)
    out = learn.backtest_logistic(rows, fits, "period", "quality")
    return out.withColumns({c: rounded(c) for c in ("brier", "log_loss", "accuracy")})


@query("logistic_grid")
def logistic_grid(t):
    rows = _labelled(t)
    candidates = learn.ablation(_FEATURES)
    fits = learn.fit_logistic(rows, "period", _all_folds(rows), candidates, _CS, "quality")
    oof = learn.oof_predict(rows, fits, "period", ["quality"], logistic=True)
    results = aggregates.probability_metrics(oof, ["candidate", "setting", "fold"], "prediction", "quality", 1e-6)
    return learn.pooled(results, ["brier", "log_loss"])


@query("calibrators")
def calibrators(t):
    rows = _labelled(t)
    fits = learn.fit_logistic(rows, "period", _all_folds(rows), [learn.Candidate("full", _FEATURES)], [1.0], "quality")
    oof = learn.oof_predict(rows, fits, "period", ["doc_id", "quality"], logistic=True)
    apply = learn.fit_calibrators(oof, "prediction", "quality")
    return apply(oof).select("doc_id", "fold", "prediction", "sigmoid", "isotonic")


def _priced_orders(t):
    """Orders by price step: whether an order is filled."""
    return t.orders.select(F.floor(F.col("o_totalprice") / 200).cast("long").alias("x"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query("isotonic", """
WITH p AS (
  SELECT CAST(floor(o_totalprice / 200) AS BIGINT) AS x, count(*) AS w, count(*) FILTER (WHERE o_orderstatus = 'F') AS wy FROM orders GROUP BY 1
), c AS (
  SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(wy) OVER (ORDER BY x) AS cy FROM p
), m AS (
  SELECT a.i AS j, b.i AS k, min(CAST(b.cy - a.cy + a.wy AS DOUBLE) / CAST(b.cw - a.cw + a.w AS DOUBLE)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least
  FROM c a JOIN c b ON b.i >= a.i
)
SELECT x, w AS n, round(max(least), 6) AS isotonic FROM c JOIN m ON m.k = c.i AND m.j <= c.i GROUP BY x, w
""")
def isotonic(t):
    rows = _priced_orders(t)
    blocks = steps.fit_isotonic(rows, "x", "y")
    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    return steps.apply_isotonic(counts, "x", blocks).select("x", "n", rounded("isotonic").alias("isotonic"))


#: The boosted trees of the query and of its SQL: trees, depth, step, bins.
_TREES, _DEPTH, _STEP = 20, 3, 0.1
_BINS = """CAST(least(floor(ln(1 + n_chars) * 2), 31) AS BIGINT) AS b0, CAST(least(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')), 31) AS BIGINT) AS b1,
    CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 4 END::BIGINT AS b2"""


def _trees_sql(number: int, depth: int, step: float, tail: str) -> str:
    """The boosting recursion, one table per tree and level, for all folds at once."""
    parts = [f"""WITH d AS MATERIALIZED (
  SELECT d.doc_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS period, CAST(quality AS DOUBLE) AS y, {_BINS}
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL AND regexp_extract(source, '([0-9]+)$', 1) <> ''
), f AS (SELECT DISTINCT period AS fold FROM d WHERE period > (SELECT min(period) FROM d)),
r0 AS MATERIALIZED (
  SELECT d.*, fold, d.period < fold AS train, ln(avg(y) FILTER (WHERE d.period < fold) OVER w / (1 - avg(y) FILTER (WHERE d.period < fold) OVER w)) AS margin
  FROM d JOIN f ON d.period <= fold WINDOW w AS (PARTITION BY fold)
)"""]
    for n in range(number):
        parts.append(f"""g{n} AS MATERIALIZED (SELECT *, 1 / (1 + exp(-margin)) - y AS g, (1 / (1 + exp(-margin))) * (1 - 1 / (1 + exp(-margin))) AS h, 1::BIGINT AS node FROM r{n})""")
        rows = f"g{n}"
        for level in range(depth):
            name = f"{n}_{level}"
            parts.append(f"""s{name} AS MATERIALIZED (
  SELECT fold, node, feature, bin, sum(g) AS g, sum(h) AS h FROM (
    SELECT fold, node, g, h, unnest([0, 1, 2]) AS feature, unnest([b0, b1, b2]) AS bin FROM {rows} WHERE train) GROUP BY ALL
), c{name} AS MATERIALIZED (
  SELECT fold, node, feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER p AS gt, sum(h) OVER p AS ht
  FROM s{name} WINDOW w AS (PARTITION BY fold, node, feature ORDER BY bin), p AS (PARTITION BY fold, node, feature)
), q{name} AS MATERIALIZED (
  SELECT fold, node, feature, bin, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 7) AS gain FROM c{name}
  WHERE hl >= 1 AND ht - hl >= 1
), x{name} AS MATERIALIZED (
  SELECT * FROM q{name} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY fold, node ORDER BY gain DESC, feature, bin) = 1
), m{name} AS MATERIALIZED (
  SELECT r.* REPLACE (CASE WHEN x.gain IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN (CASE x.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END) > x.bin THEN 1 ELSE 0 END END AS node)
  FROM {rows} r LEFT JOIN x{name} x ON x.fold = r.fold AND x.node = r.node
)""")
            rows = f"m{name}"
        parts.append(f"""l{n} AS MATERIALIZED (SELECT fold, node, -{step} * sum(g) / (sum(h) + 1) AS leaf FROM {rows} WHERE train GROUP BY fold, node),
r{n + 1} AS MATERIALIZED (
  SELECT m.doc_id, m.period, m.y, m.b0, m.b1, m.b2, m.fold, m.train, m.margin + coalesce(l.leaf, 0) AS margin
  FROM {rows} m LEFT JOIN l{n} l ON l.fold = m.fold AND l.node = m.node
)""")
    return ",\n".join(parts) + tail


def _binned(t):
    """Labelled documents with whole-number bins of three features."""
    digits = F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))
    docs = t.documents.select(
        "doc_id", F.regexp_extract("source", r"([0-9]+)$", 1).cast("long").alias("period"),
        F.least(F.floor(F.log1p("n_chars") * 2), F.lit(31)).alias("b0"), F.least(digits, F.lit(31)).cast("long").alias("b1"),
        F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "es", 3)
        .otherwise(4).cast("long").alias("b2"),
    )
    return docs.join(t.labels.select("doc_id", "quality"), "doc_id").where("period is not null and quality is not null")


@query("tree_splits", _trees_sql(1, 2, _STEP, """
SELECT fold, 0 AS tree, node, feature, bin, round(gain, 5) AS gain FROM (SELECT * FROM x0_0 UNION ALL SELECT * FROM x0_1)
"""))
def tree_splits(t):
    fitted = trees.fit_trees(_binned(t), "period", ["b0", "b1", "b2"], "quality", number=1, depth=2, step=_STEP)
    return fitted.splits.select("fold", F.col("tree").cast("int").alias("tree"), "node", "feature", "bin", rounded("gain", 5).alias("gain"))


@query("gbt_time_cv", _trees_sql(_TREES, _DEPTH, _STEP, f"""
, p AS (SELECT fold, y, least(greatest(1 / (1 + exp(-margin)), 1e-6), 1 - 1e-6) AS p FROM r{_TREES} WHERE period = fold)
SELECT fold, count(*) AS n, round(avg((p - y) * (p - y)), 5) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 5) AS log_loss,
  round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 5) AS accuracy FROM p GROUP BY fold
"""))
def gbt_time_cv(t):
    fitted = trees.fit_trees(_binned(t), "period", ["b0", "b1", "b2"], "quality", number=_TREES, depth=_DEPTH, step=_STEP)
    out = aggregates.probability_metrics(fitted.held_out.withColumnRenamed("__y", "y"), "fold", "p", "y", 1e-6)
    return out.select("fold", "n", *[rounded(c, 5).alias(c) for c in ("brier", "log_loss", "accuracy")])


@query("evaluate_holdout")
def evaluate_holdout(t):
    rows = _labelled(t).withColumn("split", F.when(F.col("period") >= 16, "HOLDOUT").otherwise("DEVELOPMENT"))
    scored = learn.evaluate_holdout(
        rows, "split", "HOLDOUT", learn.Candidate("primary", _FEATURES), learn.Candidate("fallback", ("log_chars", "is_english")),
        "quality", ["doc_id"], c=1.0,
    )
    return aggregates.probability_metrics(scored, "prediction_mode", "prediction", "quality", 1e-6)


@query("governance_report")
def governance_report(t):
    rows = _labelled(t)
    candidates = [learn.Candidate("full", _FEATURES), learn.Candidate("length", ("log_chars",))]
    fits = learn.fit_logistic(rows, "period", _all_folds(rows), candidates, [1.0], "quality")
    results = learn.backtest_logistic(rows, fits, "period", "quality")
    oof = learn.oof_predict(rows, fits, "period", ["doc_id", "quality"], logistic=True)
    pairs = oof.groupBy("doc_id", "fold", "quality").agg(
        *(F.max(F.when(F.col("candidate") == c, F.col("prediction"))).alias(c) for c in ("full", "length"))
    )
    blended = reshape.sweep(pairs, "weight", [round(0.05 * i, 2) for i in range(21)])
    blended = blended.withColumn("p", F.col("weight") * F.col("full") + (1 - F.col("weight")) * F.col("length"))
    blend_grid = aggregates.probability_metrics(blended, "weight", "p", "quality", 1e-6)
    frames = learn.governance_report(results, "length", blend_grid, {"full": "challenger", "length": "baseline"})
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [frame.select(F.lit(name).alias("frame"), "*") for name, frame in frames.items()],
    )
