"""Contract queries over joins, unions and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, joins, reshape, skew, topk, windows
from fieldglass.plans.registry import cents, query, rounded
from fieldglass.sources import publish, scans


@query("two_sided", """
SELECT side, entity, count(*) AS line_count, CAST(sum(net) AS BIGINT) AS net_quantity FROM (
  SELECT 'BUYER' AS side, l_partkey AS entity, CAST(l_quantity AS BIGINT) AS net FROM lineitem UNION ALL
  SELECT 'SELLER', l_suppkey, -CAST(l_quantity AS BIGINT) FROM lineitem) GROUP BY ALL
""")
def two_sided(t):
    quantity = F.col("l_quantity").cast("long")
    sides = joins.two_sided(t.lineitem, [], {
        "BUYER": {"entity": F.col("l_partkey"), "net": quantity},
        "SELLER": {"entity": F.col("l_suppkey"), "net": -quantity},
    })
    return sides.groupBy("side", "entity").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum("net").alias("net_quantity")
    )


@query("mirror_join", """
WITH s AS (
  SELECT conv_id, role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL
)
SELECT a.conv_id, a.role AS side, a.turns AS own_turns, a.chars AS own_chars, b.turns AS opp_turns, b.chars AS opp_chars
FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.role <> b.role
""")
def mirror_join(t):
    return joins.mirror_sides(t.conversations, "conv_id", "role", ("user", "assistant"), {
        "turns": F.count(F.lit(1)), "chars": F.sum(F.length("text").cast("long")),
    })


@query("mirror_lines", """
WITH s AS (
  SELECT l_orderkey, l_returnflag AS f, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY ALL
)
SELECT a.l_orderkey, a.f AS side, a.opponent, a.lines, a.quantity, b.lines AS opp_lines, b.quantity AS opp_quantity
FROM (SELECT *, CASE WHEN f = 'R' THEN 'N' ELSE 'R' END AS opponent FROM s) a LEFT JOIN s b ON a.l_orderkey = b.l_orderkey AND a.opponent = b.f
""")
def mirror_lines(t):
    sides = t.lineitem.where(F.col("l_returnflag").isin("R", "N")).groupBy("l_orderkey", F.col("l_returnflag").alias("side")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    ).withColumn("opponent", F.when(F.col("side") == "R", "N").otherwise("R"))
    return joins.mirror_join(sides, "l_orderkey", "side", "opponent", {"lines": "opp_lines", "quantity": "opp_quantity"})


@query("pivot_sides", """
SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r_l_quantity, max(l_discount) FILTER (WHERE l_returnflag = 'R') AS r_l_discount,
  max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n_l_quantity, max(l_discount) FILTER (WHERE l_returnflag = 'N') AS n_l_discount
FROM lineitem GROUP BY l_orderkey
""")
def pivot_sides(t):
    return aggregates.pivot_sides(t.lineitem, "l_orderkey", "l_returnflag", ["R", "N"], ["l_quantity", "l_discount"])


@query("complete_left", """
SELECT c_custkey, coalesce(n, 0) AS order_count, coalesce(v, 0) AS order_value, n IS NOT NULL AS has_orders
FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL
) ON o_custkey = c_custkey
""")
def complete_left(t):
    counts = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum(cents("o_totalprice")).alias("order_value")
    )
    return joins.complete_left(t.customer.select("c_custkey"), counts, "c_custkey", ["order_count", "order_value"], "has_orders")


@query("star_join", """
SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS order_year, count(*) AS line_count,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL
""")
def star_join(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("revenue"))
    # Lines shrink to one row per order before they meet the dimensions.
    per_order = lines.groupBy("o_orderkey").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").cast("long").alias("order_year"))
    star = joins.join_checked(per_order, orders, "o_orderkey", "m:1")
    per_customer = star.groupBy("c_custkey", "order_year").agg(F.sum("revenue").alias("revenue"), F.sum("lines").alias("lines"))
    star = joins.join_checked(per_customer, t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    star = joins.join_checked(star, t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    return star.groupBy("n_name", "order_year").agg(
        F.sum("lines").alias("line_count"), F.sum("revenue").alias("revenue")
    )


def _nation_pairs(t):
    """Customer nation x supplier nation with line counts, reduced step by step."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    home = t.customer.select("c_custkey", F.col("c_nationkey").alias("home_id"))
    away = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("away_id"))
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    per_order = skew.join_lookup(lines, away, "l_suppkey", "inner").groupBy("l_orderkey", "away_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_order.join(orders, "l_orderkey")
    per_customer = joined.groupBy("c_custkey", "away_id").agg(F.sum("n").alias("n"))
    return per_customer.join(home, "c_custkey").groupBy("home_id", "away_id").agg(F.sum("n").alias("line_count"))


_PAIRS_SQL = """
WITH p AS (
  SELECT c_nationkey AS home_id, s_nationkey AS away_id, count(*) AS line_count
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
)"""


@query("dual_role_join", _PAIRS_SQL + """, r AS (
  SELECT c_nationkey AS k, avg(c_acctbal) AS rating, stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL
)
SELECT CAST(home_id AS BIGINT) AS home_id, CAST(away_id AS BIGINT) AS away_id, line_count, h.rating IS NOT NULL AND a.rating IS NOT NULL AS both_available,
  round(h.rating - a.rating, 4) AS rating_difference, round(sqrt(h.se * h.se + a.se * a.se), 4) AS difference_error
FROM p LEFT JOIN r h ON h.k = home_id LEFT JOIN r a ON a.k = away_id
""")
def dual_role_join(t):
    ratings = t.customer.where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.avg("c_acctbal").alias("rating"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1)))).alias("se")
    )
    out = joins.dual_role_join(_nation_pairs(t), ratings, "k", {"home": "home_id", "away": "away_id"}, ["rating", "se"], hot_rows=None)
    return out.select(
        F.col("home_id").cast("long").alias("home_id"), F.col("away_id").cast("long").alias("away_id"), "line_count", "both_available",
        rounded(F.col("home_rating") - F.col("away_rating"), 4).alias("rating_difference"),
        rounded(joins.pooled_error(F.col("home_se"), F.col("away_se")), 4).alias("difference_error"),
    )


@query("join_either", _PAIRS_SQL + """
SELECT n_name, count(*) AS pair_count, CAST(sum(line_count) AS BIGINT) AS lines
FROM p JOIN nation ON n_nationkey = home_id OR n_nationkey = away_id GROUP BY ALL
""")
def join_either(t):
    found = joins.join_either(_nation_pairs(t), ["home_id", "away_id"], t.nation, ["n_nationkey"])
    return found.groupBy("n_name").agg(F.count(F.lit(1)).alias("pair_count"), F.sum("line_count").alias("lines"))


@query("semi_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 450000)
""")
def semi_join(t):
    big = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi_join(t.customer.select("c_custkey", "c_mktsegment"), big, "c_custkey")


@query("anti_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 450000)
""")
def anti_join(t):
    big = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti_join(t.customer.select("c_custkey", "c_mktsegment"), big, "c_custkey")


@query("scalar_bounds", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, count(*) AS order_count FROM orders
WHERE o_orderdate >= (SELECT min(l_shipdate) FROM lineitem WHERE l_returnflag = 'R')
  AND o_orderdate <= (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL
""")
def scalar_bounds(t):
    returned = t.lineitem.where("l_returnflag = 'R'")
    kept = joins.within_bounds(t.orders, F.col("o_orderdate"), returned, F.min("l_shipdate"), F.max("l_shipdate"))
    return kept.groupBy(F.year("o_orderdate").cast("long").alias("order_year")).agg(F.count(F.lit(1)).alias("order_count"))


#: Page language codes and the document languages they stand for.
LANGUAGES = {"en": "en", "fr": "fr", "de": "de"}
PAGE_PATTERN = r"^https?://([^/?#]+)/([a-z]{2})/([0-9]+)"


@query("parse_url_id", r"""
WITH x AS (SELECT page_id, url, regexp_matches(url, '^https?://([^/?#]+)/([a-z]{2})/([0-9]+)') AS ok FROM pages), y AS (
  SELECT page_id, ok AS is_valid,
    CASE WHEN ok THEN regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2})/([0-9]+)', 1) END AS host,
    CASE WHEN ok THEN regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2})/([0-9]+)', 2) END AS lang,
    CASE WHEN ok THEN try_cast(regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2})/([0-9]+)', 3) AS BIGINT) END AS number
  FROM x)
SELECT *, CASE WHEN host IS NOT NULL AND lang IS NOT NULL AND number IS NOT NULL THEN host || '_' || lang || '_' || lpad(CAST(number AS VARCHAR), 6, '0') END AS canonical_id FROM y
""")
def parse_url_id(t):
    parts = scalars.parse_id(F.col("url"), PAGE_PATTERN, {"host": (1, "string"), "lang": (2, "string"), "number": (3, "bigint")})
    rows = t.pages.select("page_id", F.col("url").rlike(PAGE_PATTERN).alias("is_valid"), *[c.alias(n) for n, c in parts.items()])
    number = F.lpad(F.col("number").cast("string"), 6, "0")
    return rows.withColumn("canonical_id", scalars.compose_id(F.col("host"), F.col("lang"), number))


@query("bridge_status", r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2})/([0-9]+)', 2) AS code,
    try_cast(regexp_extract(url, '^https?://([^/?#]+)/([a-z]{2})/([0-9]+)', 3) AS BIGINT) AS doc_id FROM pages
), m AS (SELECT *, CASE WHEN code IN ('en', 'fr', 'de') THEN code END AS lang FROM p)
SELECT m.page_id, m.lang, m.doc_id, d.source AS doc_source,
  CASE WHEN m.lang IS NULL OR m.doc_id IS NULL THEN 'UNMAPPED' WHEN d.source IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS bridge_status
FROM m LEFT JOIN documents d ON d.lang = m.lang AND d.doc_id = m.doc_id
""")
def bridge_status(t):
    parts = scalars.parse_id(F.col("url"), PAGE_PATTERN, {"code": (2, "string"), "doc_id": (3, "bigint")})
    left = t.pages.select("page_id", *[c.alias(n) for n, c in parts.items()])
    left = left.withColumn("lang", scalars.map_codes(F.col("code"), LANGUAGES, unmapped=F.lit(None).cast("string"))).drop("code")
    right = t.documents.select("lang", "doc_id", F.col("source").alias("doc_source"))
    return joins.bridge(left, right, ["lang", "doc_id"], ["lang", "doc_id"], "doc_source")


@query("map_codes", """
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN
    CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'OPEN' ELSE o_orderstatus END ELSE o_orderstatus END AS status_code,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'P1' WHEN '2-HIGH' THEN 'P2' ELSE 'UNMAPPED' END AS priority_code FROM orders
""")
def map_codes(t):
    recent = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return t.orders.select(
        "o_orderkey",
        scalars.map_codes(F.col("o_orderstatus"), {"F": "FINAL", "O": "OPEN"}, when=recent).alias("status_code"),
        scalars.map_codes(F.col("o_orderpriority"), {"1-URGENT": "P1", "2-HIGH": "P2"}, unmapped=F.lit("UNMAPPED")).alias("priority_code"),
    )


@query("resolve_id", """
SELECT d.doc_id, coalesce(label_id, 'DOC:' || CAST(d.doc_id AS VARCHAR)) AS resolved_id, CASE WHEN label_id IS NOT NULL THEN 'DIRECTORY' ELSE 'NAMESPACED' END AS id_source
FROM documents d LEFT JOIN (SELECT doc_id, 'L' || CAST(doc_id AS VARCHAR) || '-' || CAST(quality AS VARCHAR) AS label_id FROM labels) l ON l.doc_id = d.doc_id
""")
def resolve_id(t):
    directory = t.labels.select("doc_id", F.concat(F.lit("L"), F.col("doc_id").cast("string"), F.lit("-"), F.col("quality").cast("string")).alias("label_id"))
    return joins.resolve_id(t.documents.select("doc_id"), directory, "doc_id", "label_id", "DOC").drop("label_id")


@query("empirical_probability", """
WITH b AS (SELECT o_orderpriority AS p, CAST(floor(o_totalprice / 500) AS BIGINT) AS r, count(*) AS c FROM orders GROUP BY ALL),
o AS (SELECT o_orderkey, o_orderpriority AS p, CAST(floor(o_totalprice / 500) AS BIGINT) AS x FROM orders),
d AS (SELECT DISTINCT p, x FROM o),
s AS (
  SELECT d.p, d.x, CAST(sum(c) AS BIGINT) AS n, coalesce(CAST(sum(c) FILTER (WHERE r > x) AS BIGINT), 0) AS hi, coalesce(CAST(sum(c) FILTER (WHERE r = x) AS BIGINT), 0) AS eq,
    coalesce(CAST(sum(c) FILTER (WHERE r < x) AS BIGINT), 0) AS lo FROM d JOIN b ON b.p = d.p GROUP BY ALL
)
SELECT o_orderkey, n AS sample_size, round(hi / n, 9) AS share_above, round(eq / n, 9) AS share_equal, round(lo / n, 9) AS share_below FROM o JOIN s USING (p, x)
""")
def empirical_probability(t):
    scaled = F.floor(F.col("o_totalprice") / 500)
    offers = t.orders.select("o_orderkey", "o_orderpriority", scaled.alias("line"))
    bank = t.orders.select("o_orderpriority", scaled.alias("residual"))
    out = joins.empirical_probability(offers, bank, "o_orderpriority", "line", "residual")
    shares = {c: rounded(c, 9) for c in ("share_above", "share_equal", "share_below")}
    return out.drop("line", "o_orderpriority").withColumns(shares)


@query("compare_ratings", """
WITH r AS (SELECT s_suppkey, s_acctbal, v FROM supplier JOIN (SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey)
SELECT s_suppkey, rank() OVER (ORDER BY CAST(round(s_acctbal * 100) AS BIGINT) DESC) AS balance_rank, rank() OVER (ORDER BY v DESC) AS revenue_rank,
  round((CAST(round(s_acctbal * 100) AS BIGINT) - (SELECT avg(CAST(round(s_acctbal * 100) AS BIGINT)) FROM r)) / (SELECT stddev_pop(CAST(round(s_acctbal * 100) AS BIGINT)) FROM r)
   - (v - (SELECT avg(v) FROM r)) / (SELECT stddev_pop(v) FROM r), 6) AS z_gap FROM r
""")
def compare_ratings(t):
    revenue = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum(cents("l_extendedprice")).alias("revenue"))
    balance = t.supplier.select("s_suppkey", cents("s_acctbal").alias("balance"))
    rows = joins.compare_ratings(balance, revenue, "s_suppkey", "balance", "revenue")
    rows = windows.global_rank(rows, "balance", "balance_rank")
    rows = windows.global_rank(rows, "revenue", "revenue_rank")
    return rows.select("s_suppkey", "balance_rank", "revenue_rank", rounded("z_gap").alias("z_gap"))


@query("blend_sources", """
SELECT c_custkey, round(0.7::DOUBLE * coalesce(a, 0) + 0.3::DOUBLE * coalesce(b, 0), 6) AS score FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) x ON x.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) y ON y.o_custkey = c_custkey
""")
def blend_sources(t):
    spine = t.customer.select("c_custkey")

    def counted(status: str):
        counts = t.orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("score"))
        return joins.complete_left(spine, counts, "c_custkey", ["score"])

    return joins.blend(counted("F"), counted("O"), "c_custkey", "score", 0.7).withColumn("score", rounded("score"))


@query("match_audit", """
SELECT d.doc_id, d.n_chars, length(d.text) AS text_chars, l.quality, CAST(d.n_chars AS BIGINT) = length(d.text) AS n_chars_matches,
  CAST(d.n_chars > 500 AS INTEGER) AS predicted, CAST(d.n_chars > 500 AS INTEGER) = l.quality AS predicted_matches
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def match_audit(t):
    docs = t.documents.select("doc_id", "n_chars", F.length("text").cast("long").alias("text_chars"), (F.col("n_chars") > 500).cast("int").alias("predicted"))
    return joins.match_audit(docs, t.labels.select("doc_id", "quality"), ["doc_id"], {"n_chars": "text_chars", "predicted": "quality"})


# -- unions, preference, gaps, folds ----------------------------------------------

@query("union_products", """
SELECT 'order' AS product, o_orderkey AS product_key, o_totalprice AS price, CAST(NULL AS DOUBLE) AS discount, o_orderpriority AS priority FROM orders
UNION ALL SELECT 'line', l_orderkey, l_extendedprice, l_discount, NULL FROM lineitem
""")
def union_products(t):
    orders = t.orders.select(F.lit("order").alias("product"), F.col("o_orderkey").alias("product_key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    lines = t.lineitem.select(F.lit("line").alias("product"), F.col("l_orderkey").alias("product_key"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return reshape.union_products([orders, lines])


@query("prefer_primary", """
WITH p AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
f AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS day FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL)
SELECT o_custkey, day, 'PRIMARY' AS source_label FROM p UNION ALL
SELECT o_custkey, day, 'FALLBACK' FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM p)
""")
def prefer_primary(t):
    def newest(condition):
        return t.orders.where(condition).groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("day"))

    urgent = F.col("o_orderpriority") == "1-URGENT"
    return reshape.prefer_primary(newest(urgent), newest(~urgent), "o_custkey")


@query("gap_fill", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM d GROUP BY ALL),
s AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT s.user_id, s.day, d.n, d.n IS NULL AS is_gap FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.day = s.day
""")
def gap_fill(t):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return reshape.fill_periods(days, "user_id", "day", F.min("day"), F.max("day"), F.expr("INTERVAL 1 DAY"))


@query("expanding_folds", """
SELECT fold, fold_role, count(*) AS order_count, CAST(min(y) AS BIGINT) AS first_year, CAST(max(y) AS BIGINT) AS last_year FROM (
  SELECT f.fold, year(o_orderdate) AS y, CASE WHEN year(o_orderdate) < f.fold THEN 'TRAIN' ELSE 'VALIDATE' END AS fold_role
  FROM orders JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS fold FROM orders WHERE year(o_orderdate) > (SELECT min(year(o_orderdate)) FROM orders)) f ON year(o_orderdate) <= f.fold) GROUP BY ALL
""")
def expanding_folds(t):
    rows = t.orders.select(F.year("o_orderdate").cast("long").alias("order_year"))
    # Counts per year first: the fold copies are then one row per year.
    yearly = rows.groupBy("order_year").agg(F.count(F.lit(1)).alias("n"))
    # One row per year.
    years = sorted(r["order_year"] for r in yearly.where("order_year is not null").select("order_year").collect())
    folds = reshape.expanding_folds(yearly, "order_year", years[1:])
    return folds.groupBy("fold", "fold_role").agg(
        F.sum("n").alias("order_count"), F.min("order_year").alias("first_year"), F.max("order_year").alias("last_year")
    )


@query("common_sample", """
SELECT d.doc_id, d.lang, d.n_chars, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.lang IN ('en', 'fr') AND l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.n_chars IS NOT NULL
""")
def common_sample(t):
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    kept = reshape.common_sample(rows, ["n_chars", "toxic"], "quality", "lang", ["en", "fr"])
    return kept.select("doc_id", "lang", "n_chars", F.col("quality").cast("long").alias("quality"))


# -- archive ----------------------------------------------------------------------------

_ARCHIVE_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("archive_keys", """
SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), coalesce(nullif(o_orderstatus, 'P'), '<NULL>'), CAST(CAST(o_orderdate AS DATE) AS VARCHAR))) AS archive_key FROM orders
""")
def archive_keys(t):
    rows = t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.to_date("o_orderdate").alias("day"))
    return publish.archive_keys(rows, ["o_orderkey", "o_custkey", "status", "day"]).select("o_orderkey", "archive_key")


@query("archive_new", """
WITH k AS (SELECT o_orderkey, o_orderdate, sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS archive_key FROM orders)
SELECT o_orderkey, archive_key FROM k WHERE o_orderdate >= TIMESTAMP '1998-01-01'
  AND archive_key NOT IN (SELECT archive_key FROM k WHERE o_orderdate < TIMESTAMP '1998-01-01')
""")
def archive_new(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    keyed = publish.archive_keys(t.orders, _ARCHIVE_COLUMNS)
    new = keyed.where(F.col("o_orderdate") >= cut).select("o_orderkey", "archive_key")
    return publish.archive_new(new, keyed.where(F.col("o_orderdate") < cut))


# -- feeds and nested data ------------------------------------------------------------------

@query("json_flatten", """
SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL
""")
def json_flatten(t):
    parsed = t.events.select("event_id", "user_id", F.from_json("props", "k bigint").alias("p"))
    return parsed.select("event_id", "user_id", "p.k").where("k IS NOT NULL")


@query("snapshot_flatten", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS snapshot_id, CAST(l_orderkey AS VARCHAR) AS event_id, CAST(l_suppkey AS VARCHAR) AS bookmaker_key,
  l_returnflag AS market_key, CAST(l_partkey AS VARCHAR) AS outcome_name, l_quantity AS price, l_discount AS point
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def snapshot_flatten(t):
    # One snapshot text per order, with its lines as bookmakers; it is parsed once and only the paths of offers are read.
    outcome = F.struct(F.col("l_partkey").cast("string").alias("name"), F.col("l_quantity").alias("price"), F.col("l_discount").alias("point"))
    market = F.struct(F.col("l_returnflag").alias("key"), F.array(outcome).alias("outcomes"))
    book = F.struct(F.col("l_suppkey").cast("string").alias("key"), F.array(market).alias("markets"))
    # An order has a handful of lines.
    books = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(book).alias("bookmakers"))
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("string").alias("snapshot_id"))
    event = F.struct(F.col("l_orderkey").cast("string").alias("id"), "bookmakers")
    metadata = F.struct(F.col("snapshot_id").alias("fetched_at"), F.lit("orders").alias("sport_key"))
    texts = books.join(orders, "l_orderkey").select(
        "snapshot_id", F.to_json(F.struct(metadata.alias("metadata"), F.array(event).alias("events"))).alias("body")
    )
    return scans.snapshot_offers(scans.gate_snapshots(texts), ["snapshot_id"]).select(
        "snapshot_id", "event_id", "bookmaker_key", "market_key", "outcome_name", "price", "point"
    )


@query("next_event", """
WITH n AS (
  SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01'
)
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Out' WHEN 'MACHINERY' THEN 'Questionable' END AS status, CAST(o_orderdate AS DATE) AS next_day, o_orderkey AS next_orderkey
FROM customer JOIN n ON o_custkey = c_custkey AND rn = 1
""")
def next_event(t):
    feed = t.customer.select("c_custkey", F.col("c_mktsegment").alias("status"))
    sides = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("next_time"), F.col("o_orderkey").alias("next_orderkey"))
    found = scans.feed_to_next_event(
        feed, sides, "c_custkey", "next_time", "next_orderkey", F.lit("1999-06-01").cast("timestamp_ntz"),
        "status", {"BUILDING": "Out", "MACHINERY": "Questionable"},
    )
    return found.select("c_custkey", "status", F.to_date("next_time").alias("next_day"), "next_orderkey")


# -- top-k -----------------------------------------------------------------------------------

@query("top1_filtered", """
SELECT p_brand, p_type, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part WHERE p_size >= 10) WHERE rn = 1
""")
def top1_filtered(t):
    parts = t.part.where("p_size >= 10").select("p_brand", "p_type", "p_partkey", "p_retailprice")
    return topk.top_rows(parts, ["p_brand", "p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")])


@query("liquid_group", """
WITH g AS (
  SELECT l_partkey, CAST(l_discount * 100 AS INTEGER) AS line, max(l_quantity) AS liq FROM lineitem GROUP BY ALL
), c AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY liq DESC, line) AS rn FROM g),
r AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.l_partkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS rn
  FROM lineitem l JOIN c ON c.l_partkey = l.l_partkey AND c.line = CAST(l.l_discount * 100 AS INTEGER) AND c.rn = 1
)
SELECT l_partkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice, l_discount FROM r WHERE rn = 1
""")
def liquid_group(t):
    rows = t.lineitem.withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return topk.preferred_in_modal_group(
        rows, "l_partkey", F.round(F.col("l_discount") * 100).cast("int"), "l_quantity",
        ["l_extendedprice", "l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"],
    )


@query("next_period", """
WITH f AS (SELECT date_trunc('month', o_orderdate) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-15' ORDER BY o_orderdate LIMIT 1)
SELECT o_orderkey, o_custkey FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT m FROM f)
""")
def next_period(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
    found = topk.next_period(rows, "o_orderdate", "month", F.lit("1998-06-15").cast("timestamp_ntz"))
    return found.select("o_orderkey", "o_custkey")


@query("extremes", """
SELECT 'closest' AS pick, p_partkey, p_name FROM (SELECT * FROM part ORDER BY abs(p_retailprice - 1000), p_partkey LIMIT 1)
UNION ALL SELECT 'largest', p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 1)
UNION ALL SELECT 'highest', p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)
""")
def extremes(t):
    tie = [F.col("p_partkey")]
    return topk.extremes(t.part, {
        "closest": (F.abs(F.col("p_retailprice") - 1000), tie),
        "largest": (-F.col("p_size"), tie),
        "highest": (-F.col("p_retailprice"), tie),
    }, ["p_partkey", "p_name"])


@query("best_parameters", """
WITH e AS (
  SELECT g.factor, avg(abs(l_extendedprice - g.factor * l_quantity * p_retailprice)) AS mae, max(abs(l_extendedprice - g.factor * l_quantity * p_retailprice)) AS worst
  FROM lineitem JOIN part ON p_partkey = l_partkey CROSS JOIN (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5])::DOUBLE AS factor) g GROUP BY ALL
)
SELECT factor, round(mae, 4) AS mae, round(worst, 4) AS worst FROM e ORDER BY mae, worst, factor LIMIT 1
""")
def best_parameters(t):
    price = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = skew.join_lookup(t.lineitem.select("l_partkey", "l_quantity", "l_extendedprice"), price, "l_partkey", "inner")
    swept = reshape.sweep(rows, "factor", [0.5, 0.75, 1.0, 1.25, 1.5])
    error = F.abs(F.col("l_extendedprice") - F.col("factor") * F.col("l_quantity") * F.col("p_retailprice"))
    table = swept.groupBy("factor").agg(F.avg(error).alias("mae"), F.max(error).alias("worst"))
    best = topk.best_parameters(table, "mae", ["worst", "factor"])
    return best.select("factor", rounded("mae", 4).alias("mae"), rounded("worst", 4).alias("worst"))


@query("recommended", """
WITH b AS (
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_shipdate, o_orderdate, date_trunc('month', l_shipdate) AS period,
    CAST(round(l_discount * 100) AS BIGINT) AS edge, CAST(round(l_tax * 100) AS BIGINT) AS ev, CAST(l_quantity AS BIGINT) AS books
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate < l_shipdate
), n AS (SELECT period FROM b WHERE l_shipdate >= TIMESTAMP '1998-06-15' ORDER BY l_shipdate, period LIMIT 1),
k AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ev DESC, edge DESC, l_orderkey, l_linenumber) AS rn FROM b
  WHERE period = (SELECT period FROM n) AND edge BETWEEN 2 AND 8 AND ev > 0 AND books >= 5
)
SELECT l_suppkey, l_orderkey, l_linenumber, edge, ev, books FROM k WHERE rn = 1 ORDER BY ev DESC, edge DESC, l_suppkey LIMIT 9
""")
def recommended(t):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    board = t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", "l_shipdate",
        F.trunc(F.to_date("l_shipdate"), "month").alias("period"),
        F.round(F.col("l_discount") * 100).cast("long").alias("edge"), F.round(F.col("l_tax") * 100).cast("long").alias("ev"),
        F.col("l_quantity").cast("long").alias("books"),
    )
    board = skew.join_lookup(board, orders, "l_orderkey", "inner")
    board = scalars.before_event(board, "l_shipdate", ["o_orderdate"])
    board = topk.next_period(board, "l_shipdate", "period", F.lit("1998-06-15").cast("timestamp_ntz"))
    status = scalars.classify_rules([
        ("edge_out_of_range", ~F.col("edge").between(2, 8)),
        ("no_value", F.col("ev") <= 0),
        ("few_books", F.col("books") < 5),
    ], ok="TOP_PICK")["status"]
    picks = topk.top_rows(
        board.where(status == "TOP_PICK"), "l_suppkey",
        [F.desc("ev"), F.desc("edge"), F.asc("l_orderkey"), F.asc("l_linenumber")],
    )
    best = topk.limit_ordered(picks, [F.desc("ev"), F.desc("edge"), F.asc("l_suppkey")], 9)
    return best.select("l_suppkey", "l_orderkey", "l_linenumber", "edge", "ev", "books")
