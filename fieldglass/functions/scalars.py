"""Column functions: text, codes, prices, ratings, settlement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-6


# -- outcomes and flags -----------------------------------------------------

def outcome_columns(home: Column, away: Column) -> dict[str, Column]:
    """Result columns of a two-score row; null while a score is missing."""
    done = home.isNotNull() & away.isNotNull()
    return {
        "is_completed": done,
        "home_win": F.when(done, home > away),
        "away_win": F.when(done, away > home),
        "is_tie": F.when(done, home == away),
        "point_differential": F.when(done, home - away),
        "total_points": F.when(done, home + away),
        "game_result": F.when(~done, "NOT_PLAYED")
        .when(home > away, "HOME_WIN")
        .when(away > home, "AWAY_WIN")
        .otherwise("TIE"),
    }


def derive_outcome(df: DataFrame, home: str, away: str) -> DataFrame:
    columns = outcome_columns(F.col(home), F.col(away))
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def filter_valid(
    df: DataFrame, not_null: Sequence[str] = (), zero_flags: Sequence[str] = (), any_of: Sequence[str] = ()
) -> DataFrame:
    """Required values present, all exclusion flags 0, any inclusion flag 1."""
    tests = [F.col(c).isNotNull() for c in not_null]
    tests += [F.coalesce(F.col(c), F.lit(0)) == 0 for c in zero_flags]
    if any_of:
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) == 1 for c in any_of]))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def flag(condition: Column) -> Column:
    """A condition that is false, not null, on missing input."""
    return F.coalesce(condition, F.lit(False))


def threshold_diff(a: Column, b: Column, low: float | None = None, high: float | None = None) -> dict[str, Column]:
    """Side flags at a threshold and their difference."""
    def mark(x: Column) -> Column:
        test = F.lit(True)
        if low is not None:
            test = test & (x <= low)
        if high is not None:
            test = test & (x >= high)
        return test.cast("int")

    return {"a_flag": mark(a), "b_flag": mark(b), "flag_diff": mark(a) - mark(b)}


def hinge(column: Column, knot: float, side: str, when: Column, neutral: float = 0.0) -> Column:
    """P5: distance beyond a knot, neutral where the input does not apply."""
    distance = column - knot if side == "above" else F.lit(float(knot)) - column
    return F.when(when & column.isNotNull(), F.greatest(distance, F.lit(0.0))).otherwise(F.lit(float(neutral)))


def category(column: Column, missing: str = "unknown") -> Column:
    """P5: lower-cased, trimmed category with a name for blanks."""
    return F.coalesce(F.nullif(F.lower(F.trim(column)), F.lit("")), F.lit(missing))


def clean_text(column: Column) -> Column:
    """Trimmed text, blank becomes null."""
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def allow_list(column: Column, allowed: Sequence[str]) -> Column:
    """The cleaned value if listed, else null."""
    text = clean_text(column)
    return F.when(text.isin(*allowed), text)


def map_codes(
    column: Column, mapping: Mapping[str, str], when: Column | None = None, unmapped: Column | None = None
) -> Column:
    """Replace codes by a small dictionary, optionally only where ``when``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), column)
    fallback = column if unmapped is None else unmapped
    value = F.coalesce(found, fallback)
    return value if when is None else F.when(when, value).otherwise(column)


def parse_id(column: Column, pattern: str, parts: Mapping[str, tuple[int, str]]) -> dict[str, Column]:
    """Typed parts of a structured id; all null where the pattern fails."""
    ok = column.rlike(pattern)
    return {
        name: F.when(ok, F.regexp_extract(column, pattern, group).try_cast(kind))
        for name, (group, kind) in parts.items()
    }


def compose_id(*parts: Column, sep: str = "_") -> Column:
    """Rebuild an id; null if any part is null."""
    missing = reduce(lambda a, b: a | b, [p.isNull() for p in parts])
    return F.when(~missing, F.concat_ws(sep, *[p.cast("string") for p in parts]))


def numeric_or_reject(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric conversion; all-missing rows drop, partly missing rows fail."""
    converted = df.select(
        *[F.col(c).try_cast("double").alias(c) if c in columns else F.col(c) for c in df.columns]
    )
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    kept = converted.where(missing < len(columns))
    guard = F.when(missing > 0, F.raise_error(F.lit("partly missing numeric row"))).otherwise(F.col(columns[0]))
    return kept.withColumn(columns[0], guard)


def assign_split(period: Column, bounds: Sequence[tuple[int, str]], last: str) -> Column:
    """P10: split label of an ordered period: first bound it does not exceed."""
    out = None
    for limit, label in bounds:
        out = F.when(period <= limit, label) if out is None else out.when(period <= limit, label)
    return out.otherwise(last)


def bucket_label(value: Column, steps: Sequence[tuple[float, str]], top: str, inclusive: bool = True) -> Column:
    """Label by ascending upper limits; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in steps:
        out = out.when(value <= limit if inclusive else value < limit, label)
    return out.otherwise(top)


def season_phase(week: Column) -> Column:
    """Phase of a regular season."""
    return bucket_label(week, [(6, "early"), (12, "middle"), (18, "late")], "postseason")


def edge_strength(probability: Column) -> Column:
    """Wording for the distance of a probability from one half."""
    return bucket_label(
        F.abs(probability - 0.5),
        [(0.025, "toss_up"), (0.075, "slight_edge"), (0.15, "clear_edge")], "strong_edge", inclusive=False,
    )


def local_date(instant: Column, zone: str, source: str | None = "UTC") -> Column:
    """Calendar date of an instant in a zone.

    ``source`` is the zone of a zone-less column; ``None`` is for a true instant
    (``timestamp``), which Spark renders in the session zone first.
    """
    origin = None if source is None else F.lit(source)
    return F.convert_timezone(origin, F.lit(zone), instant.cast("timestamp_ntz")).cast("date")


# -- prices -------------------------------------------------------------------

def american_to_decimal(price: Column, strict: bool = True) -> Column:
    """Strict prices lie at or beyond +-100; otherwise any non-zero price."""
    ok = (F.abs(price) >= 100) if strict else (price != 0)
    p = price.cast("double")
    return F.when(ok & (price > 0), F.lit(1.0) + p / 100.0).when(ok, F.lit(1.0) + F.try_divide(F.lit(100.0), F.abs(p)))


def implied_probability(price: Column, strict: bool = True) -> Column:
    """Probability at which a price breaks even."""
    ok = (F.abs(price) >= 100) if strict else (price != 0)
    p = price.cast("double")
    return F.when(ok & (price > 0), F.lit(100.0) / (p + 100.0)).when(ok, F.abs(p) / (F.abs(p) + 100.0))


def outcome_side(name: Column, home: Column, away: Column) -> Column:
    """Home / away / over / under / other."""
    lowered = F.lower(name)
    return (
        F.when(name == home, "home").when(name == away, "away")
        .when(lowered.isin("over", "under"), lowered).otherwise("other")
    )


#: Display names of the markets.
MARKET_NAMES = {"h2h": "Moneyline", "spreads": "Spread", "totals": "Totals"}


def market_line(market: Column, point: Column) -> Column:
    """Both sides of a spread share the absolute line."""
    return F.when(market == "spreads", F.abs(point)).when(market == "totals", point)


def price_columns(
    p_win: Column, p_push: Column, p_loss: Column, decimal_odds: Column, market_p: Column,
    infinite_fair: bool = False,
) -> dict[str, Column]:
    """Value of an offer.  A push returns the stake.

    Fair odds and the Kelly share condition on no push.  With no winning chance
    fair odds are null, or infinite when ``infinite_fair``.
    """
    resolved = p_win + p_loss
    profit = decimal_odds - 1.0
    expected = p_win * profit - p_loss
    fair = F.try_divide(resolved, p_win)
    if infinite_fair:
        fair = F.when(p_win == 0, F.lit(float("inf"))).otherwise(fair)
    kelly = F.greatest(F.try_divide(expected, profit * resolved), F.lit(0.0))
    return {
        "edge": F.try_divide(p_win, resolved) - market_p,
        "fair_odds": fair,
        "expected_value": expected,
        "kelly_fraction": kelly,
        "is_positive": expected > 0,
    }


def price_offers(df: DataFrame, p_win: str, p_push: str, p_loss: str, odds: str, market_p: str, **kw) -> DataFrame:
    columns = price_columns(*[F.col(c) for c in (p_win, p_push, p_loss, odds, market_p)], **kw)
    return df.select("*", *[c.alias(n) for n, c in columns.items()])


def settle_columns(comparison: Column, decimal_odds: Column, tolerance: float = 1e-9) -> dict[str, Column]:
    """Win, loss or push, and the profit of a unit stake."""
    result = (
        F.when(F.abs(comparison) <= tolerance, "PUSH").when(comparison > 0, "WIN").when(comparison < 0, "LOSS")
    )
    profit = (
        F.when(F.abs(comparison) <= tolerance, 0.0)
        .when(comparison > 0, decimal_odds - 1.0)
        .when(comparison < 0, -1.0)
    )
    return {"settlement": result, "profit": profit}


def edge_bucket(market: Column, edge: Column, steps: Mapping[str, Sequence[tuple[float, str]]], top: Mapping[str, str]) -> Column:
    """Bucket of an edge with thresholds that depend on the market."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, limits in steps.items():
        out = out.when(market == key, bucket_label(edge, limits, top[key], inclusive=False))
    return out


#: Bucket limits of probability markets and of point markets; a
#: value at the last limit or beyond is VERY_HIGH.
PROBABILITY_STEPS = ((0.025, "LOW"), (0.05, "MEDIUM"), (0.10, "HIGH"))
POINT_STEPS = ((1.0, "LOW"), (2.0, "MEDIUM"), (3.0, "HIGH"))


# -- ratings and probabilities ---------------------------------------------------

def rating_probability(own: Column, other: Column, advantage: Column | float = 0.0, scale: float = 400.0) -> Column:
    """Logistic win probability of a rating difference."""
    edge = advantage if isinstance(advantage, Column) else F.lit(float(advantage))
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (other - (own + edge)) / scale))


def explain_rating(own: Column, other: Column, advantage: Column, scale: float = 400.0) -> dict[str, Column]:
    """Log-odds split into rating and venue parts, and a wording."""
    unit = F.log(F.lit(10.0)) / scale
    gap = own + advantage - other
    return {
        "rating_log_odds": (own - other) * unit,
        "venue_log_odds": advantage * unit,
        "total_log_odds": gap * unit,
        "matchup": bucket_label(
            F.abs(gap), [(25, "toss_up"), (75, "slight_edge"), (150, "clear_edge")], "strong_edge", inclusive=False
        ),
    }


def regress_rating(rating: Column, seasons: Column, mean: float = 1500.0, retention: float = 0.60) -> Column:
    """Pull towards the mean once per crossed season."""
    return F.lit(mean) + (rating - F.lit(mean)) * F.pow(F.lit(retention), seasons)


def clip_probability(p: Column, epsilon: float = EPSILON) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0 - epsilon))


def logit(p: Column, epsilon: float = EPSILON) -> Column:
    q = clip_probability(p, epsilon)
    return F.log(q / (F.lit(1.0) - q))


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sharpen(p: Column, factor: Column | float, epsilon: float = EPSILON) -> Column:
    """P20: scale the log-odds."""
    k = factor if isinstance(factor, Column) else F.lit(float(factor))
    return inverse_logit(logit(p, epsilon) * k)


def shift_by_rating(p: Column, rating_change: Column, scale: float = 400.0) -> Column:
    """Move a baseline probability by a rating change on the log-odds scale."""
    return inverse_logit(logit(p) + rating_change * F.log(F.lit(10.0)) / scale)


def rescale(x: Column, center: Column, factor: Column | float) -> Column:
    """Stretch a prediction around a training mean."""
    return center + factor * (x - center)


def clip_share(x: Column, upper: float = 1.0) -> dict[str, Column]:
    """Capped share and whether it was capped; null stays null."""
    return {"share": F.when(x.isNotNull(), F.least(x, F.lit(upper))), "was_capped": flag(x > upper)}


def route_fallback(
    df: DataFrame, complete: Column, primary: Column, fallback: Column, value: str = "prediction"
) -> DataFrame:
    """Primary value where its inputs are complete, else the fallback."""
    chosen = F.when(complete, primary).otherwise(fallback)
    return df.withColumn(value, chosen).withColumn(
        "prediction_mode", F.when(complete, "PRIMARY").when(fallback.isNotNull(), "FALLBACK").otherwise("UNAVAILABLE")
    ).withColumn("route_reason", F.when(complete, "COMPLETE_INPUTS").otherwise("MISSING_INPUTS"))


def score_split(total: Column, margin: Column) -> dict[str, Column]:
    """Two scores from their sum and difference; level scores go home."""
    home, away = (total + margin) / 2.0, (total - margin) / 2.0
    return {"home_score": home, "away_score": away, "winner": F.when(home >= away, "HOME").otherwise("AWAY")}


def impact_columns(
    status: Column, practice: Column, tier: Column, usage: Column, games: Column, weights: Mapping[str, Mapping[str, float]],
    full_games: float = 4.0,
) -> dict[str, Column]:
    """Severity x importance, with caps and a reliability blend.

    ``usage`` is null without history.  ``weights`` holds ``status``,
    ``practice`` and ``tier`` tables; the tier table has an ``unknown`` entry.
    """
    def lookup(column: Column, table: Mapping[str, float], default: float) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for key, value in table.items():
            out = out.when(column == key, F.lit(float(value)))
        return out.otherwise(F.lit(default))

    base = lookup(status, weights["status"], 0.0)
    modifier = F.when(status.isNull(), 0.0).otherwise(lookup(practice, weights["practice"], 0.0))
    severity = (
        F.when(base >= 1.0, 1.0)
        .when(status.isNull(), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(base + modifier, F.lit(1.0))))
    )
    known = usage.isNotNull()
    reliability = F.when(known, F.least(F.coalesce(games, F.lit(0)) / F.lit(full_games), F.lit(1.0))).otherwise(0.0)
    depth = lookup(tier, weights["tier"], float(weights["tier"]["unknown"]))
    importance = F.when(known, reliability * usage + (F.lit(1.0) - reliability) * depth).otherwise(depth)
    return {"severity": severity, "importance": importance, "impact": severity * importance}


#: Fixed values of the availability score.
IMPACT_WEIGHTS = {
    "status": {"Out": 1.00, "Doubtful": 0.75, "Questionable": 0.35},
    "practice": {"DNP": 0.10, "LIMITED": 0.05, "FULL": -0.05},
    "tier": {"STARTER": 1.00, "PRIMARY_BACKUP": 0.55, "RESERVE": 0.25, "unknown": 0.40},
}


def pair_features(metrics: Sequence[str], ops: Sequence[str] = ("sum", "diff"), a: str = "home_", b: str = "away_") -> dict[str, Column]:
    """Side-order-free sums and home-minus-away differences."""
    out = {}
    for metric in metrics:
        x, y = F.col(a + metric), F.col(b + metric)
        if "sum" in ops:
            out[f"{metric}_sum"] = x + y
        if "diff" in ops:
            out[f"{metric}_difference"] = x - y
    return out


def render_text(templates: Mapping[str, Sequence[tuple[Column, str, Sequence[Column]]]]) -> dict[str, Column]:
    """P25: text columns; each language lists (condition, format, arguments)."""
    out = {}
    for name, rules in templates.items():
        text = F.when(F.lit(False), F.lit(""))
        for condition, pattern, args in rules:
            text = text.when(condition, F.format_string(pattern, *args))
        out[name] = text
    return out


def classify_rules(rules: Sequence[tuple[str, Column]], ok: str = "PUBLISH") -> dict[str, Column]:
    """One flag per violated rule, the violated names and a status."""
    flags = {f"flag_{name}": flag(test) for name, test in rules}
    hit = F.array_compact(F.array(*[F.when(flag(test), F.lit(name)) for name, test in rules]))
    return {
        **flags,
        "violations": F.concat_ws(",", hit),
        "status": F.when(F.size(hit) == 0, ok).otherwise(F.element_at(hit, 1)),
    }


def before_event(df: DataFrame, event: str, times: Sequence[str]) -> DataFrame:
    """Rows whose capture times all precede the event; "now" is an argument."""
    return df.where(reduce(lambda a, b: a & b, [F.col(t) < F.col(event) for t in times]))


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Canonical columns in order, lenient casts, absent columns as typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def minute_difference(start: Column, end: Column) -> Column:
    """Minute boundaries crossed between two times."""
    seconds = F.timestamp_diff("SECOND", F.date_trunc("minute", start), F.date_trunc("minute", end))
    return (seconds / 60).cast("long")
