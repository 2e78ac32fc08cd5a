"""Injury reports, depth charts and snap counts to game availability features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.functions import scalars
from fieldglass.operators import aggregates, asof, joins, windows
from fieldglass.plans import reference_values as ref

SCHEDULE_KEYS = ["game_id", "season", "game_type", "week", "gameday"]


def scheduled_sides(schedule: DataFrame) -> DataFrame:
    """One row per team and game."""
    return joins.two_sided(schedule.withColumn("gameday", F.to_date("gameday")), SCHEDULE_KEYS, {
        "home": {"team": F.col("home_team"), "opponent": F.col("away_team"), "is_home": F.lit(True)},
        "away": {"team": F.col("away_team"), "opponent": F.col("home_team"), "is_home": F.lit(False)},
    }).drop("side")


def injury_status(reports: DataFrame, schedule: DataFrame) -> DataFrame:
    """The last report of a player before a game, cleaned, with status flags."""
    sides = scheduled_sides(schedule)
    matched = reports.join(sides, ["season", "game_type", "week", "team"])
    key = ["season", "game_type", "week", "team", "gsis_id"]
    counts = F.count(F.lit(1)).alias("source_snapshot_count")
    rest = [c for c in matched.columns if c not in key]
    # Nulls compare lowest in a struct, so a stamped report beats an unstamped one.
    newest = F.max_by(F.struct(*rest), F.struct("date_modified", "report_status", "practice_status"))
    rows = matched.groupBy(*key).agg(newest.alias("r"), counts).select(*key, "r.*", "source_snapshot_count")
    text = ["position", "full_name", "report_primary_injury", "report_secondary_injury", "practice_primary_injury", "practice_secondary_injury"]
    rows = rows.withColumns({c: scalars.clean_text(F.col(c)) for c in text})
    rows = rows.withColumns({
        "report_status": scalars.allow_list(F.col("report_status"), ref.REPORT_STATUSES),
        "practice_status": scalars.allow_list(F.col("practice_status"), list(ref.PRACTICE_STATUSES)),
    })
    none, limited, full = ref.PRACTICE_STATUSES
    flags = {f"is_{s.lower()}": F.col("report_status") == s for s in ref.REPORT_STATUSES}
    flags |= {"did_not_practice": F.col("practice_status") == none, "limited_practice": F.col("practice_status") == limited, "full_practice": F.col("practice_status") == full}
    return rows.withColumns({n: scalars.flag(c) for n, c in flags.items()}).withColumn(
        "has_source_timestamp", F.col("date_modified").isNotNull()
    ).withColumnRenamed("date_modified", "source_date_modified")


def snap_counts(snaps: DataFrame, schedule: DataFrame, directory: DataFrame) -> DataFrame:
    """Snap counts with player identity and capped shares."""
    games = schedule.select("game_id", "season", "game_type", "week", F.to_date("gameday").alias("gameday"), "home_team")
    raw = snaps.select("game_id", "pfr_game_id", "team", "opponent", "pfr_player_id", F.col("player").alias("source_player_name"),
                       F.col("position").alias("source_position"), "offense_snaps", "offense_pct", "defense_snaps", "defense_pct", "st_snaps", "st_pct", "source_file")
    people = directory.select(
        F.col("pfr_id").alias("pfr_player_id"), "gsis_id", "espn_id", "display_name", F.col("position").alias("directory_position"),
        F.col("position_group").alias("directory_position_group"),
    ).where("pfr_player_id IS NOT NULL")
    rows = raw.join(games, "game_id").join(people, "pfr_player_id", "left")
    units = {"offense": "offense", "defense": "defense", "special_teams": "st"}
    capped = {u: scalars.clip_share(F.col(f"{c}_pct")) for u, c in units.items()}
    played = {u: F.coalesce(F.col(f"{c}_snaps"), F.lit(0)) for u, c in units.items()}
    adjusted = capped["offense"]["was_capped"] | capped["defense"]["was_capped"] | capped["special_teams"]["was_capped"]
    rows = rows.withColumns(
        {f"{u}_snap_share": capped[u]["share"] for u in units}
        | {f"played_{u}": played[u] > 0 for u in units}
        | {
            "is_home": F.col("team") == F.col("home_team"),
            "player_key": F.coalesce("gsis_id", F.concat(F.lit("PFR:"), "pfr_player_id")),
            "player_name": F.coalesce("display_name", "source_player_name"),
            "total_snaps": played["offense"] + played["defense"] + played["special_teams"],
            "has_source_rounding_adjustment": adjusted,
            "has_player_directory_match": F.col("gsis_id").isNotNull(),
            "player_identifier_source": F.when(F.col("gsis_id").isNotNull(), "GSIS").otherwise("PFR"),
        }
    )
    renamed = {f"{c}_pct": f"source_{u}_snap_share" for u, c in units.items()}
    return rows.drop("home_team", "display_name").withColumnsRenamed(renamed)


def snap_share_history(snaps: DataFrame) -> DataFrame:
    """Usage up to and including each appearance, over a career and with the team."""
    units = ["offense_snap_share", "defense_snap_share", "special_teams_snap_share"]
    short, long = ref.FORM_WINDOWS

    def level(prefix: str):
        def columns(window):
            out = {f"previous_{prefix}_game_id": F.lag("game_id").over(window), f"previous_{prefix}_gameday": F.lag("gameday").over(window)}
            for n in (short, long):
                frame = window.rowsBetween(-(n - 1), 0)
                out[f"{prefix}_games_last_{n}"] = F.count(F.lit(1)).over(frame)
                out |= {f"{prefix}_{u}_last_{n}": F.avg(u).over(frame) for u in units}
            return out
        return columns

    rows = windows.lookback(snaps, "player_key", ["gameday", "game_id", "team"], level("career"), long, position="career_appearance_count")
    rows = windows.lookback(rows, ["player_key", "team"], ["gameday", "game_id"], level("team"), long, position="team_appearance_count")
    return rows.withColumns({
        f"days_since_previous_{p}_appearance": F.datediff("gameday", F.col(f"previous_{p}_gameday")) for p in ("career", "team")
    } | {"available_after_gameday": F.col("gameday")})


_ROLE = [*SCHEDULE_KEYS, "team", "opponent", "is_home", "player_key", "formation", "depth_position"]


def _depth_roles(rows: DataFrame, keys: list[str], generation: str, open_reserve: bool) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in ("gsis_id", "espn_id", "player_name", "player_position")],
        F.min("source_depth_rank").alias("depth_rank"), F.count(F.lit(1)).alias("source_record_count"),
        F.countDistinct("source_depth_rank").alias("source_rank_count"),
    )
    rank = F.col("depth_rank")
    return grouped.withColumns({
        "is_starter": rank == 1, "is_primary_backup": rank == 2, "is_reserve": (rank >= 3) if open_reserve else (rank == 3),
        "has_conflicting_ranks": F.col("source_rank_count") > 1, "source_generation": F.lit(generation),
    })


def espn_depth(depth: DataFrame, schedule: DataFrame, seasons: tuple[int, int]) -> DataFrame:
    """Roles from the team's newest chart of the season up to the game day."""
    sides = scheduled_sides(schedule.where(F.col("season").between(*seasons)))
    parsed = depth.select(
        F.col("source_season").alias("season"), "team", F.to_timestamp("dt").alias("source_snapshot_at"), "player_name", "espn_id", "gsis_id",
        "pos_grp", "pos_name", "pos_abb", "pos_slot", "pos_rank",
    )
    # The chart counts by its date, then by its time within that date.
    by = ["season", "team"]
    moments = parsed.select(*by, "source_snapshot_at").distinct().withColumn("__day", F.to_date("source_snapshot_at"))
    chosen = asof.asof_join(sides, moments, by, "gameday", "__day", ["source_snapshot_at"], ["source_snapshot_at"], strict=False)
    rows = chosen.join(parsed, [*by, "source_snapshot_at"])
    formation = F.when(F.col("pos_grp") == "Special Teams", "Special Teams").when(F.col("pos_grp").like("Base % D"), "Defense").otherwise("Offense")
    rows = rows.withColumns({
        "player_key": F.coalesce("gsis_id", F.concat(F.lit("ESPN:"), F.col("espn_id").cast("string"))),
        "player_name": scalars.clean_text(F.col("player_name")), "player_position": scalars.clean_text(F.col("pos_abb")),
        "formation": formation, "depth_position": scalars.clean_text(F.col("pos_name")), "source_depth_rank": F.col("pos_rank"),
        "position_slot": F.col("pos_slot"), "espn_id": F.col("espn_id").cast("string"),
    })
    return _depth_roles(rows, [*_ROLE, "position_slot", "source_snapshot_at"], "espn", True)


def legacy_depth(depth: DataFrame, schedule: DataFrame, seasons: tuple[int, int]) -> DataFrame:
    """Roles from weekly charts that name the week."""
    sides = scheduled_sides(schedule.where(F.col("season").between(*seasons)))
    rows = depth.withColumnRenamed("club_code", "team").join(sides, ["season", "game_type", "week", "team"])
    rows = rows.withColumns({
        "player_key": F.col("gsis_id"), "espn_id": F.lit(None).cast("string"), "player_name": scalars.clean_text(F.col("full_name")),
        "player_position": scalars.clean_text(F.col("position")), "formation": scalars.clean_text(F.col("formation")),
        "depth_position": scalars.clean_text(F.col("depth_position")), "source_depth_rank": F.col("depth_team").try_cast("int"),
        "position_slot": F.lit(None).cast("int"), "source_snapshot_at": F.lit(None).cast("timestamp"),
    })
    return _depth_roles(rows, [*_ROLE, "position_slot", "source_snapshot_at"], "legacy_nfl", False)


def depth_chart(legacy: DataFrame, espn: DataFrame) -> DataFrame:
    """Both generations under one schema with tiers and provenance."""
    rows = legacy.unionByName(espn)
    known = F.col("gsis_id").isNotNull()
    return rows.withColumns({
        "has_gsis_id": known, "player_identifier_source": F.when(known, "GSIS").otherwise("ESPN"),
        "depth_tier": F.when(F.col("is_starter"), "STARTER").when(F.col("is_primary_backup"), "PRIMARY_BACKUP").otherwise("RESERVE"),
        "is_offense_role": F.col("formation") == "Offense", "is_defense_role": F.col("formation") == "Defense",
        "is_special_teams_role": F.col("formation") == "Special Teams", "has_timestamped_snapshot": F.col("source_snapshot_at").isNotNull(),
    })


def injury_context(status: DataFrame, depth: DataFrame, history: DataFrame) -> DataFrame:
    """Reported players with their depth role and usage before the game."""
    formation = F.col("formation")
    roles = aggregates.rollup_roles(
        depth.where("gsis_id IS NOT NULL"), ["game_id", "team", "gsis_id"],
        {
            "has_starter_role": F.col("is_starter"), "has_primary_backup_role": F.col("is_primary_backup"), "has_reserve_role": F.col("is_reserve"),
            "has_offense_role": formation == "Offense", "has_defense_role": formation == "Defense", "has_special_teams_role": formation == "Special Teams",
            "__matched": F.lit(True),
        },
        "formation", ["depth_rank", "source_generation"],
    ).drop("has_conflict").withColumnsRenamed({
        "formation_count": "depth_formation_count", "min_depth_rank": "best_depth_rank", "min_source_generation": "depth_source_generation",
    })
    flags = [c for c in roles.columns if c.startswith("has_")] + ["__matched"]
    rows = status.join(roles, ["game_id", "team", "gsis_id"], "left")
    rows = rows.withColumns({c: scalars.flag(F.col(c)) for c in flags} | {"depth_formation_count": F.coalesce("depth_formation_count", F.lit(0))})
    rows = rows.withColumnRenamed("__matched", "has_depth_chart_match").withColumn(
        "depth_tier",
        F.when(F.col("has_starter_role"), "STARTER").when(F.col("has_primary_backup_role"), "PRIMARY_BACKUP")
        .when(F.col("has_depth_chart_match"), "RESERVE").otherwise("UNKNOWN"),
    )
    rows = rows.withColumn("player_key", F.col("gsis_id"))
    usage = [f"{p}_{u}_snap_share_last_{n}" for p in ("career", "team") for u in ("offense", "defense", "special_teams") for n in ref.FORM_WINDOWS]
    counts = ["career_appearance_count", "team_appearance_count"] + [f"{p}_games_last_{n}" for p in ("career", "team") for n in ref.FORM_WINDOWS]
    past = history.select(
        "player_key", "available_after_gameday", F.col("game_id").alias("prior_snap_history_game_id"),
        F.col("gameday").alias("prior_snap_history_gameday"), F.col("team").alias("prior_snap_history_team"), *usage, *counts,
    )
    payload = [c for c in past.columns if c not in ("player_key", "available_after_gameday")]
    rows = asof.asof_join(rows, past, "player_key", "gameday", "available_after_gameday", ["prior_snap_history_game_id"], payload)
    found = F.col("prior_snap_history_game_id").isNotNull()
    same = scalars.flag(F.col("prior_snap_history_team") == F.col("team"))

    def pick(column: str) -> Column:
        return F.when(same, F.col(f"team_{column}")).otherwise(F.col(f"career_{column}"))

    selected = {f"prior_{u}_snap_share_last_{n}": pick(f"{u}_snap_share_last_{n}") for u in ("offense", "defense", "special_teams") for n in ref.FORM_WINDOWS}
    selected |= {f"prior_snap_games_last_{n}": pick(f"games_last_{n}") for n in ref.FORM_WINDOWS}
    rows = rows.withColumns(selected | {
        "has_prior_snap_history": found, "prior_snap_history_same_team": same,
        "snap_history_source": F.when(~found, "NONE").when(same, "TEAM").otherwise("CAREER"),
        "days_since_prior_snap_history": F.datediff("gameday", "prior_snap_history_gameday"),
        "prior_career_appearance_count": F.col("career_appearance_count"), "prior_selected_appearance_count": pick("appearance_count"),
    })
    return rows.drop(*usage, *counts)


def injury_impact(context: DataFrame) -> DataFrame:
    """Severity times importance per reported player, split by unit."""
    practice = F.when(F.col("did_not_practice"), "DNP").when(F.col("limited_practice"), "LIMITED").when(F.col("full_practice"), "FULL")
    share = lambda unit: F.coalesce(F.col(f"prior_{unit}_snap_share_last_4"), F.lit(0.0))
    usage = F.when(F.col("has_prior_snap_history"), F.greatest(share("offense"), share("defense"), F.lit(0.25) * share("special_teams")))
    columns = scalars.impact_columns(F.col("report_status"), practice, F.col("depth_tier"), usage, F.col("prior_snap_games_last_4"), scalars.IMPACT_WEIGHTS)
    position = F.col("position")
    rows = context.withColumns({
        "observed_usage_score": usage, "availability_severity_score": columns["severity"], "player_importance_score": columns["importance"],
        "injury_impact_score": columns["impact"], "is_qb": position == "QB",
        "is_offensive_player": F.col("has_offense_role") | position.isin(*ref.OFFENSE_POSITIONS),
        "is_defensive_player": F.col("has_defense_role") | position.isin(*ref.DEFENSE_POSITIONS),
        "is_special_teams_player": F.col("has_special_teams_role") | position.isin(*ref.SPECIAL_POSITIONS),
    })
    impact, qb = F.col("injury_impact_score"), scalars.flag(F.col("is_qb"))
    split = lambda test: F.when(test, impact).otherwise(0.0)
    return rows.withColumns({
        "non_qb_injury_impact_score": split(~qb),
        "offense_injury_impact_score": split(~qb & F.col("is_offensive_player")),
        "defense_injury_impact_score": split(~qb & F.col("is_defensive_player")),
        "special_teams_injury_impact_score": split(F.col("is_special_teams_player")),
    })


_ZERO_COUNTS = {
    "game_status_player_count": lambda: F.col("report_status").isNotNull(), "out_player_count": lambda: F.col("is_out"),
    "doubtful_player_count": lambda: F.col("is_doubtful"), "questionable_player_count": lambda: F.col("is_questionable"),
    "did_not_practice_player_count": lambda: F.col("did_not_practice"), "limited_practice_player_count": lambda: F.col("limited_practice"),
    "full_practice_player_count": lambda: F.col("full_practice"),
    "starter_game_status_count": lambda: F.col("has_starter_role") & F.col("report_status").isNotNull(),
    "starter_out_count": lambda: F.col("has_starter_role") & F.col("is_out"),
    "qb_game_status_count": lambda: F.col("is_qb") & F.col("report_status").isNotNull(), "qb_out_count": lambda: F.col("is_qb") & F.col("is_out"),
    "non_qb_game_status_count": lambda: ~F.col("is_qb") & F.col("report_status").isNotNull(),
    "missing_depth_chart_count": lambda: ~F.col("has_depth_chart_match"), "missing_snap_history_count": lambda: ~F.col("has_prior_snap_history"),
    "career_snap_fallback_count": lambda: F.col("snap_history_source") == "CAREER",
}


def team_injury_burden(impact: DataFrame, schedule: DataFrame) -> DataFrame:
    """Burden of every scheduled team game of the covered seasons."""
    sides = joins.within_bounds(scheduled_sides(schedule), F.col("season"), impact, F.min("season"), F.max("season"))
    score = F.col("injury_impact_score")
    sums = {
        "availability_severity_sum": F.col("availability_severity_score"), "total_injury_burden": score,
        "qb_injury_burden": F.when(F.col("is_qb"), score).otherwise(0.0), "non_qb_injury_burden": F.col("non_qb_injury_impact_score"),
        "offense_injury_burden": F.col("offense_injury_impact_score"), "defense_injury_burden": F.col("defense_injury_impact_score"),
        "special_teams_injury_burden": F.col("special_teams_injury_impact_score"),
    }
    top = {"full_name": "name", "gsis_id": "gsis_id", "position": "position", "report_status": "status", "injury_impact_score": "score"}
    best = F.max_by(
        F.when(score > 0, F.struct(*top)), F.when(score > 0, F.struct(score.alias("s"), F.col("gsis_id").alias("g")))
    )
    burden = impact.groupBy("game_id", "team").agg(
        F.count(F.lit(1)).alias("injury_report_player_count"),
        *[aggregates.count_where(test()).alias(n) for n, test in _ZERO_COUNTS.items()],
        *[F.sum(c).alias(n) for n, c in sums.items()],
        F.avg(F.col("has_depth_chart_match").cast("double")).alias("depth_chart_match_rate"),
        F.avg(F.col("has_prior_snap_history").cast("double")).alias("snap_history_match_rate"),
        F.max(score).alias("maximum_player_injury_impact"),
        F.avg(F.when(F.col("report_status").isNotNull(), score)).alias("average_game_status_injury_impact"),
        best.alias("__top"),
    )
    burden = burden.select(
        *[c for c in burden.columns if c != "__top"], *[F.col(f"__top.{c}").alias(f"top_impact_player_{n}") for c, n in top.items()]
    )
    zeros = ["injury_report_player_count", *_ZERO_COUNTS, *sums]
    return joins.complete_left(sides, burden, ["game_id", "team"], zeros, "has_injury_report_data")


_DIFFERENCES = [
    "injury_report_player_count", "out_player_count", "doubtful_player_count", "questionable_player_count", "starter_out_count", "qb_out_count",
    "total_injury_burden", "qb_injury_burden", "non_qb_injury_burden", "offense_injury_burden", "defense_injury_burden", "special_teams_injury_burden",
]


def game_injury_features(burden: DataFrame) -> DataFrame:
    """Both sides of a game on one row, with home-minus-away differences."""
    values = ["team", "has_injury_report_data", *_DIFFERENCES]
    sides = aggregates.pivot_sides(
        burden.withColumn("__side", F.when(F.col("is_home"), "HOME").otherwise("AWAY")), SCHEDULE_KEYS, "__side", ["HOME", "AWAY"], values
    ).where("home_team IS NOT NULL AND away_team IS NOT NULL")
    return sides.withColumns(
        scalars.pair_features(_DIFFERENCES, ("diff",))
        | {"has_complete_injury_data": F.col("home_has_injury_report_data") & F.col("away_has_injury_report_data")}
    )
