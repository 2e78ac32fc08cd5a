"""A tiny invented league: schedule, plays, reports, charts, snaps and odds."""

from __future__ import annotations

import itertools
from datetime import date, datetime, timedelta

TEAMS = {"Arizona Cardinals": "ARI", "Buffalo Bills": "BUF", "Chicago Bears": "CHI", "Dallas Cowboys": "DAL"}
CODES = list(TEAMS.values())
SEASONS = (2018, 2019, 2020, 2023, 2025)


def rounds():
    """Six rounds: everybody plays everybody, home and away."""
    a, b, c, d = CODES
    half = [[(a, b), (c, d)], [(a, c), (b, d)], [(a, d), (b, c)]]
    return half + [[(y, x) for x, y in r] for r in half]


def schedule(rng, last_unplayed=True):
    rows = []
    for season in SEASONS:
        day = date(season, 9, 6)
        for week, games in enumerate(itertools.chain(rounds(), rounds()), start=1):
            for n, (home, away) in enumerate(games):
                done = not (last_unplayed and season == SEASONS[-1] and week > 11)
                rows.append({
                    "game_id": f"{season}_{week:02d}_{away}_{home}", "season": season, "game_type": "REG", "week": week,
                    "gameday": (day + timedelta(days=7 * (week - 1) + n)).isoformat(), "gametime": "13:00", "weekday": "Sunday",
                    "home_team": home, "away_team": away, "location": "Neutral" if rng.random() < 0.1 else "Home",
                    "home_score": rng.randint(3, 40) if done else None, "away_score": rng.randint(3, 40) if done else None,
                    "overtime": 0, "home_rest": rng.choice([4, 6, 7, 9, 13]), "away_rest": rng.choice([4, 6, 7, 9, 13]),
                    "away_moneyline": 120, "home_moneyline": -140, "spread_line": 2.5, "away_spread_odds": -110, "home_spread_odds": -110,
                    "total_line": 44.5, "under_odds": -110, "over_odds": -110, "roof": rng.choice(["dome", "outdoors", " Open ", ""]),
                    "surface": " Grass", "temp": rng.choice([20, 60, 90, None]), "wind": rng.choice([2, 16, None]),
                    "home_qb_id": f"QB-{home}" if done else None, "home_qb_name": f"Passer {home}" if done else None,
                    "away_qb_id": f"QB-{away}", "away_qb_name": f"Passer {away}", "away_coach": "x", "home_coach": "y", "referee": "z",
                    "stadium_id": "S1", "stadium": "Field",
                })
    return rows


SCHEDULE_TYPES = (
    "game_id string, season int, game_type string, week int, gameday string, gametime string, weekday string, home_team string, away_team string, "
    "location string, home_score int, away_score int, overtime int, home_rest int, away_rest int, away_moneyline int, home_moneyline int, "
    "spread_line double, away_spread_odds int, home_spread_odds int, total_line double, under_odds int, over_odds int, roof string, surface string, "
    "temp int, wind int, home_qb_id string, home_qb_name string, away_qb_id string, away_qb_name string, away_coach string, home_coach string, "
    "referee string, stadium_id string, stadium string"
)

PLAY_TYPES = (
    "game_id string, season int, season_type string, week int, game_date string, posteam string, defteam string, home_team string, away_team string, "
    "down int, yardline_100 int, wp double, play_type string, qb_dropback int, qb_scramble int, rush int, sack int, interception int, fumble_lost int, "
    "yards_gained int, epa double, success int, qb_kneel int, qb_spike int, aborted_play int, two_point_attempt int, special_teams_play int, "
    "passer_player_id string, passer_player_name string, rusher_player_id string, rusher_player_name string, pass_attempt int, complete_pass int, "
    "incomplete_pass int, passing_yards int, air_yards int, qb_hit int, cpoe double"
)


def plays(rng, games):
    rows = []
    for g in games:
        if g["home_score"] is None:
            continue
        for team, other in ((g["home_team"], g["away_team"]), (g["away_team"], g["home_team"])):
            for i in range(14):
                dropback = int(rng.random() < 0.6)
                scramble = int(dropback and rng.random() < 0.15)
                sack = int(dropback and not scramble and rng.random() < 0.15)
                throw = int(dropback and not scramble and not sack)
                done = int(throw and rng.random() < 0.6)
                passer = f"QB-{team}" if i < 11 else f"QB2-{team}"
                rows.append((
                    g["game_id"], g["season"], "REG", g["week"], g["gameday"], team, other, g["home_team"], g["away_team"],
                    rng.choice([1, 2, 3, None]), rng.randint(1, 99), rng.choice([0.05, 0.4, 0.7, None]), "pass" if dropback else "run", dropback, scramble,
                    int(not dropback or scramble), sack, int(throw and rng.random() < 0.1), int(rng.random() < 0.05), rng.randint(-5, 30),
                    None if i == 5 else round(rng.uniform(-2, 2), 3), rng.randint(0, 1), int(i == 6), None, 0, 0, int(i == 7),
                    passer if dropback else None, f"Passer {passer}" if dropback else None, passer if scramble else None, None,
                    throw, done, int(throw and not done), 9 if done else None, 8 if throw else None, int(rng.random() < 0.2), round(rng.uniform(-20, 20), 2) if throw else None,
                ))
    return rows


def reports(rng, games):
    rows = []
    for g in games:
        if g["season"] < 2019:
            continue
        for team in (g["home_team"], g["away_team"]):
            for p in range(3):
                for snap in range(rng.randint(1, 2)):
                    rows.append((
                        g["season"], "REG", g["game_type"], g["week"], team, f"G-{team}-{p}", ["QB", "WR", "CB"][p], f"Player {team} {p}", " knee ", "",
                        rng.choice(["Out", "Doubtful", " Questionable", "Note", None]), "knee", None,
                        rng.choice(["Did Not Participate In Practice", "Limited Participation in Practice", "Full Participation in Practice", "Rest", None]),
                        datetime(g["season"], 9, 1, snap) if rng.random() < 0.8 else None,
                    ))
    return rows


REPORT_TYPES = (
    "season int, season_type string, game_type string, week int, team string, gsis_id string, position string, full_name string, report_primary_injury string, "
    "report_secondary_injury string, report_status string, practice_primary_injury string, practice_secondary_injury string, practice_status string, date_modified timestamp"
)


def snaps(rng, games):
    rows = []
    for g in games:
        if g["home_score"] is None:
            continue
        for team, other in ((g["home_team"], g["away_team"]), (g["away_team"], g["home_team"])):
            for p in range(4):
                if rng.random() < 0.8:
                    rows.append((
                        g["game_id"], "P" + g["game_id"], g["season"], "REG", g["week"], f"Player {team} {p}", f"P-{team}-{p}", "WR", team, other,
                        float(rng.randint(0, 60)), rng.choice([0.0, 0.5, 1.01, None]), float(rng.randint(0, 60)), 0.25, 3.0, 0.1, "f.parquet",
                    ))
    return rows


SNAP_TYPES = (
    "game_id string, pfr_game_id string, season int, game_type string, week int, player string, pfr_player_id string, position string, team string, opponent string, "
    "offense_snaps double, offense_pct double, defense_snaps double, defense_pct double, st_snaps double, st_pct double, source_file string"
)


def directory():
    return [(f"G-{t}-{p}", f"P-{t}-{p}", f"E-{t}-{p}", f"Player {t} {p}", "OFF", "WR", "12", None, "ACT", 2025) for t in CODES for p in range(3)]


DIRECTORY_TYPES = (
    "gsis_id string, pfr_id string, espn_id string, display_name string, position_group string, position string, jersey_number string, headshot string, "
    "status string, last_season int"
)


def espn_charts(rng):
    rows = []
    for team in CODES:
        for stamp in ("2025-09-01T10:00:00Z", "2025-09-20T10:00:00Z", "2025-09-20T18:00:00Z"):
            for p in range(3):
                rows.append((2025, stamp, team, f" Player {team} {p}", f"E-{team}-{p}", f"G-{team}-{p}" if p else None, rng.choice(["Base 4-3 D", "3WR 1TE", "Special Teams"]),
                             "Quarterback", "QB" if p < 2 else "WR", p + 1, rng.randint(1, 3)))
    return rows


ESPN_TYPES = (
    "source_season int, dt string, team string, player_name string, espn_id string, gsis_id string, pos_grp string, pos_name string, pos_abb string, pos_slot int, pos_rank int"
)


def legacy_charts(rng, games):
    rows = []
    for g in games:
        if g["season"] >= 2025:
            continue
        for team in (g["home_team"], g["away_team"]):
            for p in range(3):
                rows.append((g["season"], g["game_type"], g["week"], team, f"G-{team}-{p}", f"Player {team} {p}", "WR", rng.choice(["Offense", "Defense"]), "WR", str(rng.randint(1, 3))))
    return rows


LEGACY_TYPES = "season int, game_type string, week int, club_code string, gsis_id string, full_name string, position string, formation string, depth_position string, depth_team string"


def odds(games):
    """Two snapshots of the unplayed games: three bookmakers, three markets."""
    names = {v: k for k, v in TEAMS.items()}
    out = []
    for s, hour in enumerate((1, 2)):
        events = []
        for g in games:
            if g["home_score"] is not None:
                continue
            home, away = names[g["home_team"]], names[g["away_team"]]
            books = []
            for b in range(3):
                shift = 5 * b + 3 * s
                books.append({"key": f"book{b}", "title": f"Book {b}", "last_update": "2025-10-01T00:00:00Z", "markets": [
                    {"key": "h2h", "outcomes": [{"name": home, "price": -130 - shift}, {"name": away, "price": 115 + shift}]},
                    {"key": "spreads", "outcomes": [{"name": home, "price": -110 + b * 20, "point": -3.0}, {"name": away, "price": -110, "point": 3.0}]},
                    {"key": "totals", "outcomes": [{"name": "Over", "price": -105 - shift, "point": 44.5}, {"name": "Under", "price": 60 if b == 2 else 101, "point": 44.5}]},
                ]})
            events.append({"id": "E" + g["game_id"], "sport_key": "football", "sport_title": "Football", "commence_time": f"{g['gameday']}T17:00:00Z",
                           "home_team": home, "away_team": away, "bookmakers": books})
        events.append({"id": "EX", "sport_key": "football", "sport_title": "Football", "commence_time": "2025-12-30T17:00:00Z", "home_team": "Nowhere Club", "away_team": away, "bookmakers": []})
        out.append({"metadata": {"fetched_at": f"2025-10-0{hour}T0{hour}:00:00Z", "sport_key": "football", "regions": "us", "markets": ["h2h", "spreads", "totals"],
                                 "odds_format": "american", "requests_remaining": 10, "requests_used": 5, "requests_last": 1}, "events": events})
    return out


def external(rng, games):
    rows = []
    for g in games:
        p = round(rng.uniform(0.3, 0.7), 3)
        rows.append((g["season"], g["week"], g["game_id"], g["home_team"], g["away_team"], 1500 + rng.uniform(-80, 80), 1500 + rng.uniform(-80, 80),
                     rng.uniform(-20, 20), rng.uniform(-20, 20), p if g["home_score"] is not None or rng.random() < 0.5 else None, datetime(2025, 10, 1)))
    return rows


EXTERNAL_TYPES = (
    "source_season int, source_week int, game_id string, home_team string, away_team string, home_rating double, away_rating double, "
    "home_qb_adjustment double, away_qb_adjustment double, published_home_probability double, source_fetched_at timestamp"
)
