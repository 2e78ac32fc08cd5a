"""Fixed values of the domain: team codes, thresholds and model settings."""

#: Odds-feed team names and schedule codes.
TEAM_CODES = {
    "Arizona Cardinals": "ARI", "Atlanta Falcons": "ATL", "Baltimore Ravens": "BAL", "Buffalo Bills": "BUF",
    "Carolina Panthers": "CAR", "Chicago Bears": "CHI", "Cincinnati Bengals": "CIN", "Cleveland Browns": "CLE",
    "Dallas Cowboys": "DAL", "Denver Broncos": "DEN", "Detroit Lions": "DET", "Green Bay Packers": "GB",
    "Houston Texans": "HOU", "Indianapolis Colts": "IND", "Jacksonville Jaguars": "JAX", "Kansas City Chiefs": "KC",
    "Las Vegas Raiders": "LV", "Los Angeles Chargers": "LAC", "Los Angeles Rams": "LA", "Miami Dolphins": "MIA",
    "Minnesota Vikings": "MIN", "New England Patriots": "NE", "New Orleans Saints": "NO", "New York Giants": "NYG",
    "New York Jets": "NYJ", "Philadelphia Eagles": "PHI", "Pittsburgh Steelers": "PIT", "San Francisco 49ers": "SF",
    "Seattle Seahawks": "SEA", "Tampa Bay Buccaneers": "TB", "Tennessee Titans": "TEN", "Washington Commanders": "WAS",
}

#: Moved franchises and their current codes.
FRANCHISES = {"LAR": "LA", "OAK": "LV", "SD": "LAC", "STL": "LA"}

#: Zone that fixes a game's calendar date.
GAME_ZONE = "America/New_York"

#: Rest thresholds in days.
SHORT_WEEK, EXTENDED_REST, POST_BYE = 6, 9, 13

#: Venue categories and weather knots.
INDOOR_ROOFS = ("dome", "closed")
EXPOSED_ROOFS = ("outdoors", "open")
NEUTRAL_TEMPERATURE, NEUTRAL_WIND = 65.0, 0.0
FREEZING, HIGH_WIND, EXTREME_HEAT = 32.0, 15.0, 85.0
COLD_KNOT, HEAT_KNOT, WIND_KNOT = 50.0, 80.0, 10.0

#: League scoring windows, team form windows.
SCORING_WINDOWS = (32, 64, 128)
FORM_WINDOWS = (4, 8)

#: Passer rating settings.
PASSER_HALF_LIFE_DAYS, PASSER_PRIOR = 365.0, 200.0

#: Seasons of the model splits.
TRAIN_SEASONS, VALIDATION_SEASONS, HOLDOUT_SEASON = (2018, 2022), (2023, 2024), 2025

#: Production routing.
PRIMARY_WEIGHT, PUBLISHED_WEIGHT = 0.70, 0.30

#: Availability statuses.
REPORT_STATUSES = ("Out", "Doubtful", "Questionable")
PRACTICE_STATUSES = {
    "Did Not Participate In Practice": "DNP",
    "Limited Participation in Practice": "LIMITED",
    "Full Participation in Practice": "FULL",
}

#: Positions by unit.
OFFENSE_POSITIONS = ("QB", "RB", "FB", "WR", "TE", "T", "OT", "G", "OG", "C", "OL")
DEFENSE_POSITIONS = ("DE", "DT", "DL", "NT", "LB", "ILB", "OLB", "DB", "CB", "S", "FS", "SS")
SPECIAL_POSITIONS = ("K", "PK", "P", "LS")

#: Metrics averaged over earlier games.
FORM_METRICS = (
    "offensive_plays", "points_scored", "points_allowed", "offensive_epa_per_play", "competitive_epa_per_play",
    "dropback_epa_per_play", "designed_rush_epa_per_play", "early_down_epa_per_play", "success_rate",
    "explosive_play_rate", "sack_rate", "turnover_rate", "defensive_epa_allowed_per_play",
    "competitive_defensive_epa_allowed_per_play", "defensive_success_rate_allowed", "explosive_play_rate_allowed",
    "sack_rate_generated", "turnover_rate_generated",
)
