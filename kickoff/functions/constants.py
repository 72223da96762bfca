"""Fixed values that must equal the reference's for identical results.

Kept together, as plain text, in their natural order.
"""

# --- fixed values: team-name aliases (whole value, applied before trimming) ---
TEAM_ALIASES = {
    "Real Madrid CF": "Real Madrid",
    "Real Madrid C.F.": "Real Madrid",
    "FC Barcelona": "Barcelona",
    "F.C. Barcelona": "Barcelona",
    "Atlético Madrid": "Atletico Madrid",
    "Atlético de Madrid": "Atletico Madrid",
    "Athletic Bilbao": "Athletic Club",
    "Athletic Club Bilbao": "Athletic Club",
    "Real Sociedad de Fútbol": "Real Sociedad",
    "Valencia CF": "Valencia",
    "Sevilla FC": "Sevilla",
    "Real Betis Balompié": "Real Betis",
    "Villarreal CF": "Villarreal",
    "RC Celta de Vigo": "Celta Vigo",
    "RCD Espanyol": "Espanyol",
    "RCD Espanyol de Barcelona": "Espanyol",
    "Deportivo Alavés": "Alaves",
    "Deportivo de La Coruña": "Deportivo La Coruna",
    "RC Deportivo": "Deportivo La Coruna",
    "UD Las Palmas": "Las Palmas",
    "CA Osasuna": "Osasuna",
    "Real Valladolid CF": "Real Valladolid",
    "SD Eibar": "Eibar",
    "Getafe CF": "Getafe",
    "CD Leganés": "Leganes",
    "Levante UD": "Levante",
    "Granada CF": "Granada",
    "Real Mallorca": "Mallorca",
    "RCD Mallorca": "Mallorca",
    "Cádiz CF": "Cadiz",
    "SD Huesca": "Huesca",
    "Elche CF": "Elche",
    "Real Zaragoza": "Zaragoza",
    "Racing de Santander": "Racing Santander",
    "Xerez CD": "Xerez",
    "CD Numancia": "Numancia",
}

# --- fixed values: venue aliases (applied after strip and null -> Unknown) ---
VENUE_ALIASES = {
    "Santiago Bernabéu": "Santiago Bernabeu",
    "Camp Nou": "Camp Nou",
    "Wanda Metropolitano": "Metropolitano",
    "Estadio de la Cerámica": "Estadio de la Ceramica",
    "San Mamés": "San Mames",
}
UNKNOWN_VENUE = "Unknown"
VENUE_SUFFIX = " Stadium"

# --- fixed values: Spanish month abbreviations rewritten by substring, in order ---
SPANISH_MONTHS = [
    ("ene", "jan"), ("feb", "feb"), ("mar", "mar"), ("abr", "apr"), ("may", "may"), ("jun", "jun"),
    ("jul", "jul"), ("ago", "aug"), ("sep", "sep"), ("oct", "oct"), ("nov", "nov"), ("dic", "dec"),
]
# Date formats tried in order (strptime %Y-%m-%d, %d/%m/%Y, %d %b %Y, %b %d, %Y, %d %B %Y, %B %d, %Y)
DATE_TEXT_FORMATS = ["y-M-d", "d/M/y", "d MMM y", "MMM d, y", "d MMMM y", "MMMM d, y"]

# --- fixed values: dash variants unified in score text ---
SCORE_DASHES = ["−", "–", ":", "‒", "—"]

# --- fixed values: result labels ---
RESULT_LABELS = {1: "Home Win", 0: "Draw", -1: "Away Win"}
UNKNOWN_RESULT = "Unknown"

# --- fixed values: scraped rows whose team text is a header word are skipped ---
HOME_HEADER_WORDS = ["home", "team", "date"]
AWAY_HEADER_WORDS = ["away", "team", "visitor"]

# --- fixed values: placeholder logo colours, used by row order modulo 6 ---
PALETTE = ["#e63946", "#457b9d", "#2a9d8f", "#ffb703", "#8d99ae", "#6a4c93"]
LOGO_PREFIX = "/assets/logos/"
LOGO_SUFFIX = ".svg"

# --- fixed values: columns removed by the tolerant drop ---
DROPPED_COLUMNS = ["home_goals", "away_goals", "score", "result", "venue", "year", "month", "day",
                   "day_of_week", "is_weekend", "goal_difference", "season_year"]

# --- fixed values: raw match CSV column order ---
RAW_COLUMNS = ["season", "date", "time", "home_team", "away_team", "home_goals", "away_goals",
               "score", "result", "venue", "attendance"]

# --- fixed values: month -> season part ---
MONTH_CATEGORY = {8: "early_season", 9: "early_season", 10: "early_season",
                  11: "mid_season", 12: "mid_season", 1: "mid_season",
                  2: "late_season", 3: "late_season", 4: "late_season", 5: "late_season"}

# --- fixed values: quality thresholds and defaults ---
LOW_SEASON_COUNT = 300
MIN_GOALS, MAX_GOALS = 0, 10
MAX_ATTENDANCE = 100000
DEFAULT_SEASON = 2024

# --- fixed values: feature defaults and parameters ---
ELO_K = 32
ELO_START = 1500.0
FORM_WINDOWS = [3, 5, 10]
H2H_MAX = 10
H2H_DEFAULTS = {"h2h_home_wins": 0.33, "h2h_away_wins": 0.33, "h2h_draws": 0.33,
                "h2h_home_goals_avg": 1.5, "h2h_away_goals_avg": 1.5, "h2h_total_goals_avg": 3.0,
                "h2h_matches_count": 0}
VENUE_HOME_DEFAULT = 0.5
VENUE_AWAY_DEFAULT = 0.3
RECENT_LEAGUE_MATCHES = 50
WIN_STREAK_SPAN = 10
UNBEATEN_STREAK_SPAN = 15
MOMENTUM_SPAN = 8
MOMENTUM_DECAY = 0.9
MOMENTUM_DEFAULT = 0.5
POSITION_DEFAULT = 10
PPG_DEFAULT = 1.5

# --- fixed values: evaluation parameters ---
TOLERANCES = [0.5, 1.0, 1.5]
SCORE_BANDS = [(0, 1), (2, 3), (4, 5), (6, 20)]
HIST_BINS = 20
CONFIDENCE_BINS = [(0.4, 0.6), (0.6, 0.8), (0.8, 0.9), (0.9, 1.0)]
CALIBRATION_EDGES = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
STRENGTH_BANDS = [("Close (0-3 positions)", 0, 3), ("Medium (4-8 positions)", 4, 8), ("Large (>8 positions)", 9, None)]
WEEKEND_LABELS = {1: "Weekend", 0: "Weekday"}
SCORING_LABELS = ("High Scoring", "Low Scoring")
TRAIN_FRACTION = 0.8
