"""Fixed values. Results depend on these exact texts, numbers and orders; do not edit."""

# Position codes and their labels.
POSITIONS = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}

# Legal formations in order of preference: (name, defenders, midfielders, forwards); one keeper always.
FORMATIONS = [
    ("3-4-3", 3, 4, 3),
    ("3-5-2", 3, 5, 2),
    ("4-3-3", 4, 3, 3),
    ("4-4-2", 4, 4, 2),
    ("4-5-1", 4, 5, 1),
    ("5-3-2", 5, 3, 2),
    ("5-4-1", 5, 4, 1),
]
FALLBACK_FORMATION = ("4-4-2", 4, 4, 2)
TEAM_SIZE = 11

# Model features in vector order.
FEATURES = [
    "points_per_game", "form_normalized", "minutes_per_game",
    "goals_per_90", "assists_per_90", "bonus_per_90",
    "influence", "creativity", "threat", "ict_index",
    "expected_goals", "expected_assists", "expected_goal_involvements",
    "clean_sheets_per_90", "saves_per_90", "goals_conceded_per_90",
    "selected_by_percent", "transfer_momentum", "value_indicator",
    "minutes_reliability", "consistency_score", "recent_form_trend",
    "opponent_difficulty", "difficulty_adjustment", "is_home",
    "chance_of_playing_next_round", "chance_of_playing_this_round",
]

# Fields that arrive as numeric text and are filled with 0 when they cannot be read.
NUMERIC_FIELDS = [
    "form", "now_cost", "total_points", "points_per_game", "expected_goals",
    "minutes", "assists", "goals_scored", "yellow_cards", "red_cards",
    "bonus", "saves_per_90", "clean_sheets", "influence_rank", "threat_rank",
    "influence", "creativity", "threat", "ict_index",
    "expected_assists", "expected_goal_involvements",
]

# Columns of a published snapshot, in order.
SNAPSHOT_COLUMNS = [
    "name", "team", "position", "next_opponent", "fixture", "predicted_points",
    "now_cost", "points_per_game", "form", "expected_goals",
    "minutes", "assists", "goals_scored", "yellow_cards",
    "red_cards", "saves_per_90", "total_points", "clean_sheets",
    "opponent_difficulty", "is_home", "chance_of_playing_this_round",
    "player_code", "web_name", "display_name",
    "image_url_primary", "image_url_secondary", "image_url_tertiary",
]

# Columns that are read as numbers before sorting.
NUMERIC_SORT_COLUMNS = [
    "predicted_points", "now_cost", "points_per_game", "form", "total_points",
    "minutes", "expected_goals", "assists", "goals_scored", "yellow_cards",
    "red_cards", "saves_per_90", "clean_sheets", "opponent_difficulty",
    "chance_of_playing_this_round",
]

# Display catalogue: (key, label, type, decimals).
COLUMN_CATALOGUE = [
    ("name", "Player", "text", None),
    ("team", "Team", "text", None),
    ("position", "Pos", "text", None),
    ("next_opponent", "Opponent", "text", None),
    ("predicted_points", "Pred Pts", "number", 1),
    ("now_cost", "Price", "number", 1),
    ("points_per_game", "PPG", "number", 1),
    ("form", "Form", "number", 1),
    ("total_points", "Total Pts", "number", None),
    ("minutes", "Minutes", "number", None),
    ("goals_scored", "Goals", "number", None),
    ("assists", "Assists", "number", None),
    ("expected_goals", "xG", "number", 2),
    ("clean_sheets", "CS", "number", None),
    ("saves_per_90", "Saves/90", "number", 1),
    ("yellow_cards", "YC", "number", None),
    ("red_cards", "RC", "number", None),
    ("opponent_difficulty", "Opp Diff", "number", None),
    ("is_home", "H/A", "boolean", None),
    ("chance_of_playing_this_round", "Play %", "number", None),
]
DEFAULT_VISIBLE = [
    "name", "team", "position", "next_opponent", "predicted_points",
    "now_cost", "points_per_game", "form", "total_points", "minutes",
]

# Position -> (background, text) colours.
POSITION_COLOURS = {
    "GKP": ("f56565", "ffffff"),
    "DEF": ("38a169", "ffffff"),
    "MID": ("3182ce", "ffffff"),
    "FWD": ("d69e2e", "ffffff"),
}
DEFAULT_COLOURS = ("718096", "ffffff")

# Tier floors, highest first.
TIERS = [(8.0, "special"), (6.0, "gold"), (4.0, "silver")]
LOWEST_TIER = "bronze"

# Image address parts around the entity code.
PRIMARY_IMAGE = (
    "https://images.weserv.nl/?url=resources.premierleague.com/premierleague/photos/players/250x250/p",
    ".png&w=250&h=250&fit=cover&a=attention",
)
SECONDARY_IMAGE = ("https://resources.premierleague.com/premierleague/photos/players/110x140/p", ".png")
TERTIARY_IMAGE = ("https://fantasy.premierleague.com/dist/img/shirts/standard/shirt_", ".png")
AVATAR_ADDRESS = "https://api.dicebear.com/7.x/initials/svg?seed="

# Numeric settings of the scoring job.
HOME_FACTOR = 1.1
DEFAULT_DIFFICULTY = 3
ACTIVE_MINUTES = 45
ACTIVE_MINIMUM_ROWS = 100
RELIABLE_MINUTES = 450
POINTS_SCALE = 0.6
MISSING_OPPONENT = "No fixture"
