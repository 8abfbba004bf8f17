"""Names, horizons and thresholds every operator falls back to."""

# Funnel steps in order, the goal step and every known event name.
STEPS = ("signup", "activate", "first_search", "add_to_cart", "purchase")
GOAL = "purchase"
EVENT_NAMES = ("signup", "activate", "first_search", "add_to_cart", "purchase", "session_start")

# Acquisition channels and client platforms.
CHANNELS = ("organic", "paid_search", "social", "referral", "email")
PLATFORMS = ("ios", "android", "web")

# Hours added to a platform whose clients stamp local time.
CLOCK_SHIFT_HOURS = {"ios": 8}

# Columns of an event, and the key a repeated beacon shares with its original.
EVENT_COLUMNS = ("event_id", "user_id", "event_name", "event_ts", "channel", "platform", "revenue")
NATURAL_KEY = ("user_id", "event_name", "event_ts")

# A session ends after this many minutes without an event.
GAP_MINUTES = 30

# Retention horizons in days, and which of them are reported as rates.
EXACT_DAYS = (1, 7)
PLUS_DAYS = (1, 7, 30)
RETENTION_RATES = {"d1_exact": 1, "d7_plus": 7, "d30_plus": 30}
ELIGIBLE_DAYS = (1, 30)
WEEK_ONE_DAYS = 7
CURVE_DAYS = 30

# The two channels compared, and the confidence level.
SEGMENT_A = "organic"
SEGMENT_B = "paid_search"
ALPHA = 0.05
POWER = 0.80

# Share of lost users assumed to come back, per scenario.
SCENARIOS = {"conservative": 0.05, "central": 0.10, "optimistic": 0.20}

# Hour-of-day check, groups above so many rows may differ by so many hours.
SKEW_MIN_ROWS = 1000
SKEW_MAX_HOURS = 3.0

# The busiest hour of the day has more than so many times the events of the quietest.
PROFILE_TIMES = 3

# Bands the audit rates must lie in, both ends excluded.
DUPLICATE_RATE_BAND = (0.012, 0.018)
NULL_USER_RATE_BAND = (0.003, 0.005)

# Expected step rates, channel multipliers, cap and tolerance.
STEP_RATES = {"activate": 0.72, "first_search": 0.81, "add_to_cart": 0.46, "purchase": 0.58}
CHANNEL_MULTIPLIERS = {
    "organic": 1.18,
    "paid_search": 0.78,
    "social": 0.85,
    "referral": 1.25,
    "email": 1.10,
}
RATE_CAP = 0.99
RATE_TOLERANCE = 0.025
