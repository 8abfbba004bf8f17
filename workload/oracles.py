"""SQL equivalents of the registered queries, for DuckDB on the same parquet tables."""

# The funnel's steps in order.
STEPS = ("signup", "activate", "first_search", "add_to_cart", "purchase")
STEP_VALUES = "(VALUES " + ", ".join(f"('{step}', {i})" for i, step in enumerate(STEPS, 1)) + ")"
EVENT_COLUMNS = (
    "event_id, user_id, event_name, event_ts, event_date, channel, platform, "
    "CAST(revenue AS DOUBLE) AS revenue"
)
P975 = "1.9599639845400536"  # normal quantile at 0.975
P80 = "0.8416212335729144"  # normal quantile at 0.80


def _raw(grain: str) -> str:
    user = {
        "customer": "e.user_id",
        "device": "e.user_id * 100 + CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT) // 5",
    }[grain]
    return f"""
    tagged AS (
      SELECT e.event_id, e.event_type AS kind, e.value,
             CASE WHEN e.value < 0.18 OR e.value > 350 THEN NULL ELSE {user} END AS user_id,
             CASE WHEN extract(hour FROM e.ts) < 12 THEN e.ts + INTERVAL 12 HOUR ELSE e.ts END AS ts,
             CASE WHEN c.c_nationkey < 9 THEN 'ios' WHEN c.c_nationkey < 17 THEN 'android' ELSE 'web' END AS platform,
             CASE c.c_mktsegment WHEN 'BUILDING' THEN 'organic' WHEN 'AUTOMOBILE' THEN 'paid_search'
               WHEN 'MACHINERY' THEN 'social' WHEN 'HOUSEHOLD' THEN 'referral' ELSE 'email' END AS home,
             CASE WHEN e.event_type = 'signup' THEN 'signup' WHEN e.event_type = 'view' THEN 'activate'
               WHEN e.event_type = 'click' THEN 'first_search'
               WHEN e.event_type = 'error' AND e.value >= 20 THEN 'add_to_cart'
               WHEN e.event_type = 'purchase' AND e.value >= 35 THEN 'purchase'
               ELSE 'session_start' END AS event_name
      FROM events e JOIN customer c ON c.c_custkey = e.user_id
    ),
    raw_events AS (
      SELECT t.event_id * 2 + beacon.copy AS event_id, t.user_id, t.event_name,
             CASE t.platform WHEN 'ios' THEN t.ts - INTERVAL 8 HOUR ELSE t.ts END AS event_ts,
             CASE WHEN t.kind = 'click' THEN 'paid_search' WHEN t.kind = 'error' AND t.value >= 100 THEN NULL
               ELSE t.home END AS channel,
             t.platform,
             CAST(CASE WHEN t.event_name = 'purchase' THEN t.value ELSE 0 END AS DECIMAL(18, 2)) AS revenue
      FROM tagged t JOIN (VALUES (0), (1)) AS beacon(copy) ON beacon.copy = 0 OR t.value >= 210
    )"""


CLEAN = """
    stg AS (
      SELECT DISTINCT ON (user_id, event_name, event_ts) *, CAST(event_ts AS DATE) AS event_date
      FROM (
        SELECT * REPLACE (CASE platform WHEN 'ios' THEN event_ts + INTERVAL 8 HOUR ELSE event_ts END AS event_ts)
        FROM raw_events WHERE user_id IS NOT NULL
      )
      ORDER BY user_id, event_name, event_ts, event_id
    )"""
DIRTY = """
    stg AS (SELECT *, CAST(event_ts AS DATE) AS event_date FROM raw_events)"""

USERS = """
    users AS (
      SELECT DISTINCT ON (user_id) user_id, event_ts AS signup_ts, event_date AS signup_date,
             CAST(date_trunc('week', event_ts) AS TIMESTAMP) AS signup_week, channel, platform
      FROM stg ORDER BY user_id, event_ts, event_id
    )"""

NUMBERED = """
    marked AS (
      SELECT *, coalesce(date_diff('minute', lag(event_ts) OVER timeline, event_ts), 31) > 30 AS opens
      FROM stg WINDOW timeline AS (PARTITION BY user_id ORDER BY event_ts, event_id)
    ),
    numbered AS (
      SELECT *, count(*) FILTER (WHERE opens) OVER (
        PARTITION BY user_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS session_index
      FROM marked
    )"""

SESSIONS = (
    NUMBERED
    + """,
    sessions AS (
      SELECT user_id, CAST(user_id AS VARCHAR) || '_s' || CAST(session_index AS VARCHAR) AS session_id,
             session_index, min(event_ts) AS session_start, max(event_ts) AS session_end,
             date_diff('second', min(event_ts), max(event_ts)) AS session_seconds,
             count(*) AS event_count, CAST(sum(revenue) AS DOUBLE) AS session_revenue,
             CAST(count(*) FILTER (WHERE event_name = 'purchase') > 0 AS INTEGER) AS converted
      FROM numbered GROUP BY user_id, session_index
    )"""
)

FUNNEL = f"""
    buyers AS (
      SELECT CAST(sum(revenue) AS DOUBLE) / nullif(count(DISTINCT user_id), 0) AS each FROM stg
      WHERE user_id IN (SELECT user_id FROM stg WHERE event_name = 'purchase')
    ),
    reach AS (
      SELECT s.i AS step_index, s.step, count(DISTINCT stg.user_id) AS n
      FROM {STEP_VALUES} AS s(step, i) JOIN stg ON stg.event_name = s.step GROUP BY s.i, s.step
    ),
    neighbours AS (
      SELECT *, lag(n) OVER (ORDER BY step_index) AS before, first(n) OVER (ORDER BY step_index) AS top FROM reach
    ),
    funnel AS (
      SELECT step_index, step, n AS users_reached, before AS users_previous_step,
             round(CAST(n AS DOUBLE) / nullif(before, 0), 4) AS step_conversion,
             round(CAST(n AS DOUBLE) / nullif(top, 0), 4) AS cumulative_conversion,
             before - n AS users_lost,
             round((before - n) * buyers.each, 2) AS max_recoverable_revenue
      FROM neighbours LEFT JOIN buyers ON TRUE
    )"""

BY_CHANNEL = f"""
    channel_reach AS (
      SELECT u.channel, s.i AS step_index, s.step, count(DISTINCT u.user_id) AS users_reached
      FROM users u JOIN stg USING (user_id) JOIN {STEP_VALUES} AS s(step, i) ON s.step = stg.event_name
      GROUP BY u.channel, s.i, s.step
    ),
    channel_funnel AS (
      SELECT *, CAST(users_reached AS DOUBLE)
                / lag(users_reached) OVER (PARTITION BY channel ORDER BY step_index) AS step_conversion
      FROM channel_reach
    )"""

COHORTS = """
    visits AS (
      SELECT u.user_id, u.signup_date, u.channel, stg.event_date - u.signup_date AS day
      FROM users u JOIN stg USING (user_id)
    ),
    cohorts AS (
      SELECT signup_date, channel, count(DISTINCT user_id) AS cohort_users FROM users GROUP BY ALL
    ),
    cohort_counts AS (
      SELECT c.signup_date, c.channel, any_value(c.cohort_users) AS cohort_users,
             count(DISTINCT user_id) FILTER (WHERE day = 1) AS d1_exact,
             count(DISTINCT user_id) FILTER (WHERE day = 7) AS d7_exact,
             count(DISTINCT user_id) FILTER (WHERE day >= 1) AS d1_plus,
             count(DISTINCT user_id) FILTER (WHERE day >= 7) AS d7_plus,
             count(DISTINCT user_id) FILTER (WHERE day >= 20) AS d20_plus,
             count(DISTINCT user_id) FILTER (WHERE day >= 30) AS d30_plus
      FROM cohorts c LEFT JOIN visits v ON v.signup_date = c.signup_date AND v.channel = c.channel
      GROUP BY c.signup_date, c.channel
    )"""

RETENTION = (
    COHORTS
    + """,
    retention AS (
      SELECT *, round(CAST(d1_exact AS DOUBLE) / nullif(cohort_users, 0), 4) AS d1_exact_rate,
             round(CAST(d7_exact AS DOUBLE) / nullif(cohort_users, 0), 4) AS d7_exact_rate,
             round(CAST(d7_plus AS DOUBLE) / nullif(cohort_users, 0), 4) AS d7_plus_rate,
             round(CAST(d20_plus AS DOUBLE) / nullif(cohort_users, 0), 4) AS d20_plus_rate,
             round(CAST(d30_plus AS DOUBLE) / nullif(cohort_users, 0), 4) AS d30_plus_rate
      FROM cohort_counts
    )"""
)


def _segment_rate(count: str, day: int) -> str:
    old = f"FILTER (WHERE age >= {day})"
    return (
        f"round(CAST(sum({count}) {old} AS DOUBLE) / nullif(sum(cohort_users) {old}, 0), 4) AS {count}_rate"
    )


def _eligible(day: int) -> str:
    return f"CAST(sum(cohort_users) FILTER (WHERE age >= {day}) AS BIGINT) AS eligible_d{day}"


OVERCOUNTED = """
    overcounted AS (
      SELECT c.signup_date, c.channel, any_value(c.cohort_users) AS cohort_users,
             count(*) FILTER (WHERE day >= 1) AS d1_plus, count(*) FILTER (WHERE day >= 7) AS d7_plus,
             count(*) FILTER (WHERE day >= 30) AS d30_plus
      FROM cohorts c JOIN visits v ON v.signup_date = c.signup_date AND v.channel = c.channel
      GROUP BY c.signup_date, c.channel
    )"""

AGED = """
    aged AS (
      SELECT *, (SELECT max(event_date) FROM stg) - signup_date AS age FROM cohort_counts
    )"""

LAST_DAYS = """
    last_days AS (SELECT user_id, channel, max(day) AS last_day FROM visits GROUP BY user_id, channel)"""
DROPOFF = """count(*) AS users, count(*) FILTER (WHERE last_day < 7) AS lost_in_week_one,
           round(CAST(count(*) FILTER (WHERE last_day < 7) AS DOUBLE) / nullif(count(*), 0), 4) AS week_one_loss_rate
      FROM last_days"""

PROPORTIONS = f"""
    arms AS (
      SELECT count(*) FILTER (WHERE channel = 'organic') AS n1, count(*) FILTER (WHERE channel = 'paid_search') AS n2,
             count(*) FILTER (WHERE channel = 'organic' AND bought) AS x1,
             count(*) FILTER (WHERE channel = 'paid_search' AND bought) AS x2
      FROM (SELECT channel, user_id IN (SELECT user_id FROM stg WHERE event_name = 'purchase') AS bought FROM users)
    ),
    shares AS (
      SELECT *, CAST(x1 AS DOUBLE) / n1 AS p1, CAST(x2 AS DOUBLE) / n2 AS p2,
             CAST(x1 + x2 AS DOUBLE) / (n1 + n2) AS p FROM arms
    ),
    scored AS (
      SELECT *, p2 - p1 AS d, (p2 - p1) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)) AS z,
             {P975} * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS half
      FROM shares
    ),
    tail AS (
      -- Simpson's rule over 12 standard deviations beyond |z|, in 4000 steps
      SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                 * exp(-power(abs(z) + i * 0.003, 2) / 2)) * 0.003 / 3 / sqrt(2 * pi()) * 2 AS p_value
      FROM scored, generate_series(0, 4000) AS points(i)
    ),
    comparison AS (
      SELECT p1 AS organic_rate, p2 AS paid_search_rate, d AS absolute_difference, d / p1 AS relative_difference,
             d - half AS ci_low, d + half AS ci_high, z, p_value, n1 AS n_organic, n2 AS n_paid_search
      FROM scored, tail
    )"""

OPPORTUNITY = """
    worst AS (
      SELECT * FROM funnel WHERE users_previous_step IS NOT NULL ORDER BY users_lost DESC, step_index LIMIT 1
    ),
    sizing AS (
      SELECT s.scenario, s.rate, worst.*, buyers.each AS arpu, worst.users_lost * s.rate AS back,
             CAST((SELECT users_reached FROM funnel ORDER BY step_index DESC LIMIT 1) AS DOUBLE)
               / worst.users_reached AS downstream
      FROM worst, buyers,
           (VALUES ('conservative', CAST(0.05 AS DOUBLE)), ('central', CAST(0.10 AS DOUBLE)),
                   ('optimistic', CAST(0.20 AS DOUBLE))) AS s(scenario, rate)
    ),
    opportunity AS (
      SELECT scenario, rate AS recovery_rate_assumed, CAST(round_even(back, 0) AS BIGINT) AS users_recovered,
             CAST(round_even(back * downstream, 0) AS BIGINT) AS incremental_purchasers,
             round_even(back * downstream * arpu, 2) AS incremental_revenue, step AS worst_step,
             users_lost AS users_lost_at_worst_step, step_conversion, arpu AS arpu_per_purchaser,
             downstream AS downstream_purchase_rate
      FROM sizing
    )"""

AUDIT = """
    removed AS (
      SELECT count(*) AS raw_rows, count(*) FILTER (WHERE user_id IS NULL) AS null_user_rows,
             count(*) FILTER (WHERE user_id IS NOT NULL)
               - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_name, event_ts FROM raw_events
                                        WHERE user_id IS NOT NULL)) AS duplicate_rows
      FROM raw_events
    ),
    kept AS (SELECT count(*) AS clean_rows, count(DISTINCT user_id) AS clean_users FROM stg),
    audit AS (
      SELECT raw_rows, clean_rows, raw_rows - clean_rows AS rows_removed, duplicate_rows,
             round(CAST(duplicate_rows AS DOUBLE) / nullif(raw_rows, 0), 5) AS duplicate_rate, null_user_rows,
             round(CAST(null_user_rows AS DOUBLE) / nullif(raw_rows, 0), 5) AS null_user_rate, clean_users
      FROM removed, kept
    )"""

HOURS = """
    hours AS (
      SELECT platform, count(*) AS n,
             (degrees(atan2(avg(sin(radians(15 * hour(event_ts)))), avg(cos(radians(15 * hour(event_ts)))))) / 15 + 24)
               % 24 AS mean_hour
      FROM stg GROUP BY platform
    ),
    skew AS (
      SELECT a.platform AS platform_a, b.platform AS platform_b, round(a.mean_hour, 2) AS mean_hour_a,
             round(b.mean_hour, 2) AS mean_hour_b,
             round(12 - abs(12 - abs(a.mean_hour - b.mean_hour)), 2) AS hours_apart
      FROM hours a JOIN hours b ON a.platform < b.platform WHERE a.n > 1000 AND b.n > 1000
    )"""

HOURLY = """
    profile AS (
      SELECT min(n) AS least, max(n) AS most FROM (
        SELECT h, count(event_ts) AS n FROM range(24) AS hours(h) LEFT JOIN stg ON hour(event_ts) = h GROUP BY h)
    )"""

BEFORE_SIGNUP = """
    early AS (
      SELECT user_id, min(event_ts) FILTER (WHERE event_name = 'signup') AS signup_ts, min(event_ts) AS first_ts
      FROM stg WHERE user_id IS NOT NULL GROUP BY user_id
    )"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _device(*parts: str, select: str) -> str:
    return _with(_raw("device"), CLEAN, *parts, select=select)


def _customer(*parts: str, select: str, stage: str = CLEAN) -> str:
    return _with(_raw("customer"), stage, *parts, select=select)


# The columns declared unique or present.
UNIQUE = (
    ("raw_events", "event_id"),
    ("stg_events", "event_id"),
    ("stg_users", "user_id"),
    ("mart_sessions", "session_id"),
    ("mart_funnel", "step"),
)
PRESENT = (
    ("raw_events", "event_id"),
    ("raw_events", "event_ts"),
    ("stg_events", "event_id"),
    ("stg_events", "user_id"),
    ("stg_events", "event_name"),
    ("stg_events", "event_ts"),
    ("stg_users", "user_id"),
    ("stg_users", "signup_ts"),
    ("stg_users", "channel"),
    ("mart_sessions", "session_id"),
    ("mart_sessions", "user_id"),
    ("mart_funnel", "step"),
    ("mart_retention", "cohort_users"),
)


def _suite(stage: str) -> str:
    checks = {
        "no_duplicate_events": "SELECT 1 FROM stg GROUP BY user_id, event_name, event_ts HAVING count(*) > 1",
        "no_null_user_ids": "SELECT 1 FROM stg WHERE user_id IS NULL LIMIT 1",
        "no_platform_hour_skew": "SELECT platform_a FROM skew WHERE hours_apart > 3 "
        "UNION SELECT platform_b FROM skew WHERE hours_apart > 3",
        "funnel_is_monotonic": "SELECT 1 FROM funnel WHERE users_lost < 0",
        "retention_within_cohort": "SELECT 1 FROM cohort_counts WHERE greatest(d1_plus, d7_plus, d30_plus) > cohort_users",
        "signup_is_first_event": "SELECT 1 FROM early WHERE first_ts < signup_ts",
        "session_users_exist": "SELECT user_id FROM sessions WHERE user_id NOT IN "
        "(SELECT user_id FROM users WHERE user_id IS NOT NULL)",
    }
    accepted = {
        "stg_events.event_name": "'signup', 'activate', 'first_search', 'add_to_cart', 'purchase', 'session_start'",
        "stg_events.platform": "'ios', 'android', 'web'",
        "stg_users.channel": "'organic', 'paid_search', 'social', 'referral', 'email'",
    }
    source = {
        "raw_events": "raw_events",
        "stg_events": "stg",
        "stg_users": "users",
        "mart_sessions": "sessions",
        "mart_funnel": "funnel",
        "mart_retention": "cohort_counts",
    }
    for table, column in UNIQUE:
        checks[f"unique_{table}_{column}"] = (
            f"SELECT {column} FROM {source[table]} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1"
        )
    for table, column in PRESENT:
        checks[f"not_null_{table}_{column}"] = f"SELECT 1 FROM {source[table]} WHERE {column} IS NULL"
    for name, values in accepted.items():
        table, column = name.split(".")
        checks[f"accepted_{table}_{column}"] = (
            f"SELECT DISTINCT {column} FROM {source[table]} WHERE {column} NOT IN ({values})"
        )
    counts = [
        f"SELECT '{name}' AS name, (SELECT count(*) FROM ({sql})) AS failed_rows"
        for name, sql in checks.items()
    ]
    return _customer(
        USERS, SESSIONS, FUNNEL, COHORTS, HOURS, BEFORE_SIGNUP,
        select="\nUNION ALL\n".join(counts),
        stage=stage,
    )


def _section(section: str, source: str, item: str, metrics: str) -> str:
    names = metrics.split()
    labels = ", ".join(f"'{m}'" for m in names)
    values = ", ".join(f"round(CAST({m} AS DOUBLE), 6)" for m in names)
    return (
        f"SELECT '{section}' AS section, CAST({item} AS VARCHAR) AS item, "
        f"unnest([{labels}]) AS metric, unnest([{values}]) AS value FROM {source}"
    )


REPORT = _device(
    USERS, FUNNEL, COHORTS, AGED, LAST_DAYS, PROPORTIONS, OPPORTUNITY, AUDIT,
    f"""
    by_channel AS (
      SELECT channel, sum(cohort_users) AS users_all_cohorts, {_eligible(1)}, {_segment_rate("d1_exact", 1)},
             {_segment_rate("d7_plus", 7)}, {_eligible(30)}, {_segment_rate("d30_plus", 30)}
      FROM aged GROUP BY channel
    ),
    loss AS (SELECT {DROPOFF})""",
    select="\nUNION ALL\n".join(
        [
            _section(
                "funnel", "funnel", "step",
                "step_index users_reached users_previous_step step_conversion cumulative_conversion "
                "users_lost max_recoverable_revenue",
            ),
            _section(
                "retention_by_channel", "by_channel", "channel",
                "users_all_cohorts eligible_d1 eligible_d30 d1_exact_rate d7_plus_rate d30_plus_rate",
            ),
            _section("week_one", "loss", "NULL", "users lost_in_week_one week_one_loss_rate"),
            _section(
                "channel_comparison", "comparison", "NULL",
                "organic_rate paid_search_rate absolute_difference relative_difference ci_low ci_high z p_value "
                "n_organic n_paid_search",
            ),
            _section(
                "opportunity", "opportunity", "scenario",
                "recovery_rate_assumed users_recovered incremental_purchasers incremental_revenue "
                "users_lost_at_worst_step step_conversion arpu_per_purchaser downstream_purchase_rate",
            ),
            _section(
                "data_quality", "audit", "NULL",
                "raw_rows clean_rows rows_removed duplicate_rows duplicate_rate null_user_rows null_user_rate "
                "clean_users",
            ),
        ]
    ),
)

SLICE = """SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM stg
    WHERE event_date = DATE '2024-01-15'"""

MANY_STEPS = """
WITH stg AS (SELECT user_id, regexp_extract(props, '[0-9]+') AS event_name, value FROM events),
reach AS (
  SELECT CAST(event_name AS INTEGER) AS i, event_name AS step, count(DISTINCT user_id) AS n
  FROM stg WHERE user_id IS NOT NULL GROUP BY event_name
),
neighbours AS (SELECT *, lag(n) OVER (ORDER BY i) AS before, first(n) OVER (ORDER BY i) AS top FROM reach)
SELECT i + 1 AS step_index, step, n AS users_reached, before AS users_previous_step,
       round(CAST(n AS DOUBLE) / nullif(before, 0), 4) AS step_conversion,
       round(CAST(n AS DOUBLE) / nullif(top, 0), 4) AS cumulative_conversion, before - n AS users_lost
FROM neighbours
"""

ORACLES = {
    "funnel_many_steps": MANY_STEPS,
    "stg_events": _customer(select=f"SELECT {EVENT_COLUMNS} FROM stg"),
    "stg_events_raw": _customer(select=f"SELECT {EVENT_COLUMNS} FROM stg", stage=DIRTY),
    "stg_users": _device(USERS, select="SELECT * FROM users"),
    "sessionise": _customer(NUMBERED, select=f"SELECT {EVENT_COLUMNS}, session_index FROM numbered"),
    "session_summary": _customer(SESSIONS, select="SELECT * FROM sessions"),
    "session_count": _customer(NUMBERED, select="SELECT count(session_index) AS events FROM numbered"),
    "session_totals": _customer(
        SESSIONS, select="SELECT count(*) AS sessions, count(DISTINCT user_id) AS users FROM sessions"
    ),
    "session_floor": _device(
        SESSIONS, USERS,
        select="""SELECT * FROM (SELECT (SELECT count(*) FROM sessions WHERE session_index = 1 AND converted = 1) AS sessions,
        (SELECT count(*) FROM users) AS users) WHERE sessions < users""",
    ),
    "session_gaps": _customer(
        NUMBERED,
        select="""SELECT * FROM (
          SELECT user_id, session_index, date_diff('minute', lag(m) OVER timeline, m) AS minutes_since,
                 session_index <> lag(session_index) OVER timeline AS starts
          FROM (SELECT DISTINCT user_id, session_index, date_trunc('minute', event_ts) AS m FROM numbered)
          WINDOW timeline AS (PARTITION BY user_id ORDER BY m, session_index))
        WHERE starts <> (minutes_since > 20)""",
    ),
    "funnel": _device(FUNNEL, select="SELECT * FROM funnel"),
    "funnel_by_channel": _device(
        USERS, BY_CHANNEL,
        select="""SELECT channel, step_index, step, users_reached, round(step_conversion, 9) AS step_conversion
        FROM channel_funnel""",
    ),
    "worst_step": _device(FUNNEL, OPPORTUNITY, select="SELECT * FROM worst"),
    "step_user_counts": _device(
        FUNNEL, select="SELECT step AS event_name, n AS users FROM reach"
    ),
    "arpu": _device(FUNNEL, select="SELECT round(each, 6) AS arpu_per_purchaser FROM buyers"),
    "opportunity": _device(
        FUNNEL, OPPORTUNITY,
        select="""SELECT * REPLACE (round(arpu_per_purchaser, 6) AS arpu_per_purchaser,
        round(downstream_purchase_rate, 6) AS downstream_purchase_rate) FROM opportunity""",
    ),
    "detectable_effect": _device(
        FUNNEL,
        select=f"""SELECT step_index, step, step_conversion, round(least_change, 6) AS detectable_absolute,
        round(least_change / step_conversion, 6) AS detectable_relative
        FROM (SELECT *, ({P975} + {P80}) * sqrt(2 * step_conversion * (1 - step_conversion) / 18500) AS least_change
              FROM funnel WHERE step_conversion IS NOT NULL)""",
    ),
    "retention": _device(USERS, RETENTION, select="SELECT * FROM retention"),
    "retention_extended": _device(USERS, RETENTION, select="SELECT * FROM retention"),
    "retention_by_channel": _device(
        USERS, COHORTS, AGED,
        select=f"""SELECT channel, CAST(sum(cohort_users) AS BIGINT) AS users_all_cohorts, {_eligible(1)},
        {_eligible(20)}, {_eligible(30)}, {_segment_rate("d1_exact", 1)}, {_segment_rate("d7_exact", 7)},
        {_segment_rate("d7_plus", 7)}, {_segment_rate("d20_plus", 20)}, {_segment_rate("d30_plus", 30)}
        FROM aged GROUP BY channel""",
    ),
    "pooled_retention": _device(
        USERS, COHORTS,
        select="""SELECT channel, round(CAST(sum(d7_plus) AS DOUBLE) / nullif(sum(cohort_users), 0), 9) AS d7_plus_rate
        FROM cohort_counts GROUP BY channel""",
    ),
    "week_one": _device(USERS, COHORTS, LAST_DAYS, select=f"SELECT {DROPOFF}"),
    "week_one_by_channel": _device(
        USERS, COHORTS, LAST_DAYS, select=f"SELECT channel, {DROPOFF} GROUP BY channel"
    ),
    "retention_curve": _device(
        USERS, COHORTS,
        select="""SELECT v.channel, CAST(v.day AS INTEGER) AS day_number,
        round(CAST(count(DISTINCT v.user_id) AS DOUBLE) / any_value(s.n), 9) AS rate
        FROM visits v JOIN (SELECT channel, count(*) AS n FROM users GROUP BY channel) s ON s.channel = v.channel
        WHERE v.day <= 30 GROUP BY v.channel, v.day""",
    ),
    "two_proportion": _device(
        USERS, PROPORTIONS,
        select="""SELECT n_organic, n_paid_search, round(organic_rate, 6) AS organic_rate,
        round(paid_search_rate, 6) AS paid_search_rate, round(absolute_difference, 6) AS absolute_difference,
        round(relative_difference, 6) AS relative_difference, round(ci_low, 6) AS ci_low,
        round(ci_high, 6) AS ci_high, round(z, 6) AS z, round(p_value, 6) AS p_value FROM comparison""",
    ),
    "audit": _customer(AUDIT, select="SELECT * FROM audit"),
    "audit_by_event": _with(
        _raw("customer"),
        """
    survivors AS (
      SELECT DISTINCT ON (event_name, event_ts) user_id FROM raw_events WHERE user_id IS NOT NULL
      ORDER BY event_name, event_ts, event_id
    ),
    counts AS (
      SELECT count(*) AS raw_rows, count(*) FILTER (WHERE user_id IS NULL) AS null_user_rows FROM raw_events
    ),
    kept AS (SELECT count(*) AS clean_rows, count(DISTINCT user_id) AS clean_users FROM survivors),
    known AS (
      SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
        SELECT count(*) AS n FROM raw_events WHERE user_id IS NOT NULL GROUP BY event_name, event_ts)
    )""",
        select="""SELECT raw_rows, clean_rows, raw_rows - clean_rows AS rows_removed, duplicate_rows,
        round(CAST(duplicate_rows AS DOUBLE) / raw_rows, 5) AS duplicate_rate, null_user_rows,
        round(CAST(null_user_rows AS DOUBLE) / raw_rows, 5) AS null_user_rate, clean_users
        FROM counts, kept, known""",
    ),
    "rate_in_band": _customer(
        AUDIT,
        select="""SELECT rate_name, rate FROM (
          SELECT 'duplicate_rate' AS rate_name, duplicate_rate AS rate, 0.012 AS low, 0.018 AS high FROM audit
          UNION ALL SELECT 'null_user_rate', null_user_rate, 0.003, 0.005 FROM audit
          UNION ALL SELECT 'duplicate_rate', duplicate_rate, 0.0, 0.001 FROM audit)
        WHERE rate <= low OR rate >= high OR rate IS NULL""",
    ),
    "circular_mean_hour": _customer(
        HOURS, stage=DIRTY,
        select="SELECT platform, n AS rows, round(mean_hour, 6) AS mean_hour FROM hours",
    ),
    "circular_mean_hour_clean": _customer(
        HOURS, select="SELECT platform, n AS rows, round(mean_hour, 6) AS mean_hour FROM hours"
    ),
    "hour_skew": _customer(HOURS, stage=DIRTY, select="SELECT * FROM skew WHERE hours_apart > 3"),
    "hour_spread": _customer(
        HOURS, stage=DIRTY,
        select="""SELECT a.platform, round(any_value(a.mean_hour), 2) AS mean_hour,
        round(max(12 - abs(12 - abs(a.mean_hour - b.mean_hour))), 2) AS hours_apart
        FROM hours a, hours b WHERE a.n > 1000 AND b.n > 1000 GROUP BY a.platform""",
    ),
    "hour_spread_half_day": _customer(
        """bands AS (
          SELECT concat('from ', hour(event_ts) // 3 * 3) AS band,
                 (degrees(atan2(avg(sin(radians(15 * hour(event_ts)))), avg(cos(radians(15 * hour(event_ts)))))) / 15 + 24)
                   % 24 AS mean_hour
          FROM stg GROUP BY band
        )""",
        stage=DIRTY,
        select="""SELECT a.band, round(any_value(a.mean_hour), 2) AS mean_hour,
        round(max(12 - abs(12 - abs(a.mean_hour - b.mean_hour))), 2) AS hours_apart
        FROM bands a, bands b GROUP BY a.band""",
    ),
    "hour_profile": _customer(HOURLY, stage=DIRTY, select="SELECT * FROM profile"),
    "flat_hours": """SELECT min(n) AS least, max(n) AS most FROM (
        SELECT h, count(ts) AS n FROM range(24) AS hours(h) LEFT JOIN events ON hour(ts) = h GROUP BY h)
        HAVING max(n) <= 3 * min(n)""",
    "dup_keys": _customer(
        stage=DIRTY,
        select="""SELECT user_id, event_name, event_ts, count(*) AS n FROM stg
        GROUP BY user_id, event_name, event_ts HAVING count(*) > 1""",
    ),
    "null_users": _customer(
        stage=DIRTY, select="SELECT count(*) AS null_rows FROM stg WHERE user_id IS NULL HAVING count(*) > 0"
    ),
    "before_signup": _with(
        _raw("device"), DIRTY, BEFORE_SIGNUP, select="SELECT * FROM early WHERE first_ts < signup_ts"
    ),
    "repeat_signups": _with(
        _raw("device"), DIRTY,
        select="SELECT user_id, count(*) AS n FROM stg WHERE event_name = 'signup' GROUP BY user_id HAVING count(*) > 1",
    ),
    "funnel_monotonic": _device(
        FUNNEL,
        select="""SELECT step_index, step, users_reached, users_previous_step FROM funnel
        WHERE users_reached > users_previous_step""",
    ),
    "retention_bound": _device(
        USERS, COHORTS, OVERCOUNTED,
        select="""SELECT * FROM overcounted
        WHERE d1_plus > cohort_users OR d7_plus > cohort_users OR d30_plus > cohort_users""",
    ),
    "retention_over_count": _device(
        USERS, COHORTS, OVERCOUNTED,
        select="""SELECT count(*) AS failed_rows FROM overcounted
        WHERE d1_plus > cohort_users OR d30_plus > cohort_users""",
    ),
    "segment_order": _device(
        USERS, COHORTS,
        select="""SELECT better, worse, round(better_rate, 9) AS better_rate, round(worse_rate, 9) AS worse_rate FROM (
          SELECT lag(o.name) OVER place AS better, o.name AS worse, lag(s.rate) OVER place AS better_rate,
                 s.rate AS worse_rate
          FROM (VALUES ('organic', 1), ('paid_search', 2), ('social', 3), ('referral', 4), ('email', 5)) AS o(name, i)
          JOIN (SELECT channel, CAST(sum(d7_plus) AS DOUBLE) / nullif(sum(cohort_users), 0) AS rate
                FROM cohort_counts GROUP BY channel) s ON s.channel = o.name
          WHERE s.rate IS NOT NULL WINDOW place AS (ORDER BY o.i))
        WHERE better_rate <= worse_rate""",
    ),
    "rate_mismatch": _device(
        USERS, BY_CHANNEL,
        select="""SELECT channel, step, round(step_conversion, 6) AS step_conversion, round(expected, 6) AS expected
        FROM (
          SELECT f.channel, f.step, f.step_conversion, least(r.rate * m.factor, CAST(0.99 AS DOUBLE)) AS expected
          FROM channel_funnel f
          JOIN (VALUES ('activate', CAST(0.72 AS DOUBLE)), ('first_search', CAST(0.81 AS DOUBLE)),
                       ('add_to_cart', CAST(0.46 AS DOUBLE)), ('purchase', CAST(0.58 AS DOUBLE))) AS r(step, rate)
            ON r.step = f.step
          JOIN (VALUES ('organic', CAST(1.18 AS DOUBLE)), ('paid_search', CAST(0.78 AS DOUBLE)),
                       ('social', CAST(0.85 AS DOUBLE)), ('referral', CAST(1.25 AS DOUBLE)),
                       ('email', CAST(1.10 AS DOUBLE))) AS m(channel, factor) ON m.channel = f.channel
        ) WHERE abs(step_conversion - expected) >= 0.025""",
    ),
    "unique": _with(
        _raw("device"), DIRTY,
        select="SELECT user_id, count(*) AS n FROM stg WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1",
    ),
    "not_null": _customer(stage=DIRTY, select=f"SELECT {EVENT_COLUMNS} FROM stg WHERE user_id IS NULL"),
    "accepted_values": _customer(
        stage=DIRTY,
        select="""SELECT event_name AS value, count(*) AS n FROM stg
        WHERE event_name NOT IN ('signup', 'activate', 'first_search', 'add_to_cart', 'purchase') GROUP BY event_name
        UNION ALL
        SELECT channel, count(*) FROM stg WHERE channel NOT IN ('organic', 'paid_search', 'social') GROUP BY channel""",
    ),
    "orphans": _customer(
        select="""SELECT o_custkey, count(*) AS n FROM orders
        WHERE o_custkey NOT IN (SELECT user_id FROM stg) GROUP BY o_custkey"""
    ),
    "check_suite_clean": _suite(CLEAN),
    "check_suite_dirty": _suite(DIRTY),
    "check_first_rows": _customer(
        stage=DIRTY,
        select="""SELECT 'repeated' AS name, count(*) AS failed_rows, min(row) AS first_row FROM (
          SELECT concat('{', CASE WHEN user_id IS NULL THEN '' ELSE concat('"user_id":', user_id, ',') END,
                        '"event_name":"', event_name, '","n":', count(*), '}') AS row
          FROM stg GROUP BY user_id, event_name HAVING count(*) > 1)
        UNION ALL
        SELECT 'no_user', CAST(count(*) > 0 AS BIGINT), CASE WHEN count(*) > 0 THEN concat('{"null_rows":', count(*), '}') END
        FROM stg WHERE user_id IS NULL
        UNION ALL
        SELECT 'other_channel', count(*), min(row) FROM (
          SELECT concat('{"channel":"', channel, '","n":', count(*), '}') AS row FROM stg
          WHERE channel NOT IN ('organic', 'paid_search', 'social') GROUP BY channel)
        UNION ALL
        SELECT 'many_events', count(*), min(row) FROM (
          SELECT concat('{"user_id":', user_id, ',"n":', count(*), '}') AS row FROM stg
          WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1)""",
    ),
    "day_slice": _customer(select=SLICE),
    "layout_sizes": """SELECT layout, has_bytes, below_base FROM (VALUES ('base', TRUE, NULL), ('clustered', TRUE, NULL),
        ('narrow', TRUE, TRUE), ('by_date', TRUE, NULL)) AS l(layout, has_bytes, below_base)""",
    "layout_contents": _customer(
        select="""SELECT layout, (SELECT count(*) FROM stg) AS row_count, column_count
        FROM (VALUES ('base', 8), ('clustered', 8), ('narrow', 3), ('by_date', 8)) AS l(layout, column_count)"""
    ),
    "layout_clustered": _customer(select=f"SELECT {EVENT_COLUMNS} FROM stg"),
    "layout_narrow": _customer(select="SELECT user_id, event_name, event_ts FROM stg"),
    "layout_by_date": _customer(select=SLICE),
    "layout_late_events": _customer(
        select="""SELECT event_date, count(*) AS events,
        count(*) FILTER (WHERE event_date = DATE '2024-01-30' AND event_name = 'purchase') AS late FROM stg GROUP BY event_date"""
    ),
    "layout_bucketed": _device(FUNNEL, select="SELECT * FROM funnel"),
    "json_result": _device(FUNNEL, select="SELECT * FROM funnel"),
    "mart_views": _customer(
        USERS, SESSIONS,
        select="""SELECT channel, count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events,
        CAST(sum(converted) AS BIGINT) AS converted FROM sessions JOIN users USING (user_id) GROUP BY channel""",
    ),
    "report": REPORT,
}


def _failures(**checks: str) -> str:
    """The number of offending rows of each check."""
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS name, count(*) AS failed_rows FROM ({sql})" for name, sql in checks.items())


def _out_of_band(rate: str, low: float, high: float) -> str:
    return _device(AUDIT, select=f"SELECT * FROM audit WHERE {rate} <= {low} OR {rate} >= {high} OR {rate} IS NULL")


ORACLES["data_tests"] = _failures(
    one_signup_per_user=_device(
        select="SELECT user_id FROM stg WHERE event_name = 'signup' GROUP BY user_id HAVING count(*) > 1"
    ),
    session_gaps=_device(
        NUMBERED,
        select="""SELECT * FROM (
          SELECT date_diff('minute', lag(m) OVER timeline, m) AS minutes_since,
                 session_index <> lag(session_index) OVER timeline AS starts
          FROM (SELECT DISTINCT user_id, session_index, date_trunc('minute', event_ts) AS m FROM numbered)
          WINDOW timeline AS (PARTITION BY user_id ORDER BY m, session_index))
        WHERE starts <> (minutes_since > 30)""",
    ),
    sessions_cover_users=_device(
        SESSIONS, USERS, select="SELECT 1 WHERE (SELECT count(*) FROM sessions) < (SELECT count(*) FROM users)"
    ),
    duplicate_rate_in_band=_out_of_band("duplicate_rate", 0.012, 0.018),
    null_user_rate_in_band=_out_of_band("null_user_rate", 0.003, 0.005),
    channels_in_order=ORACLES["segment_order"],
    step_rates_recovered=ORACLES["rate_mismatch"],
    hours_not_flat=_device(HOURLY, select="SELECT * FROM profile WHERE most <= 3 * least"),
)
