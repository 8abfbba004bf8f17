"""The raw event table of the registered queries, derived from whole given tables.

Every row of ``events`` becomes a raw event with the defects cleaning has to undo: ios
clocks 8 hours behind, retried beacons under a fresh id, and events without a user.
Mornings are moved to the afternoon, so hours are not uniform and the clock defect shows.
With ``grain="customer"`` a user is a customer and has many events; with ``"device"``
each customer has 20 devices, so users have few events and funnels and cohorts vary.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_events(spark: SparkSession, sf_dir: str, grain: str = "customer") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    kind, value, ts = F.col("event_type"), F.col("value"), F.col("ts")
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")

    user = F.col("user_id")
    if grain == "device":
        slot = F.floor(F.regexp_extract("props", "[0-9]+", 0).cast("bigint") / 5)
        user = user * 100 + slot

    platform = F.when(nation < 9, "ios").when(nation < 17, "android").otherwise("web")
    channel = (
        F.when(kind == "click", "paid_search")
        .when((kind == "error") & (value >= 100), F.lit(None))
        .when(segment == "BUILDING", "organic")
        .when(segment == "AUTOMOBILE", "paid_search")
        .when(segment == "MACHINERY", "social")
        .when(segment == "HOUSEHOLD", "referral")
        .otherwise("email")
    )
    name = (
        F.when(kind == "signup", "signup")
        .when(kind == "view", "activate")
        .when(kind == "click", "first_search")
        .when((kind == "error") & (value >= 20), "add_to_cart")
        .when((kind == "purchase") & (value >= 35), "purchase")
        .otherwise("session_start")
    )
    afternoon = F.when(F.hour(ts) < 12, ts + F.expr("INTERVAL 12 HOURS")).otherwise(ts)
    no_user = (value < 0.18) | (value > 350)
    base = events.join(customer, F.col("user_id") == F.col("c_custkey")).select(
        "event_id",
        F.when(~no_user, user).alias("user_id"),
        name.alias("event_name"),
        F.when(platform == "ios", afternoon - F.expr("INTERVAL 8 HOURS"))
        .otherwise(afternoon)
        .alias("event_ts"),
        channel.alias("channel"),
        platform.alias("platform"),
        F.when(name == "purchase", value).otherwise(0.0).cast("decimal(18,2)").alias("revenue"),
        (value >= 210).alias("retried"),
    )
    # Even ids are originals, odd ones their copies, however many events there are.
    original = F.col("event_id") * 2
    ids = F.when(F.col("retried"), F.array(original, original + 1)).otherwise(F.array(original))
    return base.select(F.explode(ids).alias("event_id"), *base.columns[1:-1])
