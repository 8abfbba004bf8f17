"""Comparing the conversion of two segments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.functions.numbers import normal_quantile, normal_upper_tail, ratio


def two_proportion_test(
    users: DataFrame,
    events: DataFrame,
    segment: str = "channel",
    a: str = defaults.SEGMENT_A,
    b: str = defaults.SEGMENT_B,
    goal: str = defaults.GOAL,
    alpha: float = defaults.ALPHA,
) -> DataFrame:
    """One row: conversion of ``a`` and ``b``, their difference, its interval and a z-test.

    The interval uses the unpooled standard error, z and the p-value the pooled one. An
    empty segment gives NULLs.
    """
    converters = events.filter(F.col("event_name") == goal).select("user_id").distinct()
    members = users.filter(F.col(segment).isin(a, b)).join(
        converters.withColumn("converted", F.lit(True)), "user_id", "left"
    )
    in_a, in_b = F.col(segment) == a, F.col(segment) == b
    counts = members.agg(
        F.count_if(in_a).alias("n_a"),
        F.count_if(in_b).alias("n_b"),
        F.count_if(in_a & F.col("converted")).alias("x_a"),
        F.count_if(in_b & F.col("converted")).alias("x_b"),
    )
    n_a, n_b, x_a, x_b, p_a, p_b, pooled = map(F.col, "n_a n_b x_a x_b p_a p_b pooled".split())
    reach = normal_quantile(1 - alpha / 2)
    variance = ratio(p_a * (1 - p_a), n_a) + ratio(p_b * (1 - p_b), n_b)
    pooled_variance = pooled * (1 - pooled) * (ratio(F.lit(1), n_a) + ratio(F.lit(1), n_b))
    difference = F.col("absolute_difference")
    return (
        counts.withColumns(
            {"p_a": ratio(x_a, n_a), "p_b": ratio(x_b, n_b), "pooled": ratio(x_a + x_b, n_a + n_b)}
        )
        .withColumns(
            {
                "absolute_difference": p_b - p_a,
                "half_width": reach * F.sqrt(variance),
                "z": ratio(p_b - p_a, F.sqrt(pooled_variance)),
            }
        )
        .select(
            p_a.alias(f"{a}_rate"),
            p_b.alias(f"{b}_rate"),
            difference,
            ratio(difference, p_a).alias("relative_difference"),
            (difference - F.col("half_width")).alias("ci_low"),
            (difference + F.col("half_width")).alias("ci_high"),
            "z",
            (2 * normal_upper_tail(F.abs("z"))).alias("p_value"),
            n_a.alias(f"n_{a}"),
            n_b.alias(f"n_{b}"),
        )
    )
