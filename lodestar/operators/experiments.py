"""Assignment of users to experiments, rollups and significance tests."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar import constants as C
from lodestar.functions import events as E
from lodestar.functions import hashing as H
from lodestar.functions import probability as P
from lodestar.functions.numbering import weighted_below

# ---- assignment ------------------------------------------------------------------


def bucket(experiment: Column, user: Column, buckets: int = C.EXPERIMENT_BUCKETS) -> Column:
    return H.hash_mod(F.concat_ws(":", experiment, user.cast("string")), buckets)


def holdback_flag(user: Column, fraction: float = C.HOLDBACK_FRACTION) -> Column:
    text = F.concat_ws(":", F.lit(C.HOLDBACK_KEY), user.cast("string"))
    threshold = int(fraction * C.HOLDBACK_RESOLUTION)
    return H.hash_mod(text, C.HOLDBACK_RESOLUTION) < threshold


def variant_of(bucket_col: Column) -> Column:
    """Half-open ranges of the joined experiment row: control first."""
    return (
        F.when((bucket_col >= F.col("control_low")) & (bucket_col < F.col("control_high")), "control")
        .when(
            (bucket_col >= F.col("treatment_low")) & (bucket_col < F.col("treatment_high")), "treatment"
        )
        .otherwise("unassigned")
    )


def bucket_ranges(buckets: DataFrame, experiments: DataFrame) -> DataFrame:
    """Variant of (user_id, experiment, bucket) rows by the experiment's ranges."""
    config = experiments.withColumnRenamed("name", "experiment")
    return buckets.join(config, "experiment").select(
        "user_id", "experiment", "bucket", variant_of(F.col("bucket")).alias("variant")
    )


def requests_for_active(users: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row per user and active experiment (the names travel as one array)."""
    names = experiments.filter("status = 'active'").agg(F.collect_set("name")).scalar()
    listed = users.select("user_id", names.alias("_names"))
    return listed.select("user_id", F.explode("_names").alias("experiment"))


def assign(
    requests: DataFrame,
    experiments: DataFrame,
    earlier: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """(user_id, experiment, bucket, variant) for each requested pair.

    Order of precedence: global holdback, an assignment logged within 7 days,
    then hash bucket and ranges. Without an active experiment of that name the
    answer is 'control' with no bucket.
    """
    config = experiments.filter("status = 'active'").withColumnRenamed("name", "experiment")
    rows = requests.join(config, "experiment", "left").withColumn(
        "_bucket", bucket(F.col("experiment"), F.col("user_id"))
    )
    known = F.col("status").isNotNull()
    fresh_bucket = F.when(known, F.col("_bucket"))
    fresh_variant = F.when(known, variant_of(F.col("_bucket"))).otherwise("control")
    if earlier is not None:
        live = earlier.filter(
            (F.col("assigned_at") > E.ago(now, C.EXPERIMENT_TTL_SECONDS)) & (F.col("assigned_at") <= now)
        )
        sticky = live.groupBy("user_id", "experiment").agg(
            F.max_by(F.struct("bucket", "variant"), "assigned_at").alias("_sticky")
        )
        rows = rows.join(sticky, ["user_id", "experiment"], "left")
        fresh_bucket = F.coalesce("_sticky.bucket", fresh_bucket)
        fresh_variant = F.coalesce("_sticky.variant", fresh_variant)
    held = holdback_flag(F.col("user_id"))
    return rows.select(
        "user_id",
        "experiment",
        F.when(held, -1).otherwise(fresh_bucket).alias("bucket"),
        F.when(held, "holdback").otherwise(fresh_variant).alias("variant"),
    )


def assign_one(users: DataFrame, experiments: DataFrame, experiment: str) -> DataFrame:
    """Add bucket and variant of one experiment to every user row.

    The experiment is a single configuration row, so it is a scalar here, not
    a join.
    """
    fields = ["control_low", "control_high", "treatment_low", "treatment_high"]
    row = experiments.filter((F.col("name") == experiment) & (F.col("status") == "active"))
    config = row.agg(F.first(F.struct(*fields))).scalar()
    number = bucket(F.lit(experiment), F.col("user_id"))
    flat = users.withColumn("_config", config).withColumn("_bucket", number)
    wide = flat.select("*", *[F.col("_config")[f].alias(f) for f in fields])
    known = F.col("_config").isNotNull()
    held = holdback_flag(F.col("user_id"))
    variant = F.when(held, "holdback").when(~known, "control").otherwise(variant_of(F.col("_bucket")))
    return wide.select(
        *users.columns,
        F.when(held, -1).otherwise(F.when(known, F.col("_bucket"))).alias("bucket"),
        variant.alias("variant"),
    )


def assignment_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("experiment", "variant").agg(F.count("*").alias("assignments"))


def active_experiments(status_log: DataFrame) -> DataFrame:
    """Experiments whose latest status is 'active'."""
    latest = status_log.groupBy("name").agg(
        F.max_by("status", F.struct("changed_at", "seq")).alias("status"),
        F.max("changed_at").alias("changed_at"),
    )
    return latest.filter("status = 'active'")


# ---- rollups -----------------------------------------------------------------------


def user_metrics(interactions: DataFrame) -> DataFrame:
    """One row of counters per user: what joins and rollups need of the events."""
    kind = F.col("event_type")
    return interactions.groupBy("user_id").agg(
        F.count_if(E.is_impression(kind)).alias("impressions"),
        F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind.isin("share", "save")).alias("shares"),
        F.coalesce(
            F.sum(F.when(kind == "dwell", F.col("dwell_ms").cast("bigint"))), F.lit(0)
        ).alias("dwell_ms_total"),
    )


def attribute_events(interactions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Events per (experiment, variant, event type); users collapse before the join."""
    per_user = interactions.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return (
        per_user.join(assignments, "user_id")
        .groupBy("experiment", "variant", "event_type")
        .agg(F.sum("n").alias("events"))
    )


def experiment_rollup(interactions: DataFrame, assignments: DataFrame) -> DataFrame:
    totals = ["impressions", "clicks", "shares", "dwell_ms_total"]
    joined = user_metrics(interactions).join(assignments, "user_id")
    rolled = joined.groupBy("experiment", "variant").agg(*[F.sum(c).alias(c) for c in totals])
    ratio = E.safe_ratio(F.col("clicks"), F.col("impressions"))
    return rolled.withColumn("ctr", F.round(ratio, 6))


def returning_users(interactions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Users and returning users (active on two days or more) per variant."""
    days = interactions.select("user_id", F.to_date("created_at").alias("day")).distinct()
    per_user = days.groupBy("user_id").agg(F.count("*").alias("days"))
    joined = assignments.join(per_user, "user_id", "left")
    return joined.groupBy("experiment", "variant").agg(
        F.count("*").alias("users"), F.count_if(F.col("days") >= 2).alias("returns")
    )


def results_with_all_variants(experiments: DataFrame, rollup: DataFrame) -> DataFrame:
    """Every experiment with its three variants, zero where nothing happened."""
    seeded = experiments.select(
        F.col("name").alias("experiment"),
        F.explode(F.array(*map(F.lit, C.VARIANTS))).alias("variant"),
    )
    numbers = ["impressions", "clicks", "shares", "dwell_ms_total"]
    joined = seeded.join(rollup, ["experiment", "variant"], "left")
    return joined.select(
        "experiment", "variant", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers]
    )


# ---- significance --------------------------------------------------------------------


def two_arms(rollup: DataFrame) -> DataFrame:
    """Control and treatment counters side by side, one row per experiment."""

    def of(variant: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("variant") == variant, F.col(column))), F.lit(0))

    return rollup.groupBy("experiment").agg(
        of("control", "clicks").alias("c_clicks"),
        of("control", "impressions").alias("c_total"),
        of("treatment", "clicks").alias("t_clicks"),
        of("treatment", "impressions").alias("t_total"),
    )


def z_statistic(c_hits: Column, c_total: Column, t_hits: Column, t_total: Column) -> Column:
    """Pooled two-proportion z; 0 when a side is empty or there is no variance."""
    p1 = F.try_divide(c_hits, c_total)
    p2 = F.try_divide(t_hits, t_total)
    pooled = F.try_divide(c_hits + t_hits, c_total + t_total)
    inverse = F.try_divide(F.lit(1.0), c_total) + F.try_divide(F.lit(1.0), t_total)
    error = F.sqrt(pooled * (1.0 - pooled) * inverse)
    return F.coalesce(F.try_divide(p2 - p1, error), F.lit(0.0))


def p_value_of_z(z: Column) -> Column:
    return F.when(z == 0.0, 1.0).otherwise(P.two_sided_p(z))


def two_proportion_ztest(arms: DataFrame) -> DataFrame:
    z = z_statistic(*[F.col(c) for c in ("c_clicks", "c_total", "t_clicks", "t_total")])
    return arms.withColumn("z", z).select(
        "experiment",
        F.round("z", 6).alias("z"),
        F.round(p_value_of_z(F.col("z")), 6).alias("p_value"),
    )


def expected_ratios(experiments: DataFrame) -> DataFrame:
    """(experiment, expected_ratio): control to treatment shares of the configured ranges; 1 without treatment."""
    control = F.col("control_high") - F.col("control_low")
    treatment = F.col("treatment_high") - F.col("treatment_low")
    ratio = F.coalesce(F.try_divide(control.cast("double"), treatment.cast("double")), F.lit(1.0))
    return experiments.select(F.col("name").alias("experiment"), ratio.alias("expected_ratio"))


def with_expected_ratio(arms: DataFrame, experiments: DataFrame | None) -> DataFrame:
    """Arms with the split to expect: as configured, else 1:1."""
    if experiments is None:
        return arms.withColumn("expected_ratio", F.lit(1.0))
    known = arms.join(expected_ratios(experiments), "experiment", "left")
    return known.withColumn("expected_ratio", F.coalesce("expected_ratio", F.lit(1.0)))


def srm_chi2(control: Column, treatment: Column, expected_ratio: Column | float = 1.0) -> Column:
    ratio = expected_ratio if isinstance(expected_ratio, Column) else F.lit(expected_ratio)
    total = control + treatment
    expected_c = total * (ratio / (ratio + 1.0))
    expected_t = total - expected_c
    chi2 = F.try_divide(F.pow(control - expected_c, 2.0), expected_c) + F.try_divide(
        F.pow(treatment - expected_t, 2.0), expected_t
    )
    return F.coalesce(chi2, F.lit(0.0))


def sample_ratio_mismatch(arms: DataFrame, experiments: DataFrame | None = None) -> DataFrame:
    """Chi-square test of the arms' sizes against the split that ``experiments`` configures (1:1 without)."""
    chi2 = srm_chi2(F.col("c_total"), F.col("t_total"), F.col("expected_ratio"))
    tested = with_expected_ratio(arms, experiments).withColumn("chi2", chi2)
    p = P.chi_square_1df_p(F.col("chi2"))
    return tested.select(
        "experiment",
        F.round("chi2", 6).alias("chi2"),
        F.round(p, 6).alias("p_value"),
        (p > C.SRM_P_THRESHOLD).alias("ratio_ok"),
    )


def bonferroni(alpha: float, tests: Column) -> Column:
    return F.when(tests > 0, F.lit(alpha) / tests).otherwise(alpha)


def required_sample_size(
    rate: Column, mde: float = C.RELATIVE_MDE, power: float = C.POWER, alpha: float = C.ALPHA
) -> Column:
    """Users per arm to detect a relative lift ``mde`` over ``rate``."""
    z_alpha = NormalDist().inv_cdf(1 - alpha / 2)
    z_beta = NormalDist().inv_cdf(power)
    p2 = rate * (1.0 + mde)
    middle = (rate + p2) / 2.0
    spread = F.lit(z_alpha) * F.sqrt(2.0 * middle * (1.0 - middle)) + F.lit(z_beta) * F.sqrt(
        rate * (1.0 - rate) + p2 * (1.0 - p2)
    )
    needed = F.try_divide(spread * spread, (p2 - rate) * (p2 - rate))
    return F.coalesce(F.ceil(needed), F.lit(0))


def evaluate_experiments(
    rollup: DataFrame, experiments: DataFrame | None = None, metrics_tested: int = 1
) -> DataFrame:
    """CTR test, sample-ratio check (against the configured split) and corrected decision per experiment."""
    arms = with_expected_ratio(two_arms(rollup), experiments)
    z = z_statistic(*[F.col(c) for c in ("c_clicks", "c_total", "t_clicks", "t_total")])
    p = p_value_of_z(F.col("z"))
    chi2 = srm_chi2(F.col("c_total"), F.col("t_total"), F.col("expected_ratio"))
    ratio_ok = P.chi_square_1df_p(chi2) > C.SRM_P_THRESHOLD
    alpha = bonferroni(C.ALPHA, F.lit(metrics_tested))
    control = E.safe_ratio(F.col("c_clicks"), F.col("c_total"))
    treatment = E.safe_ratio(F.col("t_clicks"), F.col("t_total"))
    return arms.withColumn("z", z).select(
        "experiment",
        F.lit("ctr").alias("metric"),
        F.round(control, 6).alias("control_value"),
        F.round(treatment, 6).alias("treatment_value"),
        F.round(E.safe_ratio(treatment - control, control), 6).alias("relative_lift"),
        F.round(p, 6).alias("p_value"),
        ((p < alpha) & ratio_ok).alias("is_significant"),
        ratio_ok.alias("sample_ratio_ok"),
    )


def mann_whitney_u(samples: DataFrame, groups: list[str]) -> DataFrame:
    """Two-sided Mann-Whitney U of ``value`` between control and treatment.

    ``samples`` holds counts: (*groups, variant, value, n). Tied values share
    an average rank; the normal approximation with tie and continuity
    correction is used for every sample size. U is that of control.
    """

    def count_of(variant: str) -> Column:
        return F.sum(F.when(F.col("variant") == variant, F.col("n")).otherwise(0))

    per_value = samples.groupBy(*groups, "value").agg(
        count_of("control").alias("nc"), count_of("treatment").alias("nt")
    )
    ties = per_value.withColumn("n", F.col("nc") + F.col("nt")).filter("n > 0")
    ranked = weighted_below(ties, groups, "value", "n")
    # Average rank of a tie block: below + (n + 1) / 2; kept doubled to stay integral.
    # Products of counts pass 64 bits on ordinary data, so they are decimals.
    doubled = (2 * F.col("below") + F.col("n") + 1).cast("decimal(20,0)")
    n = F.col("n").cast("decimal(12,0)")
    cubes = n * n * n - n
    sums = ranked.groupBy(*groups).agg(
        F.sum("nc").alias("n1"),
        F.sum("nt").alias("n2"),
        F.sum((doubled * F.col("nc").cast("decimal(17,0)")).cast("decimal(38,0)")).cast("double").alias("r2"),
        F.sum(cubes.cast("decimal(38,0)")).cast("double").alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    u = F.col("r2") / 2.0 - n1 * (n1 + 1.0) / 2.0
    variance = n1 * n2 / 12.0 * (total + 1.0 - F.col("ties") / (total * (total - 1.0)))
    larger = F.greatest(u, n1 * n2 - u)
    z = F.greatest((larger - n1 * n2 / 2.0 - 0.5) / F.sqrt(variance), F.lit(0.0))
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    p = F.when(empty | (variance <= 0), 1.0).otherwise(F.least(P.two_sided_p(z), F.lit(1.0)))
    return sums.select(
        *groups,
        "n1",
        "n2",
        F.when(empty, 0.0).otherwise(u).alias("u"),
        F.round(p, 6).alias("p_value"),
    )


def variant_values(interactions: DataFrame, assignments: DataFrame, value: str) -> DataFrame:
    """Counts of (experiment, variant, value), with events collapsed per user and value."""
    per_user = (
        interactions.filter(F.col(value).isNotNull())
        .groupBy("user_id", F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return (
        per_user.join(assignments, "user_id")
        .groupBy("experiment", "variant", "value")
        .agg(F.sum("n").alias("n"))
    )


