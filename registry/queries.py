"""Every registered query: (session, folder of the driver's tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave import schemas
from chronoweave.functions import codes
from chronoweave.functions.links import exp_link
from chronoweave.operators import cohort, entities, features, nutrition, quality, readings, scoring, summaries
from chronoweave.operators import sequences, timeline, trajectories, treatments
from chronoweave.operators.models import fit_linear
from chronoweave.operators.ordered import Running, Whole, add_row_id, scan, with_neighbours
from chronoweave.operators.pairing import pair_events
from chronoweave.operators.quantiles import exact_median
from chronoweave.operators.ranges import Layer, in_force, stab_intervals, sum_points_between
from chronoweave.operators.splits import find_splits
from chronoweave.plans import clinical
from chronoweave.plans import cohort as cohort_plan
from chronoweave.plans.experiment import run_folds, run_grid, run_sweep
from chronoweave.roles import load_roles
from chronoweave.session import pin, shared_folder
from chronoweave.sources.runs import append_metrics, read_predictions, read_run_metrics, save_predictions
from chronoweave.sources.tables import as_view, read_csv, read_table, write_csv, write_rows_csv
from registry import mapping as m
from registry.present import shown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(digits: int = 6) -> Callable[[Query], Query]:
    """Register under the function's name; the output is brought to the common form."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: shown(f(spark, sf_dir), digits)
        return f

    return register


# ------------------------------------------------------------------ staging


@query()
def readings_raw(spark, d):
    raw = m.clinical_tables(spark, d)
    return readings.raw_readings(raw.chart, raw.labs)


@query()
def readings_clean(spark, d):
    raw = m.clinical_tables(spark, d)
    return readings.clean_readings(raw.chart, raw.labs)


@query()
def treatments_raw(spark, d):
    return treatments.raw_treatments(m.clinical_tables(spark, d).orders)


@query()
def boluses_capped(spark, d):
    return treatments.clean_boluses(treatments.raw_treatments(m.clinical_tables(spark, d).orders), exact=True)


@query()
def infusions_capped(spark, d):
    return treatments.clean_infusions(treatments.raw_treatments(m.clinical_tables(spark, d).orders), exact=True)


@query()
def treatments_clean(spark, d):
    return treatments.clean_treatments(m.clinical_tables(spark, d).orders, exact=True)


@query()
def parenteral_components(spark, d):
    return nutrition.parenteral_components(m.clinical_tables(spark, d).orders)


@query()
def parenteral_rates(spark, d):
    return nutrition.parenteral_rates(nutrition.parenteral_components(m.clinical_tables(spark, d).orders))


@query()
def solution_units(spark, d):
    orders = m.clinical_tables(spark, d).orders
    return orders.groupBy("itemid", nutrition.solution_unit().alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query()
def enteral_amounts(spark, d):
    return nutrition.enteral_amounts(m.clinical_tables(spark, d).orders)


@query()
def enteral_rates(spark, d):
    return nutrition.enteral_rates(nutrition.enteral_amounts(m.clinical_tables(spark, d).orders))


@query()
def stay_attributes(spark, d):
    raw = m.clinical_tables(spark, d)
    return timeline.stay_attributes(raw.stays, raw.comorbidity, raw.weight)


@query()
def clinical_timeline(spark, d):
    raw = m.clinical_tables(spark, d)
    return timeline.build_timeline(
        readings.clean_readings(raw.chart, raw.labs), treatments.clean_treatments(raw.orders, exact=True)
    )


@query()
def stay_timeline(spark, d):
    return clinical.stay_timeline(m.clinical_tables(spark, d), exact=True)


@query()
def stay_timeline_long(spark, d):
    stays = pin(clinical.stay_timeline(m.clinical_tables(spark, d), exact=True))
    return timeline.to_long(*clinical.paired_timeline(stays))


@query()
def wide_with_nutrition(spark, d):
    return clinical.build_tables(m.clinical_tables(spark, d), exact=True)["wide_nutrition"]


@query()
def clinical_cohort(spark, d):
    tables = clinical.build_tables(m.clinical_tables(spark, d), exact=True)
    return cohort_plan.modelling_cohort(tables["wide_nutrition"])


# ------------------------------------------------------------------ pairing and widening

PAIRED = ["stay_id", "hadm_id", "timer", "glc_al", "glctimer_al", "glcsource_al", "rule"]


@query()
def pairing_rule_counts(spark, d):
    paired = pair_events(m.timeline(spark, d))
    return paired.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("glc_al").alias("sum_glc"))


@query()
def paired_within_90_minutes(spark, d):
    return pair_events(m.timeline(spark, d)).select(*PAIRED)


@query()
def paired_within_720_minutes(spark, d):
    return pair_events(m.timeline(spark, d), tolerance_min=720).select(*PAIRED)


@query()
def paired_one_reading_per_rule(spark, d):
    return pair_events(m.timeline(spark, d), tolerance_min=720, strict_reference=False).select(*PAIRED)


@query()
def repeated_readings(spark, d):
    paired, _ = clinical.paired_timeline(m.timeline(spark, d), tolerance_min=720)
    return paired.select("stay_id", "timer", "glctimer_al", "repeated")


@query()
def long_timeline(spark, d):
    return timeline.to_long(*clinical.paired_timeline(m.timeline(spark, d), tolerance_min=720))


def _wide(spark, d) -> DataFrame:
    paired, by_stay = clinical.paired_timeline(m.timeline(spark, d), tolerance_min=720)
    return timeline.to_wide(pin(timeline.to_long(paired, by_stay)), by_stay)


@query()
def wide_timeline(spark, d):
    return _wide(spark, d)


@query()
def wide_timeline_without_fan_out(spark, d):
    return timeline.drop_fanned_out_entities(pin(_wide(spark, d)))


def _probes(spark, d) -> DataFrame:
    """Readings with the previous reading's time."""
    seen = m.timeline(spark, d).filter(F.col("glc").isNotNull()).select("stay_id", "timer", "glc")
    return with_neighbours(seen, ["stay_id"], ["timer"], 1, lambda w: {"timer_prev": F.lag("timer").over(w)})


def _infusions(spark, d) -> DataFrame:
    return m.timeline(spark, d).filter("event = 'INFUSION'").select(
        "stay_id",
        F.col("starttime").alias("from_time"),
        (F.col("starttime") + F.expr("make_dt_interval(0, 0, 600, 0)")).alias("to_time"),
        "input_hrs",
        "input",
    )


@query()
def points_between_rows(spark, d):
    points = m.timeline(spark, d).filter("event = 'BOLUS_PUSH'").select("stay_id", "starttime", "input")
    return sum_points_between(_probes(spark, d), points, ["stay_id"], "input", name="dose")


@query()
def sweep_in_force(spark, d):
    """The same averages from one sorted timeline, without building pairs."""
    layer = Layer(
        _infusions(spark, d), "from_time", "to_time", {"rate": "input_hrs"}, "n_in_force", "first_start", "last_end"
    )
    return in_force(_probes(spark, d), ["stay_id"], "timer", [layer])


@query()
def extreme_rates_in_force(spark, d):
    """Averages of rates near 1e20 for some stays, near 1e-19 for others, and of both sizes together for the rest."""
    huge, tiny = F.col("input") * F.lit(2.0**66), F.col("input") * F.lit(2.0**-63)
    rate = F.when(F.col("stay_id") % 3 == 0, huge).when(F.col("stay_id") % 3 == 1, tiny)
    rate = rate.otherwise(F.when(F.col("input") % 2 == 0, huge).otherwise(tiny))
    layer = Layer(_infusions(spark, d).withColumn("rate", rate), "from_time", "to_time", {"rate": "rate"}, "n_in_force")
    found = in_force(_probes(spark, d).select("stay_id", "timer"), ["stay_id"], "timer", [layer])
    return found.select(
        "stay_id", "timer", "n_in_force", (F.col("rate") / F.lit(2.0**66)).alias("rate_huge"),
        F.when(F.col("rate") < 1, F.col("rate") * F.lit(2.0**63)).alias("rate_tiny"),
    )


@query()
def price_medians(spark, d):
    """The exact median price per flag and status, and that of all negated prices."""
    items = m.load(spark, d, "lineitem")
    by_flag = exact_median(items, ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")
    of_all = exact_median(items, [], -F.col("l_extendedprice"), "median_negated")
    return by_flag.withColumn("median_negated", of_all.scalar())


@query()
def neighbours_within_one_time(spark, d):
    """Neighbours and running counts where a third of the users have one time for all rows, and a third have none."""
    third = F.col("user_id") % 3
    rows = m.load(spark, d, "events").select(
        "user_id", "event_id", "value",
        F.when(third == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).when(third == 2, F.col("ts")).alias("t"),
    )
    order = ["t", "event_id"]
    near = with_neighbours(rows, ["user_id"], order, 2, lambda w: {"before": F.lag("value").over(w), "after": F.lead("event_id", 2).over(w)})
    counted = scan(near, ["user_id"], order, {"n": Running(F.lit(1)), "highest": Running(F.col("value"), "max"), "size": Whole("sum", F.lit(1))})
    return counted


@query()
def nutrition_with_repeated_rows(spark, d):
    raw = m.clinical_tables(spark, d)
    parenteral = nutrition.parenteral_rates(nutrition.parenteral_components(raw.orders))
    enteral = nutrition.enteral_rates(nutrition.enteral_amounts(raw.orders))
    return timeline.add_nutrition(_probes(spark, d), parenteral, enteral)


@query()
def averages_in_force(spark, d):
    aggs = {
        "rate": F.avg("input_hrs"),
        "first_start": F.min("from_time"),
        "last_end": F.max("to_time"),
        "n_in_force": F.count(F.lit(1)),
    }
    return stab_intervals(_probes(spark, d), _infusions(spark, d), ["stay_id"], "timer", "from_time", "to_time", aggs)


@query()
def rows_in_force(spark, d):
    return stab_intervals(_probes(spark, d), _infusions(spark, d), ["stay_id"], "timer", "from_time", "to_time")


@query()
def row_quality(spark, d):
    """Rows each check returns on the paired clinical timeline."""
    stays = pin(clinical.stay_timeline(m.clinical_tables(spark, d), exact=True))
    paired = pair_events(stays)
    checks = {
        "duplicate_readings": quality.check_duplicate_readings(stays),
        "stay_unknown": quality.check_stay_known(stays),
        "timer_unknown": quality.check_timer_known(stays),
        "unpaired": quality.check_unpaired(paired),
    }
    counts = {k: v.agg(F.count(F.lit(1)).alias("n_rows")) for k, v in checks.items()}
    return summaries.tagged_union(counts, "check_name")


# ------------------------------------------------------------------ cohort


@query()
def readings_per_stay(spark, d):
    rows = m.modelling_rows(spark, d)
    splits = find_splits(rows, ["stay_id"], "timer")
    rows = cohort.running_count(rows, splits=splits)
    return cohort.group_size(rows, splits=splits).select("stay_id", "timer", "n", "size")


@query()
def stays_with_readings(spark, d):
    return cohort.keep_min_readings(m.modelling_rows(spark, d), n=27).select("stay_id", "timer", "glc")


@query()
def trailing_trim(spark, d):
    return cohort.trim_trailing(m.modelling_rows(spark, d)).select("stay_id", "timer", "glc", "glc_next")


@query()
def leading_trim(spark, d):
    return cohort.trim_leading(m.modelling_rows(spark, d)).select("stay_id", "timer", "glc", "n", "msk0", "sum_msk0")


@query()
def interpolated(spark, d):
    return cohort.interpolate_by_position(m.modelling_rows(spark, d)).select("stay_id", "timer", "glc")


@query()
def doses_without_outliers(spark, d):
    rows = cohort.replace_outliers(m.modelling_rows(spark, d), limit=15.0)
    return rows.select("stay_id", "timer", *codes.DOSE_COLUMNS)


@query()
def masks_and_clocks(spark, d):
    rows = cohort.add_gap(cohort.add_masks_and_clocks(m.modelling_rows(spark, d)))
    rows = cohort.fill_zero(rows)
    return rows.select(
        "stay_id", "timer", "gender_m", "msk", "timer_d", "timer_next_d", "delta_t", *codes.DOSE_COLUMNS
    )


def _cohort(spark, d) -> DataFrame:
    return cohort_plan.modelling_cohort(m.modelling_rows(spark, d))


COHORT = [
    "rn", "stay_id", "timer", "glc", "glc_next", "n", "msk", "msk0", "sum_msk0", "timer_d", "timer_next_d", "delta_t",
    "gender_m", *codes.DOSE_COLUMNS,
]


@query()
def modelling_cohort(spark, d):
    return _cohort(spark, d).select(*COHORT)


@query()
def cohort_audit(spark, d):
    return quality.audit(cohort.add_gap(m.modelling_rows(spark, d)))


@query()
def cohort_summary(spark, d):
    return cohort.cohort_summary(m.modelling_rows(spark, d))


@query()
def no_change_error_by_stay(spark, d):
    return cohort.persistence_rmse(m.modelling_rows(spark, d), by=["stay_id"])


@query()
def gap_histogram(spark, d):
    rows = cohort.add_gap(m.modelling_rows(spark, d))
    return cohort.histogram(rows, "delta_t", 30, F.col("delta_t") < 24.0)


@query()
def price_histogram(spark, d):
    return cohort.histogram(m.load(spark, d, "lineitem"), "l_extendedprice", 50)


@query()
def value_change_histogram(spark, d):
    return cohort.histogram(m.modelling_rows(spark, d), F.col("glc") - F.col("glc_next"), 60)


@query()
def numbered_rows(spark, d):
    rows = add_row_id(m.load(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id", "ts"])
    return rows


@query()
def numbered_csv(spark, d):
    """Rows written as CSV with a row number and read back with a declared schema."""
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    orders = m.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    write_rows_csv(orders, path, ["o_custkey", "o_orderkey"])
    schema = T.StructType([T.StructField("rn", T.LongType()), *orders.schema.fields])
    return read_csv(spark, path, schema)


def _simulated(spark, d) -> DataFrame:
    return m.load(spark, d, "events").selectExpr(
        "user_id as id",
        "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3600.0d + event_id / 1e9d as t",
        "event_type in ('view', 'click') as obs",
        "60 + 2 * value as glucose_t_obs",
        "value / 20 as insulin_t",
    )


@query()
def next_observed_value(spark, d):
    return cohort.next_observed(_simulated(spark, d))


@query()
def only_observed_rows(spark, d):
    return cohort.only_observed(cohort.next_observed(_simulated(spark, d))).select(
        "id", "t", "glucose_t_obs", "glucose_t_obs_next", "t1", "n"
    )


# ------------------------------------------------------------------ entities, features, sequences


@query(2)
def customer_folds(spark, d):
    """Three folds over the customers that have orders; every order follows its customer."""
    folded = entities.fold_by_entity(m.load(spark, d, "orders"), 3, "o_custkey")
    return folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_custkey").alias("customers"),
        F.min("o_custkey").alias("first_customer"),
        F.max("o_custkey").alias("last_customer"),
        F.sum("o_totalprice").alias("total"),
    )


@query(2)
def orders_in_and_out(spark, d):
    """Orders of the customers on a list, and all others."""
    orders = m.load(spark, d, "orders")
    listed = m.load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    sides = {
        "kept": entities.keep_entities(orders, listed, "o_custkey"),
        "dropped": entities.drop_entities(orders, listed, "o_custkey"),
    }
    totals = {k: v.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")) for k, v in sides.items()}
    return summaries.tagged_union(totals, "side")


@query()
def customers_with_orders(spark, d):
    return entities.distinct_entities(m.load(spark, d, "orders"), "o_custkey")


@query()
def customer_split(spark, d):
    """Sizes of a hash split by customer: the share is exact, which customers go where is up to the hash."""
    split = entities.split_by_entity(m.load(spark, d, "orders"), 0.1, 7, "o_custkey")
    return split.groupBy("held_out").agg(F.count_distinct("o_custkey").alias("customers"))


@query()
def customer_split_covers(spark, d):
    """Both sides together hold every order once and share no customer."""
    split = entities.split_by_entity(m.load(spark, d, "orders"), 0.2, 1, "o_custkey")
    sides = split.groupBy("o_custkey").agg(
        F.count_distinct("held_out").alias("sides"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    return sides


@query()
def sample_is_whole_stays(spark, d):
    """A sample of twenty stays: how many there are, and whether every row of theirs is there once."""
    rows = m.timeline(spark, d).select("stay_id", "timer")
    drawn = entities.sample_entities(rows, 20, 3).groupBy("stay_id").agg(F.count(F.lit(1)).alias("drawn"))
    held = rows.groupBy("stay_id").agg(F.count(F.lit(1)).alias("held"))
    return drawn.join(held, "stay_id").agg(
        F.count(F.lit(1)).alias("n_stays"), F.bool_and(F.col("drawn") == F.col("held")).alias("whole")
    )


@query()
def exported_cohort(spark, d):
    """The cohort as the two CSV files of a hold-out by stay, read back; no stay is on both sides."""
    root = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = pin(_cohort(spark, d).select(*COHORT))
    cohort_plan.save_cohort(rows, f"{root}/main", f"{root}/validation")
    schema = T.StructType([rows.schema["rn"], *[f for f in rows.schema if f.name != "rn"]])
    sides = {n: read_csv(spark, f"{root}/{name}", schema) for n, name in enumerate(("main", "validation"))}
    both = summaries.tagged_union(sides, "side")
    stays = both.groupBy("stay_id").agg(F.count_distinct("side").alias("sides"))
    return both.select("rn", "stay_id", "timer", "glc", "glc_next", "n").join(stays, "stay_id")


@query()
def held_out_stays(spark, d):
    """Sizes of that hold-out's sides; which stays go where is up to the hash."""
    marked = entities.split_by_entity(_cohort(spark, d).select("stay_id"), 0.1)
    return marked.groupBy("held_out").agg(F.count_distinct("stay_id").alias("stays"))


@query()
def sorted_view(spark, d):
    """The first rows of a view sorted by customer and price, a NULL customer first."""
    customer = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey"))
    as_view(m.load(spark, d, "orders").select("o_orderkey", "o_totalprice", customer.alias("customer")), "sorted_orders")
    return read_table(spark, "sorted_orders", ["customer", "o_totalprice", "o_orderkey"]).limit(700)


@query()
def sampled_stays(spark, d):
    return entities.sample_entities(m.timeline(spark, d), 20, 3).select("stay_id", "timer", "glc", "event")


@query()
def first_orders(spark, d):
    orders = m.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return entities.first_rows(orders, ["o_custkey", "o_orderkey"], 8000)


@query()
def lagged_doses(spark, d):
    rows = cohort.add_masks_and_clocks(m.modelling_rows(spark, d))
    return features.lag_features(rows, ["glc", "input_hrs"], order=["timer"]).select(
        "stay_id", "timer", "delta_t", *features.lag_names(["glc", "input_hrs"])
    )


#: The roles of the cohort made from `events`, which has no nutrition.
ROLES = load_roles(dataset="clinical_cohort").among([*m.COHORT_INPUTS])


@query()
def role_columns(spark, d):
    """Key, entity, target and inputs of a role file's small feature set."""
    roles = load_roles(dataset="clinical_cohort", feature_set="test_features")
    return _cohort(spark, d).select(roles.key, roles.id, roles.target, *roles.model_inputs)


@query()
def scaled_features(spark, d):
    rows = pin(_cohort(spark, d))
    train = rows.filter("stay_id % 5 <> 0")
    scaled = features.apply_scaler(rows, features.fit_scaler(train, ROLES), ROLES)
    return scaled.select("rn", "glc", "glc_next", *codes.DOSE_COLUMNS, *ROLES.static)


def _total(arrays: str, at: int):
    """The sum of one component over all steps, padding included."""
    return F.aggregate(arrays, F.lit(0.0), lambda a, x: a + F.coalesce(F.get(x, F.lit(at)), F.lit(0.0)))


@query(4)
def sequences_of_large_keys(spark, d):
    """Keys beyond 32 bits and entities cut into short segments."""
    rows = _cohort(spark, d).withColumn("rn", F.col("rn") + F.lit(3_000_000_000))
    seq = sequences.to_sequences(rows, ROLES, segment=7)
    return seq.select("stay_id", "seg", "seqlen", "steps", F.element_at("key", 1).alias("first_key"), _total("dt", 1).alias("sum_ends"))


@query()
def sequence_lengths(spark, d):
    seq = sequences.to_sequences(_cohort(spark, d), ROLES, max_len=40)
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return seq.select(
        "stay_id",
        "seqlen",
        F.element_at("key", 1).alias("first_key"),
        F.element_at("key", -1).alias("last_key"),
        total.alias("sum_target"),
        F.element_at("x0", 1).alias("age"),
        F.element_at(F.element_at("xt", -1), 1).alias("last_value"),
        F.element_at(F.element_at("dt", 1), 2).alias("first_end"),
        F.element_at(F.element_at("xi", 1), 1).alias("first_rate"),
    )


@query(4)
def padded_batches(spark, d):
    seq = pin(sequences.to_sequences(_cohort(spark, d), ROLES))
    padded = sequences.pad_batches(seq, ROLES, 32)
    return padded.select(
        "batch",
        "stay_id",
        "seqlen",
        F.size("xt").alias("padded_len"),
        F.size(F.filter("key", lambda k: k == -1)).alias("pad_keys"),
        F.aggregate("msk", F.lit(0), lambda a, x: a + x).alias("masked"),
        F.size(F.element_at("xt", -1)).alias("width"),
        _total("xi", 0).alias("sum_rates"),
        _total("dt", 1).alias("sum_ends"),
    )


@query()
def unpadded_targets(spark, d):
    seq = pin(sequences.to_sequences(_cohort(spark, d), ROLES))
    return sequences.unpad(sequences.pad_batches(seq, ROLES, 32), ["y"])


# ------------------------------------------------------------------ trajectories


def _steps(spark, d) -> DataFrame:
    return m.forecasts(spark, d).select(
        "rn", "user_id", "mu", "sigma", "target", (F.col("rn") / 1000.0).alias("t0"), (F.col("rn") / 1000.0 + 1).alias("t1")
    )


@query()
def time_grid(spark, d):
    return trajectories.time_grid(_steps(spark, d).select("rn", "t0", "t1"), 4)


@query()
def flattened_steps(spark, d):
    """Two forecast points per step, collected per line number and flattened again."""
    point = F.struct(F.col("l_quantity").alias("mu"), F.col("l_discount").alias("sigma"))
    steps = (
        m.load(spark, d, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "points"))).alias("s"))
        .select("l_orderkey", F.col("s.points").alias("steps"))
    )
    return trajectories.flatten_steps(steps)


@query()
def observed_series(spark, d):
    return trajectories.observed_series(_steps(spark, d), "user_id", "mu", "target", "t0", "t1")


@query()
def fan_bands(spark, d):
    grid = _steps(spark, d).select("rn", "mu", "sigma", F.col("t0").alias("ts"))
    return trajectories.fan_bands(grid, maxtime=8.0)


# ------------------------------------------------------------------ scoring and summaries


def _scored(spark, d) -> DataFrame:
    rows = m.forecasts(spark, d)
    predictions = rows.select("rn", "mu", F.col("sigma") * 3, "model", "fold").toDF("rn", "mu", "sigma", "model", "fold")
    known = rows.selectExpr("rn", "glc_next", "cast(rn % 7 = 0 as double) as msk", "user_id")
    return scoring.prepare_forecasts(predictions, known)


@query(5)
def scores_by_model_and_fold(spark, d):
    return scoring.score(_scored(spark, d), ["model", "fold"], exp_link)


@query(5)
def scores_by_model(spark, d):
    return scoring.score(_scored(spark, d), ["model"], exp_link)


@query(5)
def scores_of_one_stratum(spark, d):
    rows = m.forecasts(spark, d)
    predictions = rows.select("rn", "mu", "sigma", "model", "fold")
    known = rows.selectExpr("rn", "glc_next", "0.0d as msk", "user_id")
    kept = scoring.prepare_forecasts(predictions, known, where=F.col("user_id") % 4 == 0)
    return scoring.score(kept, ["model"], exp_link, alpha=0.2)


@query(5)
def point_scores(spark, d):
    return scoring.score_points(_scored(spark, d), ["model", "fold"], exp_link)


@query(3)
def training_losses(spark, d):
    return scoring.score_losses(_scored(spark, d), ["model"], 0.05)


@query(5)
def metric_summary(spark, d):
    scores = scoring.score(_scored(spark, d), ["model", "fold"], exp_link)
    return summaries.summarise(scores, ["model"], ["crps_mean", "rmse", "int_coverage", "ig_mean"])


@query(5)
def metrics_long(spark, d):
    scores = scoring.score(_scored(spark, d), ["model", "fold"], exp_link)
    scores = summaries.rescale(scores, ig_mean=-F.col("ig_mean"))
    names = {"even": "Even ids", "odd": "Odd ids"}
    return summaries.display_names(
        summaries.melt_metrics(scores, ["model", "fold"], ["rmse", "crps_mean", "ig_mean"]), names
    )


@query(5)
def interval_scores(spark, d):
    """The interval scores alone, by their common prefix."""
    return summaries.select_prefixes(scoring.score(_scored(spark, d), ["model"], exp_link), "model", "int_")


@query(5)
def appended_metrics(spark, d):
    """Metric rows of three folds, appended run by run to one table."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    scores = pin(scoring.score(_scored(spark, d), ["model", "fold"], exp_link))
    for fold in range(3):
        append_metrics(scores.filter(F.col("fold") == fold), path)
    return spark.read.parquet(path).select("model", "fold", *codes.METRICS)


@query()
def last_order_per_customer(spark, d):
    orders = m.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return summaries.last_metric(orders, ["o_custkey"], "o_orderkey")


@query()
def saved_predictions(spark, d):
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    save_predictions(m.forecasts(spark, d), path)
    back = spark.read.parquet(path)
    return back.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mu").alias("sum_mu"), F.sum("sigma").alias("sum_sigma")
    )


@query()
def runs_from_files(spark, d):
    """Prediction files, one folder per run, read back with fold and run taken from their paths."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = m.forecasts(spark, d)
    for fold in range(3):
        order = ("rn", "mu", "sigma", "model") if fold else ("model", "sigma", "rn", "mu")  # files are read by name
        kept = rows.filter(F.col("fold") == fold).select(*order)
        write_csv(kept, f"{root}/version_{fold + 1}/predictions_{fold}.csv")
    back = read_predictions(spark, root)
    return back.groupBy("model", "fold", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("mu").alias("sum_mu"))


@query(5)
def metrics_from_files(spark, d):
    """Metric logs of runs that also left predictions, with the run's model name."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    scores = pin(scoring.score(_scored(spark, d), ["model", "fold"], exp_link))
    rows = m.forecasts(spark, d)
    for n, model in enumerate(("even", "odd")):
        for fold in range(3):
            folder, own = f"{root}/version_{10 * n + fold + 1}", f"model = '{model}' and fold = {fold}"
            write_csv(rows.filter(own).select("rn", "mu", "sigma", "model"), f"{folder}/predictions_0.csv")
            if (model, fold) != ("odd", 2):  # one run leaves no log
                write_csv(scores.filter(own).drop("model", "fold"), f"{folder}/metrics.csv")
    return read_run_metrics(spark, root, "version").select("run_folder", "model", "crps_mean", "rmse")


@query(5)
def swept_results(spark, d):
    """Scores of two settings stacked with the setting's value; the second lacks one metric."""
    first = scoring.score(_scored(spark, d), ["model"], exp_link).select("model", "rmse", "ig_mean")
    second = scoring.score(_scored(spark, d), ["model"], exp_link, alpha=0.2).select("model", "rmse")
    return summaries.tagged_union({1: first, 2: second}, "value")


@query()
def boluses_capped_by_sketch(spark, d):
    """The default cap, whose distinct count is a sketch."""
    return treatments.clean_boluses(treatments.raw_treatments(m.clinical_tables(spark, d).orders))


@query()
def limits_from_parts(spark, d):
    """Sketches stored month by month, united: within four standard errors of the exact count, whole and per kind?"""
    raw = pin(treatments.raw_treatments(m.clinical_tables(spark, d).orders))
    path, month = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}", F.date_format("starttime", "yyyy-MM")
    for odd in (0, 1, 1):  # parts arrive in two loads; the second is repeated and replaces itself
        treatments.add_part(raw.filter(F.month("starttime") % 2 == odd), month, path)
    limits = treatments.limits_of(spark.read.parquet(path))
    kind = F.when(F.upper("insulinadmin") == "INFUSION", "infusion").when(F.upper("insulinadmin").isin("BOLUS_PUSH", "BOLUS_INJECTION"), "bolus")
    value = F.when(F.col("kind") == "bolus", F.col("amount")).otherwise(F.coalesce("rate", "originalrate"))
    short = raw.filter(F.upper("insulintype") == "SHORT").withColumn("kind", kind).filter(F.col("kind").isNotNull())
    exact = short.groupBy("kind").agg(F.count_distinct(value).alias("n_distinct"))
    near = F.abs(F.col("limit") - F.col("n_distinct")) <= F.greatest(F.lit(0.5), 4 * treatments.SKETCH_ERROR * F.col("n_distinct"))
    return exact.join(limits, "kind").select("kind", "n_distinct", near.alias("near"))


@query()
def boluses_capped_by_parts(spark, d):
    """Boluses under a limit from stored sketches; with this few distinct amounts the sketch counts exactly."""
    raw = pin(treatments.raw_treatments(m.clinical_tables(spark, d).orders))
    return treatments.clean_boluses(raw, sketches=treatments.limit_sketches(raw, F.date_format("starttime", "yyyy-MM")))


# ------------------------------------------------------------------ models


@query()
def linear_price_model(spark, d):
    """Mean and deviation of the price given the quantity, fitted on even and predicted on odd orders."""
    items = m.load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 10000.0).alias("target")
    )
    fitted = fit_linear(items.filter("l_orderkey % 2 = 0"), ["l_quantity"])
    return fitted.predict(items.filter("l_orderkey % 2 = 1")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "target", "mu", "sigma"
    )


@query(5)
def linear_fold_predictions(spark, d):
    """Every scored row's forecast by the model of the other folds' stays; a third of the stays have no weight."""
    predictions, _ = run_folds(_cohort(spark, d), ROLES, "LinearModel", 3)
    return predictions


@query(5)
def simulated_fold_predictions(spark, d):
    """Simulated trajectories from a CSV file with a declared schema: observed rows, three folds, forecasts by a linear model."""
    path = f"{shared_folder(spark)}/simulated-{uuid.uuid4().hex}"
    rows = cohort.next_observed(_simulated(spark, d).withColumns({
        "glucose_t": F.col("glucose_t_obs") + F.col("id") % 7, "dextrose_t": (F.col("id") % 5).cast("double"),
    }))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("n", "msk", "msk0")})
    numbered = add_row_id(rows, ["id", "t"]).select(*[f.name for f in schemas.SIMULATED])
    write_csv(numbered, path)
    observed = cohort.only_observed(read_csv(spark, path, schemas.SIMULATED))
    predictions, _ = run_folds(observed, load_roles(dataset="simulation_5000"), "LinearModel", 3)
    return predictions


@query(4)
def linear_sweep(spark, d):
    """Errors of the linear model over sets of inputs, tasks (mean only, too) and numbers of folds."""
    sweeps = {"roles": ["all", "without_interventions", ["glc", "n"]], "task": ["gaussian", "conditional_expectation"], "k": [2, 3]}
    found = run_sweep(pin(_cohort(spark, d)), ROLES, {"LinearModel": sweeps}, k=3)
    return found.select("model", "fold", "param", "value", "number", "rmse")


@query(4)
def linear_folds(spark, d):
    """Scores of the linear model over three stay folds of the cohort."""
    _, scores = run_folds(_cohort(spark, d), ROLES, "LinearModel", 3)
    return scores


@query(4)
def tree_folds(spark, d):
    """Scores of the boosted trees over three stay folds of the cohort, as many rounds as the held-out stays allow."""
    _, scores = run_folds(_cohort(spark, d), ROLES, "BoostedTrees", 3)
    return scores


@query(4)
def grid_of_seeds(spark, d):
    """The 80/20 split's scores for two seeds, stacked with the seed."""
    return run_grid(_cohort(spark, d), ROLES, [{"seed": 1}, {"seed": 2}], "seed", model="LinearModel", k=1)
