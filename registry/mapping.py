"""The driver's `events` table read as clinical data.

Two mappings. `timeline` goes straight to a timeline of readings and treatments. `clinical_tables` goes to the
raw tables of the model graph: charted values, laboratory values, orders, stays, comorbidity and weight, with
repeated rows, unlisted items, missing stays and statuses mixed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import codes
from chronoweave.functions.links import log_link
from chronoweave.operators.ordered import with_neighbours
from chronoweave.plans.clinical import RawTables

K = "cast(get_json_object(props, '$.k') as int)"

CHART_CYCLE = (807, 811, 1529, 3744, 3745, 220045, 220621, 225664, 226537)
LAB_CYCLE = (50809, 50931, 50820)
INSULIN_CYCLE = (223258, 223262, 223258, 223257, 223262, 223260)
PARENTERAL_CYCLE = (*codes.PARENTERAL_ITEMS, 225823)
ENTERAL_CYCLE = (*sorted(i for items in codes.ENTERAL_ITEMS.values() for i in items), 226226)
STATUS_CYCLE = ("Rewritten", None, "Paused", "Stopped", *["FinishedRunning"] * 6)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # times without a zone are compared as instants, which is only safe where no clock change interferes
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    reading = "event_type in ('view', 'click')"
    return load(spark, sf_dir, "events").selectExpr(
        "user_id div 4 as subject_id",
        "user_id div 2 as hadm_id",
        "user_id as stay_id",
        "ts as timer",
        f"case when {reading} then ts end as glctimer",
        f"case when {reading} then 60 + 2 * value end as glc",
        "case when event_type = 'click' then 60 + 2 * value end as glc_lab",
        "case event_type when 'view' then 'fingerstick' when 'click' then 'blood' end as glcsource",
        f"case when not {reading} then ts end as starttime",
        f"case when event_type = 'signup' then ts + make_dt_interval(0, 0, 3 * {K}, 0) end as endtime",
        f"case when not {reading} then cast(floor(value / 10) as double) end as input",
        "case when event_type = 'signup' then value / 20 end as input_hrs",
        f"case when not {reading} then 'Short' end as insulintype",
        "case event_type when 'purchase' then 'BOLUS_PUSH' when 'error' then 'BOLUS_INJECTION' "
        "when 'signup' then 'INFUSION' end as event",
        f"case when not {reading} then cast(event_id % 2 as int) end as infxstop",
    )


def _cycle(values, at: str):
    return F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"cast(({at}) % {len(values)} as int)"))


HADM = "case when user_id % 10 < 2 then user_id div 2 else 100000 + user_id end"


def _ids(events: DataFrame) -> DataFrame:
    return events.withColumns({"hadm_id": F.expr(HADM), "subject_id": F.expr(f"10 * ({HADM}) + 7")})


def chartevents(events: DataFrame) -> DataFrame:
    # every 13th event is charted twice with the same content
    copies = F.expr("sequence(1, case when event_id % 13 = 0 then 2 else 1 end)")
    return (
        _ids(events)
        .filter("event_type = 'view' or (event_type = 'click' and event_id % 7 = 0)")
        .select(
            "subject_id",
            "hadm_id",
            F.expr("case when event_id % 11 <> 0 then user_id end").alias("stay_id"),
            F.col("ts").alias("charttime"),
            F.expr("ts + make_dt_interval(0, 0, 5, 0)").alias("storetime"),
            _cycle(CHART_CYCLE, "event_id").alias("itemid"),
            F.expr("case when event_id % 50 = 0 then -1.0d else 60 + 2 * value end").alias("valuenum"),
            F.explode(copies).alias("copy"),
        )
        .drop("copy")
    )


def labevents(events: DataFrame) -> DataFrame:
    return (
        _ids(events)
        .filter("event_type = 'click' or (event_type = 'view' and event_id % 7 = 0)")
        .select(
            "subject_id",
            "hadm_id",
            F.col("ts").alias("charttime"),
            _cycle(LAB_CYCLE, "event_id").alias("itemid"),
            F.expr("55 + 2.1d * value").alias("valuenum"),
        )
    )


def inputevents(events: DataFrame) -> DataFrame:
    insulin = "(event_type <> 'signup' or event_id % 4 = 0)"
    parenteral = "(event_type = 'signup' and event_id % 4 = 1)"
    quarter = "event_id div 4"
    items = (
        F.when(F.expr(insulin), F.array(_cycle(INSULIN_CYCLE, "event_id")))
        .when(
            F.expr(parenteral),
            F.array(_cycle(PARENTERAL_CYCLE, quarter), _cycle(PARENTERAL_CYCLE, f"{quarter} + 5")),
        )
        .otherwise(F.array(_cycle(ENTERAL_CYCLE, quarter)))
    )
    minutes = f"case when {insulin} then 3 else 30 end * {K}"
    return (
        _ids(events)
        .filter("event_type in ('purchase', 'error', 'signup')")
        .select(
            "subject_id",
            "hadm_id",
            F.expr("case when event_id % 37 <> 0 then user_id end").alias("stay_id"),
            F.col("ts").alias("starttime"),
            F.expr(f"ts + make_dt_interval(0, 0, {minutes}, 0)").alias("endtime"),
            F.expr(
                "case when event_id % 29 = 0 then -1.0d when event_id % 31 = 0 then null "
                "else cast(floor(value / 10) as double) end"
            ).alias("amount"),
            F.expr("case when event_id % 3 <> 0 then value / 20 end").alias("rate"),
            F.expr("value / 25").alias("originalrate"),
            F.expr("case when event_id % 2 = 0 then 'mL' else 'grams' end").alias("amountuom"),
            F.expr(
                "case when event_id % 17 = 0 then '14-Oral/Gastric Tube Intake' "
                "when event_type = 'purchase' then '05-Med Bolus' when event_type = 'error' then '06-Insulin (Non IV)' "
                "when event_id % 8 = 0 then '01-Drips' when event_id % 4 = 0 then '12-Parenteral Nutrition' "
                "else '13-Enteral Nutrition' end"
            ).alias("ordercategoryname"),
            _cycle(STATUS_CYCLE, "event_id").alias("statusdescription"),
            F.explode(items).alias("itemid"),
        )
    )


def icustays(events: DataFrame) -> DataFrame:
    spans = events.groupBy("user_id").agg(F.min("ts").alias("icu_intime"), F.max("ts").alias("icu_outtime"))
    return _ids(spans).selectExpr(
        "subject_id",
        "hadm_id",
        "user_id as stay_id",
        "case when user_id % 2 = 0 then 'M' else 'F' end as gender",
        "case when user_id % 9 = 0 then date'2025-01-01' end as dod",
        "date_trunc('DAY', icu_intime) as admittime",
        "date_trunc('DAY', icu_outtime) + make_dt_interval(1, 0, 0, 0) as dischtime",
        "30 + cast(user_id % 3 as double) as los_hospital",
        "20.5d + user_id % 60 as admission_age",
        "concat('group ', cast(user_id % 4 as string)) as ethnicity",
        "cast(user_id % 9 = 0 as int) as hospital_expire_flag",
        "1 as hospstay_seq",
        "true as first_hosp_stay",
        "icu_intime",
        "icu_outtime",
        "timestampdiff(MINUTE, icu_intime, icu_outtime) / 1440.0d as los_icu",
        "1 as icustay_seq",
        "user_id % 10 <> 1 as first_icu_stay",
    )


def charlson(events: DataFrame) -> DataFrame:
    return (
        _ids(events.select("user_id").distinct())
        .filter("hadm_id % 5 <> 0")
        .select(
            "subject_id",
            "hadm_id",
            F.expr("cast(hadm_id % 3 = 0 as int)").alias("diabetes_without_cc"),
            F.expr("cast(hadm_id % 7 = 0 as int)").alias("diabetes_with_cc"),
        )
        .distinct()
    )


def first_day_weight(events: DataFrame) -> DataFrame:
    return (
        events.select("user_id")
        .distinct()
        .filter("user_id % 3 <> 0")
        .selectExpr("user_id as stay_id", "60.0d + user_id % 40 as weight")
    )


def clinical_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    events = load(spark, sf_dir, "events")
    return RawTables(
        chart=chartevents(events),
        labs=labevents(events),
        orders=inputevents(events),
        stays=icustays(events),
        comorbidity=charlson(events),
        weight=first_day_weight(events),
    )


#: The inputs that the cohort made from `modelling_rows` has.
COHORT_INPUTS = [
    "glc", "input_bolus_push", "input_bolus_injection", "input_hrs", "admission_age", "gender_m", "weight", "diabetes_with_cc",
    "diabetes_without_cc", "n",
]


def modelling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline as one row per stay and time: value, next value, dose, and hours since the stay began."""
    base = timeline(spark, sf_dir)
    base = base.join(base.groupBy("stay_id").agg(F.min("timer").alias("icu_intime")), "stay_id")
    return with_neighbours(
        base.select(
            "subject_id",
            "hadm_id",
            "stay_id",
            "timer",
            "icu_intime",
            "glc",
            F.when(F.col("event") == "BOLUS_PUSH", F.col("input")).alias("input_bolus_push"),
            F.when(F.col("event") == "BOLUS_INJECTION", F.col("input")).alias("input_bolus_injection"),
            "input_hrs",
            F.expr("case when stay_id % 2 = 0 then 'M' else 'F' end").alias("gender"),
            F.expr("20.5d + stay_id % 60").alias("admission_age"),
            F.expr("cast(hadm_id % 3 = 0 as int)").alias("diabetes_without_cc"),
            F.expr("cast(hadm_id % 7 = 0 as int)").alias("diabetes_with_cc"),
            F.expr("case when stay_id % 3 <> 0 then 60.0d + stay_id % 40 end").alias("weight"),
        ),
        ["stay_id"],
        ["timer"],
        1,
        lambda w: {"timer_next": F.lead("timer").over(w), "glc_next": F.lead("glc").over(w)},
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persistence forecast per pair of neighbouring readings, as two models over three folds."""
    readings = (
        load(spark, sf_dir, "events")
        .filter("event_type in ('view', 'click')")
        .selectExpr("event_id", "user_id", "ts", "60 + 2 * value as glc", f"{K} as k")
    )
    paired = with_neighbours(
        readings, ["user_id"], ["ts"], 1, lambda w: {"glc_next": F.lead("glc").over(w)}
    ).filter(F.col("glc_next").isNotNull())
    return paired.select(
        F.col("event_id").alias("rn"),
        "user_id",
        F.expr("case when event_id % 2 = 0 then 'even' else 'odd' end").alias("model"),
        F.expr("cast(user_id % 3 as int)").alias("fold"),
        log_link(F.col("glc")).alias("mu"),
        F.expr("0.05d + k / 100.0d").alias("sigma"),
        log_link(F.col("glc_next")).alias("target"),
        "glc_next",
    )
