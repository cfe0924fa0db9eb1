"""Declared schemas of the inputs and of the files written between steps."""

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(columns: str) -> T.StructType:
    """From "name type, name type"; works before a session exists."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CHARTEVENTS = _schema(
    "subject_id long, hadm_id long, stay_id long, charttime timestamp_ntz, storetime timestamp_ntz, "
    "itemid int, valuenum double"
)
LABEVENTS = _schema("subject_id long, hadm_id long, charttime timestamp_ntz, itemid int, valuenum double")
INPUTEVENTS = _schema(
    "subject_id long, hadm_id long, stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, amount double, "
    "rate double, originalrate double, amountuom string, ordercategoryname string, "
    "ordercategorydescription string, statusdescription string, itemid int"
)
ICUSTAYS = _schema(
    "subject_id long, hadm_id long, stay_id long, gender string, dod date, admittime timestamp_ntz, "
    "dischtime timestamp_ntz, los_hospital double, admission_age double, ethnicity string, "
    "hospital_expire_flag int, hospstay_seq int, first_hosp_stay boolean, icu_intime timestamp_ntz, "
    "icu_outtime timestamp_ntz, los_icu double, icustay_seq int, first_icu_stay boolean"
)
CHARLSON = _schema("subject_id long, hadm_id long, diabetes_without_cc int, diabetes_with_cc int")
FIRST_DAY_WEIGHT = _schema("stay_id long, weight double")

PREDICTIONS = _schema("rn long, mu double, sigma double, model string")
POINT_PREDICTIONS = _schema("rn long, mu double, model string")
METRIC_ROWS = _schema(
    "crps_mean double, ig_mean double, int_score_mean double, var_pit double, int_coverage double, "
    "int_av_width double, int_med_width double, rmse double"
)
SIMULATED = _schema(
    "id long, t double, obs boolean, glucose_t double, glucose_t_obs double, insulin_t double, dextrose_t double, "
    "glucose_t_obs_next double, t1 double, n double, msk double, msk0 double, rn long"
)

STAY_COLUMNS = [
    "diabetes_without_cc", "diabetes_with_cc", "weight", "gender", "dod", "admittime", "dischtime", "los_hospital",
    "admission_age", "ethnicity", "hospital_expire_flag", "hospstay_seq", "first_hosp_stay", "icu_intime",
    "icu_outtime", "los_icu", "icustay_seq", "first_icu_stay",
]
