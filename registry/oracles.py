"""The SQL each registered query must agree with, for DuckDB over the same tables.

Each statement is a chain of named steps. Joins are written plainly, without the time slots the Spark side
uses, and the normal integral is summed by Simpson's rule, so both sides are worked out independently.
"""

from __future__ import annotations

from chronoweave.functions import codes
from chronoweave.operators.trajectories import fan_levels
from registry import mapping as m

K = "CAST(json_extract_string(props, '$.k') AS INT)"
LN140 = "ln(140)"
STEPS: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def step(name: str, sql: str, *needs: str) -> None:
    STEPS[name] = sql
    NEEDS[name] = list(needs)


def chain(*finals: str) -> str:
    """WITH clause holding the steps that `finals` need, each after its own needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for f in finals:
        visit(f)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{STEPS[n]}\n)" for n in order)


def t(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expr}"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name or expr}"


def i(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def pick(kinds: str, digits: int = 6) -> str:
    """Select list from "t:a b r:c d i:e p:f": t = time, r = rounded, i = integer, p = plain."""
    out, kind = [], "p"
    for word in kinds.split():
        if word[1:2] == ":":
            kind, word = word[0], word[2:]
        out.append({"t": t(word), "r": r(word, digits=digits), "i": i(word), "p": word}[kind])
    return ", ".join(out)


def values(items) -> str:
    return ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in items)


def cycle(items, at: str) -> str:
    return f"([{values(items)}])[1 + CAST(({at}) % {len(items)} AS INT)]"


def minutes(start: str, end: str) -> str:
    return f"date_sub('minute', {start}, {end})"


# ------------------------------------------------------------------ the two mappings of `events`

step(
    "timeline",
    f"""
SELECT user_id // 4 AS subject_id, user_id // 2 AS hadm_id, user_id AS stay_id, ts AS timer,
       CASE WHEN event_type IN ('view', 'click') THEN ts END AS glctimer,
       CASE WHEN event_type IN ('view', 'click') THEN 60 + 2 * value END AS glc,
       CASE WHEN event_type = 'click' THEN 60 + 2 * value END AS glc_lab,
       CASE event_type WHEN 'view' THEN 'fingerstick' WHEN 'click' THEN 'blood' END AS glcsource,
       CASE WHEN event_type NOT IN ('view', 'click') THEN ts END AS starttime,
       CASE WHEN event_type = 'signup' THEN ts + to_minutes(3 * {K}) END AS endtime,
       CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(floor(value / 10) AS DOUBLE) END AS input,
       CASE WHEN event_type = 'signup' THEN value / 20 END AS input_hrs,
       CASE WHEN event_type NOT IN ('view', 'click') THEN 'Short' END AS insulintype,
       CASE event_type WHEN 'purchase' THEN 'BOLUS_PUSH' WHEN 'error' THEN 'BOLUS_INJECTION'
                       WHEN 'signup' THEN 'INFUSION' END AS event,
       CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(event_id % 2 AS INT) END AS infxstop
FROM events""",
)

HADM = "(CASE WHEN user_id % 10 < 2 THEN user_id // 2 ELSE 100000 + user_id END)"
step("ided", f"SELECT *, {HADM} AS hadm_id, 10 * {HADM} + 7 AS subject_id FROM events")
step(
    "chart",
    f"""
SELECT subject_id, hadm_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS stay_id, ts AS charttime,
       ts + INTERVAL 5 MINUTE AS storetime, {cycle(m.CHART_CYCLE, 'event_id')} AS itemid,
       CASE WHEN event_id % 50 = 0 THEN -1.0 ELSE 60 + 2 * value END AS valuenum
FROM ided, generate_series(1, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END) AS c(copy)
WHERE event_type = 'view' OR (event_type = 'click' AND event_id % 7 = 0)""",
    "ided",
)
step(
    "labs",
    f"""
SELECT subject_id, hadm_id, ts AS charttime, {cycle(m.LAB_CYCLE, 'event_id')} AS itemid,
       55 + CAST(2.1 AS DOUBLE) * value AS valuenum
FROM ided WHERE event_type = 'click' OR (event_type = 'view' AND event_id % 7 = 0)""",
    "ided",
)
INSULIN_ROW = "(event_type <> 'signup' OR event_id % 4 = 0)"
step(
    "orders_raw",
    f"""
SELECT subject_id, hadm_id, CASE WHEN event_id % 37 <> 0 THEN user_id END AS stay_id, ts AS starttime,
       ts + to_minutes((CASE WHEN {INSULIN_ROW} THEN 3 ELSE 30 END) * {K}) AS endtime,
       CASE WHEN event_id % 29 = 0 THEN -1.0 WHEN event_id % 31 = 0 THEN NULL
            ELSE CAST(floor(value / 10) AS DOUBLE) END AS amount,
       CASE WHEN event_id % 3 <> 0 THEN value / 20 END AS rate, value / 25 AS originalrate,
       CASE WHEN event_id % 2 = 0 THEN 'mL' ELSE 'grams' END AS amountuom,
       CASE WHEN event_id % 17 = 0 THEN '14-Oral/Gastric Tube Intake' WHEN event_type = 'purchase' THEN '05-Med Bolus'
            WHEN event_type = 'error' THEN '06-Insulin (Non IV)' WHEN event_id % 8 = 0 THEN '01-Drips'
            WHEN event_id % 4 = 0 THEN '12-Parenteral Nutrition' ELSE '13-Enteral Nutrition' END AS ordercategoryname,
       {cycle(m.STATUS_CYCLE, 'event_id')} AS statusdescription,
       unnest(CASE WHEN {INSULIN_ROW} THEN [{cycle(m.INSULIN_CYCLE, 'event_id')}]
                   WHEN event_id % 4 = 1 THEN [{cycle(m.PARENTERAL_CYCLE, 'event_id // 4')},
                                               {cycle(m.PARENTERAL_CYCLE, 'event_id // 4 + 5')}]
                   ELSE [{cycle(m.ENTERAL_CYCLE, 'event_id // 4')}] END) AS itemid
FROM ided WHERE event_type IN ('purchase', 'error', 'signup')""",
    "ided",
)
step(
    "stays",
    """
SELECT subject_id, hadm_id, user_id AS stay_id, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
       CASE WHEN user_id % 9 = 0 THEN DATE '2025-01-01' END AS dod,
       CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS admittime,
       CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 1 DAY AS dischtime,
       CAST(30 + user_id % 3 AS DOUBLE) AS los_hospital, 20.5 + CAST(user_id % 60 AS DOUBLE) AS admission_age,
       'group ' || (user_id % 4) AS ethnicity, CAST(user_id % 9 = 0 AS INT) AS hospital_expire_flag,
       1 AS hospstay_seq, TRUE AS first_hosp_stay, min(ts) AS icu_intime, max(ts) AS icu_outtime,
       date_sub('minute', min(ts), max(ts)) / 1440 AS los_icu, 1 AS icustay_seq,
       user_id % 10 <> 1 AS first_icu_stay
FROM ided GROUP BY subject_id, hadm_id, user_id""",
    "ided",
)
step(
    "comorbidity",
    """
SELECT DISTINCT subject_id, hadm_id, CAST(hadm_id % 3 = 0 AS INT) AS diabetes_without_cc,
       CAST(hadm_id % 7 = 0 AS INT) AS diabetes_with_cc
FROM ided WHERE hadm_id % 5 <> 0""",
    "ided",
)
step(
    "weights",
    "SELECT DISTINCT user_id AS stay_id, 60.0 + CAST(user_id % 40 AS DOUBLE) AS weight FROM events WHERE user_id % 3 <> 0",
)

# ------------------------------------------------------------------ staging

step(
    "readings_raw",
    f"""
SELECT DISTINCT subject_id, hadm_id, stay_id, charttime, storetime, valuenum AS glucose, itemid AS item_glc
FROM chart WHERE itemid IN ({values(codes.CHART_ITEMS)}) AND valuenum > 0
UNION ALL
SELECT DISTINCT subject_id, hadm_id, CAST(NULL AS BIGINT), charttime, CAST(NULL AS TIMESTAMP), valuenum, itemid
FROM labs WHERE itemid IN ({values(codes.LAB_ITEMS)}) AND valuenum > 0""",
    "chart",
    "labs",
)
step(
    "readings_split",
    f"""
SELECT subject_id, hadm_id, stay_id, charttime, glucose AS finger, CAST(NULL AS DOUBLE) AS lab FROM readings_raw
WHERE item_glc IN ({values(codes.FINGERSTICK_ITEMS)}) AND glucose < 500
UNION
SELECT subject_id, hadm_id, stay_id, charttime, NULL, glucose FROM readings_raw
WHERE item_glc IN ({values(codes.BLOOD_ITEMS)}) AND glucose < 1000""",
    "readings_raw",
)
step(
    "readings_clean",
    """
SELECT subject_id, hadm_id, max(stay_id) AS stay_id, charttime, coalesce(max(finger), max(lab)) AS glucose,
       max(lab) AS glucose_lab, CASE WHEN max(finger) IS NULL THEN 'blood' ELSE 'fingerstick' END AS glcsource
FROM readings_split GROUP BY subject_id, hadm_id, charttime""",
    "readings_split",
)
TYPE_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codes.INSULIN_TYPES.items())
step(
    "treatments_status",
    f"""
SELECT DISTINCT subject_id, hadm_id, stay_id, starttime, endtime, amount, rate, originalrate, itemid,
       ordercategoryname, statusdescription
FROM orders_raw WHERE itemid IN ({values(codes.INSULIN_TYPES)}) AND statusdescription <> 'Rewritten'
AND stay_id IS NOT NULL""",
    "orders_raw",
)
step(
    "treatments_raw",
    f"""
SELECT subject_id, hadm_id, stay_id, starttime, endtime, amount, rate, originalrate, itemid, ordercategoryname,
       CASE itemid {TYPE_CASES} END AS insulintype,
       CASE WHEN contains(upper(ordercategoryname), 'NON IV') THEN 'BOLUS_INJECTION'
            WHEN contains(upper(ordercategoryname), 'MED BOLUS') THEN 'BOLUS_PUSH'
            WHEN ordercategoryname = '01-Drips' OR ordercategoryname = '12-Parenteral Nutrition' THEN 'INFUSION'
       END AS insulinadmin,
       CAST(statusdescription = 'Paused' OR statusdescription = 'Stopped' AS INT) AS infxstop
FROM treatments_status""",
    "treatments_status",
)
T_COLS = (
    "subject_id, hadm_id, stay_id, starttime, endtime, amount, rate, originalrate, itemid, ordercategoryname, "
    "insulintype, insulinadmin, infxstop"
)
step(
    "short_boluses",
    "SELECT * FROM treatments_raw WHERE insulinadmin LIKE 'BOLUS%' AND insulintype = 'Short'",
    "treatments_raw",
)
step(
    "boluses",
    """
SELECT * REPLACE (CASE WHEN amount < (SELECT count(DISTINCT amount) FROM short_boluses) THEN amount END AS amount)
FROM short_boluses WHERE amount > 0""",
    "short_boluses",
)
step(
    "short_infusions",
    """
SELECT * REPLACE (coalesce(rate, originalrate) AS rate) FROM treatments_raw
WHERE insulinadmin = 'INFUSION' AND insulintype = 'Short'""",
    "treatments_raw",
)
step(
    "infusions",
    "SELECT * FROM short_infusions WHERE rate > 0 AND rate < (SELECT count(DISTINCT rate) FROM short_infusions)",
    "short_infusions",
)
step(
    "treatments_clean",
    f"SELECT DISTINCT {T_COLS} FROM boluses UNION ALL SELECT DISTINCT {T_COLS} FROM infusions",
    "boluses",
    "infusions",
)
SHARES = " ".join(f"WHEN {k} THEN {v}" for k, v in codes.DEXTROSE_SHARE.items())
step(
    "parenteral",
    f"""
SELECT stay_id, starttime, endtime, sum(a * CAST(CASE itemid {SHARES} END AS DOUBLE)) AS dextrose_fluid,
       sum(a) FILTER (itemid IN (225916, 225917)) AS tpn,
       max(CASE itemid WHEN 225916 THEN 1 WHEN 225917 THEN 0 END) FILTER (a IS NOT NULL) AS tpn_lipids,
       sum(a) FILTER (itemid = 225947) AS dextrose_tpn, sum(a) FILTER (itemid = 225969) AS lipids_tpn,
       sum(a) FILTER (itemid = 225948) AS amino_acids_tpn,
       sum(a * CAST(CASE itemid WHEN 227090 THEN 0.1 WHEN 225801 THEN 0.2 END AS DOUBLE)) AS lipids_10_20
FROM (SELECT *, CASE WHEN amount >= 0 THEN amount END AS a FROM orders_raw)
WHERE itemid IN ({values(codes.PARENTERAL_ITEMS)}) AND coalesce(statusdescription, '') <> 'Rewritten'
GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY stay_id, starttime, endtime"),
    "orders_raw",
)
HOURS = f"nullif({minutes('starttime', 'endtime')} / 60, 0)"
step(
    "parenteral_rates",
    f"""
SELECT stay_id, starttime AS timer, CASE WHEN tpn IS NOT NULL THEN {minutes('starttime', 'endtime')} / 60 END AS tpn_length,
       starttime, endtime, dextrose_fluid, tpn / {HOURS} AS tpn_rate
FROM parenteral""",
    "parenteral",
)
PRODUCTS = ", ".join(
    f"({item}, {values(codes.ENTERAL_FACTORS[p])})" for p, items in codes.ENTERAL_ITEMS.items() for item in items
)
step(
    "enteral",
    f"""
SELECT stay_id, hadm_id, subject_id, starttime, endtime, a AS amount_enteral,
       {", ".join(f"a * CAST({n}_f AS DOUBLE) AS {n}_enteral" for n in codes.NUTRIENTS)}
FROM (SELECT *, CASE WHEN amount >= 0 THEN amount END AS a FROM orders_raw) o
JOIN (VALUES {PRODUCTS}) AS p(itemid, {", ".join(f"{n}_f" for n in codes.NUTRIENTS)}) ON o.itemid = p.itemid
WHERE statusdescription IS NULL OR statusdescription <> 'Rewritten'""",
    "orders_raw",
)
step(
    "enteral_rates",
    f"""
SELECT stay_id, hadm_id, subject_id, starttime AS timer, {minutes('starttime', 'endtime')} / 60 AS enteral_length,
       starttime, endtime, amount_enteral / {HOURS} AS enteral_rate,
       {", ".join(f"{n}_enteral / {HOURS} AS {n}_enteral" for n in codes.NUTRIENTS)}
FROM enteral""",
    "enteral",
)
step(
    "clinical_timeline",
    """
SELECT subject_id, hadm_id, stay_id, charttime AS timer, charttime AS glctimer, glucose AS glc, glucose_lab AS glc_lab,
       glcsource, CAST(NULL AS TIMESTAMP) AS starttime, CAST(NULL AS TIMESTAMP) AS endtime,
       CAST(NULL AS DOUBLE) AS input, CAST(NULL AS DOUBLE) AS input_hrs, CAST(NULL AS VARCHAR) AS insulintype,
       CAST(NULL AS VARCHAR) AS event, CAST(NULL AS INT) AS infxstop
FROM readings_clean
UNION ALL
SELECT subject_id, hadm_id, stay_id, starttime, NULL, NULL, NULL, NULL, starttime, endtime, amount, rate, insulintype,
       insulinadmin, infxstop
FROM treatments_clean""",
    "readings_clean",
    "treatments_clean",
)
step(
    "stay_attributes",
    """
SELECT s.*, c.diabetes_without_cc, c.diabetes_with_cc, w.weight FROM stays s
LEFT JOIN comorbidity c ON c.subject_id = s.subject_id AND c.hadm_id = s.hadm_id
LEFT JOIN weights w ON w.stay_id = s.stay_id""",
    "stays",
    "comorbidity",
    "weights",
)
step(
    "stay_timeline",
    """
SELECT DISTINCT e.* REPLACE (coalesce(e.stay_id, s.stay_id) AS stay_id), s.* EXCLUDE (subject_id, hadm_id, stay_id)
FROM clinical_timeline e JOIN stay_attributes s
ON e.subject_id = s.subject_id AND e.hadm_id = s.hadm_id AND e.timer > s.icu_intime AND e.timer < s.icu_outtime""",
    "clinical_timeline",
    "stay_attributes",
)

# ------------------------------------------------------------------ pairing and widening


def along(partition: str, attributes: bool) -> str:
    ties = "event, glcsource, glc, starttime, endtime, input, input_hrs, stay_id" + (", icu_intime" if attributes else "")
    ties = ", ".join(f"{c.strip()} NULLS FIRST" for c in ties.split(","))
    return f"(PARTITION BY {partition} ORDER BY timer NULLS FIRST, event IS NOT NULL, {ties})"


def pairing(name: str, source: str, tolerance: int, strict: bool = True, attributes: bool = False) -> None:
    """Add steps that pair `source`: neighbours, the clause that holds per output, then its values."""
    near = {"p2": "lag({}, 2)", "p1": "lag({}, 1)", "n1": "lead({}, 1)", "n2": "lead({}, 2)"}
    columns = []
    for tag, f in near.items():
        columns += [
            f"{f.format('glcsource IS NOT NULL')} OVER w AS src_{tag}",
            f"{f.format('upper(glcsource)')} OVER w AS name_{tag}",
            f"{f.format('glc')} OVER w AS glc_{tag}",
            f"{f.format('timer')} OVER w AS time_{tag}",
            f"{f.format('event IS NOT NULL')} OVER w AS ins_{tag}",
            f"{f.format('insulintype')} OVER w = 'Short' AS short_{tag}",
            f"abs(date_sub('minute', timer, {f.format('timer')} OVER w)) AS gap_{tag}",
        ]
    step(
        f"{name}_seen",
        f"SELECT *, insulintype = 'Short' AS short_now, {', '.join(columns)} FROM {source}\n"
        f"WINDOW w AS {along('hadm_id', attributes)}",
        source,
    )
    T = tolerance

    def before(a, b):
        return f"gap_{a} <= gap_{b} AND gap_{a} <= {T} AND glc_{a} >= 90 AND glc_{a} >= glc_{b}"

    def after(a, b):
        return f"gap_{a} > gap_{b} AND gap_{a} <= {T} AND gap_{b} <= {T} AND glc_{b} >= 90 AND glc_{a} < glc_{b}"

    tests = {
        1: f"src_p1 AND src_n1 AND {before('p1', 'n1')}",
        2: f"src_p1 AND src_n1 AND {after('p1', 'n1')}",
        4: f"short_now AND src_p2 AND ins_p1 AND short_p1 AND src_n1 AND {after('p2', 'n1')}",
        5: f"short_now AND src_p1 AND src_n2 AND ins_n1 AND short_n1 AND {before('p1', 'n2')}",
        6: f"src_p1 AND src_n2 AND ins_n1 AND {after('p1', 'n2')}",
        7: f"src_p1 AND gap_p1 <= {T} AND glc_p1 >= 90",
        8: f"short_now AND src_p1 AND src_n1 AND gap_p1 > {T} AND gap_n1 <= {T} AND glc_n1 >= 90",
    }

    def number(more: dict[int, str]) -> str:
        cases = " ".join(
            f"WHEN {test}{' AND ' + more[n] if n in more else ''} THEN {n}" for n, test in tests.items()
        )
        return f"CASE WHEN event IS NULL THEN NULL {cases} END"

    never = {6: "FALSE"} if strict else {}
    step(
        f"{name}_clause",
        f"""
SELECT *, {number({})} AS c_glc, {number({6: "short_now AND short_n1"} if strict else {})} AS c_time,
       {number(never)} AS c_src, {number({**never, 2: "short_now"} if strict else {})} AS c_rule
FROM {name}_seen""",
        f"{name}_seen",
    )

    def value(prefix: str, c: str) -> str:
        return (
            f"CASE WHEN {c} IN (1, 5, 7) THEN {prefix}_p1 WHEN {c} IN (2, 4, 8) THEN {prefix}_n1 "
            f"WHEN {c} = 6 THEN {prefix}_n2 END"
        )

    step(
        name,
        f"""
SELECT s.*, {value('glc', 'c_glc')} AS glc_al, {value('time', 'c_time')} AS glctimer_al,
       {value('name', 'c_src')} AS glcsource_al,
       CASE c_rule WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 4 WHEN 7 THEN 1 WHEN 8 THEN 2 END AS rule
FROM {name}_clause s""",
        f"{name}_clause",
    )
    step(
        f"{name}_flagged",
        f"""
SELECT *, CASE WHEN glcsource_al IS NULL AND (lead(glctimer_al) OVER x = glctimer OR
       (lag(glctimer_al) OVER x = glctimer AND lag(endtime) OVER x IS NOT NULL)) THEN 1 END AS repeated
FROM {name} WINDOW x AS {along('stay_id', attributes)}""",
        name,
    )


def widening(name: str, paired: str, extra: list[str]) -> None:
    """Add steps `<name>_long` and `<name>_wide` on a flagged pairing; `extra` are the stay's attributes."""
    more = "".join(f", {c}" for c in extra)
    step(
        f"{name}_long",
        f"""
SELECT * FROM (
    SELECT subject_id, hadm_id, stay_id, timer,
           lead(timer) OVER {along('stay_id', bool(extra))} AS timer_next,
           coalesce(glc, glc_al) AS glc, glc_lab, coalesce(glctimer, glctimer_al) AS glctimer,
           coalesce(glcsource, glcsource_al) AS glcsource, starttime, endtime, input, input_hrs, insulintype, event,
           infxstop{more}
    FROM (SELECT * FROM {paired}_flagged WHERE insulintype IS NOT NULL
          OR (repeated IS NULL AND lower(coalesce(glcsource, glcsource_al)) = 'fingerstick'))
) WHERE timer_next IS NOT NULL""",
        f"{paired}_flagged",
    )
    first = "icu_intime" if extra else "NULL"
    ties = "starttime, endtime, input_hrs" + (", icu_intime" if extra else "")
    ties = ", ".join(f"{c.strip()} NULLS FIRST" for c in ties.split(","))
    step(
        f"{name}_wide",
        f"""
SELECT *, coalesce(lag(timer) OVER w, {first}) AS timer_prev, lead(glc) OVER w AS glc_next FROM (
    SELECT b.*, f.starttime, f.endtime, f.input_hrs, p.dose AS input_bolus_push, j.dose AS input_bolus_injection
    FROM (SELECT subject_id, hadm_id, stay_id, timer, max(timer_next) AS timer_next, max(glc) AS glc,
                 max(glc_lab) AS glc_lab, max(glctimer) AS glctimer, max(glcsource) AS glcsource{more}
          FROM {name}_long GROUP BY subject_id, hadm_id, stay_id, timer{more}) b
    LEFT JOIN {name}_long f ON f.event = 'INFUSION' AND f.stay_id = b.stay_id
        AND (f.timer = b.timer OR (b.timer >= f.starttime AND b.timer < f.endtime))
    LEFT JOIN (SELECT hadm_id, stay_id, timer, sum(input) AS dose FROM {name}_long
               WHERE event = 'BOLUS_PUSH' GROUP BY ALL) p ON p.stay_id = b.stay_id AND p.timer = b.timer
    LEFT JOIN (SELECT hadm_id, stay_id, timer, sum(input) AS dose FROM {name}_long
               WHERE event = 'BOLUS_INJECTION' GROUP BY ALL) j ON j.stay_id = b.stay_id AND j.timer = b.timer
) WINDOW w AS (PARTITION BY stay_id ORDER BY timer, {ties})""",
        f"{name}_long",
    )


pairing("paired90", "timeline", 90)
pairing("paired720", "timeline", 720)
pairing("paired_same", "timeline", 720, strict=False)
widening("simple", "paired720", [])
ATTRIBUTES = [
    "diabetes_without_cc", "diabetes_with_cc", "weight", "gender", "dod", "admittime", "dischtime", "los_hospital",
    "admission_age", "ethnicity", "hospital_expire_flag", "hospstay_seq", "first_hosp_stay", "icu_intime",
    "icu_outtime", "los_icu", "icustay_seq", "first_icu_stay",
]
pairing("stay_paired", "stay_timeline", 90, attributes=True)
widening("clinical", "stay_paired", ATTRIBUTES)
ENTERAL = ["enteral_rate", *[f"{n}_enteral" for n in codes.NUTRIENTS]]
step(
    "fed",
    f"""
SELECT w.*, e.* EXCLUDE (stay_id, timer), p.tpn_rate, d.dextrose_fluid FROM clinical_wide w
LEFT JOIN (SELECT w.stay_id, w.timer, {", ".join(f"avg({c}) AS {c}" for c in ENTERAL)},
                  min(r.starttime) AS ent_starttime, max(r.endtime) AS ent_endtime
           FROM clinical_wide w LEFT JOIN enteral_rates r
           ON r.stay_id = w.stay_id AND r.starttime <= w.timer AND r.endtime > w.timer GROUP BY w.stay_id, w.timer) e
    ON e.stay_id = w.stay_id AND e.timer = w.timer
LEFT JOIN parenteral_rates p ON p.tpn_rate IS NOT NULL AND p.stay_id = w.stay_id
    AND p.starttime <= w.timer AND p.endtime > w.timer
LEFT JOIN (SELECT w.stay_id, w.timer, sum(f.dextrose_fluid) AS dextrose_fluid FROM clinical_wide w
           LEFT JOIN parenteral_rates f ON f.stay_id = w.stay_id AND f.starttime < w.timer AND f.starttime >= w.timer_prev
           GROUP BY w.stay_id, w.timer) d ON d.stay_id = w.stay_id AND d.timer = w.timer""",
    "clinical_wide",
    "enteral_rates",
    "parenteral_rates",
)
FAN_OUT = "SELECT stay_id FROM (SELECT stay_id, timer FROM {0} GROUP BY stay_id, timer HAVING count(*) > 1)"
step("fed_kept", f"SELECT * FROM fed WHERE stay_id NOT IN ({FAN_OUT.format('fed')})", "fed")

# ------------------------------------------------------------------ cohort

step(
    "rows",
    """
SELECT subject_id, hadm_id, stay_id, timer, min(timer) OVER (PARTITION BY stay_id) AS icu_intime, glc,
       CASE WHEN event = 'BOLUS_PUSH' THEN input END AS input_bolus_push,
       CASE WHEN event = 'BOLUS_INJECTION' THEN input END AS input_bolus_injection, input_hrs,
       CASE WHEN stay_id % 2 = 0 THEN 'M' ELSE 'F' END AS gender, 20.5 + CAST(stay_id % 60 AS DOUBLE) AS admission_age,
       CAST(hadm_id % 3 = 0 AS INT) AS diabetes_without_cc, CAST(hadm_id % 7 = 0 AS INT) AS diabetes_with_cc,
       CASE WHEN stay_id % 3 <> 0 THEN 60.0 + CAST(stay_id % 40 AS DOUBLE) END AS weight,
       lead(timer) OVER w AS timer_next, lead(glc) OVER w AS glc_next
FROM timeline WINDOW w AS (PARTITION BY stay_id ORDER BY timer)""",
    "timeline",
)


def cohort_steps(name: str, source: str, order: str) -> None:
    """Steps from a wide table to its cohort: trims, ids, outliers, masks, interpolation, zero fill."""
    step(
        f"{name}_counted",
        f"""
SELECT *, row_number() OVER w AS n0, count(glc) OVER (PARTITION BY stay_id) AS n_glc FROM {source}
WHERE stay_id IS NOT NULL WINDOW w AS (PARTITION BY stay_id ORDER BY {order})""",
        source,
    )
    step(
        f"{name}_tail",
        f"""
SELECT * FROM (SELECT *, max(CASE WHEN glc_next IS NOT NULL THEN n0 END) OVER (PARTITION BY stay_id) AS n_last
               FROM {name}_counted WHERE n_glc > 1) WHERE n0 <= n_last""",
        f"{name}_counted",
    )
    step(
        f"{name}_head",
        f"""
SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY {order}) AS n FROM (
    SELECT *, row_number() OVER (ORDER BY stay_id, {order}) - 1 AS rn,
           CASE WHEN glc IS NULL THEN 1.0 ELSE 0.0 END AS msk0,
           CAST(count(*) OVER w - count(glc) OVER w AS DOUBLE) AS sum_msk0,
           count(glc) OVER w AS seen
    FROM {name}_tail WINDOW w AS (PARTITION BY stay_id ORDER BY {order} ROWS UNBOUNDED PRECEDING)
) WHERE seen > 0""",
        f"{name}_tail",
    )
    zero = [c for c in codes.ZERO_FILLED if c in ("input_hrs", "input_bolus_injection", "input_bolus_push")]
    dose = {
        c: f"CASE WHEN {c} > 50 THEN (SELECT median({c}) FROM {name}_head WHERE {c} > 0) ELSE coalesce({c}, 0) END"
        for c in zero
    }
    others = [c for c in codes.ZERO_FILLED if c not in zero] if source != "rows" else []
    fills = "".join(f", {e} AS {c}" for c, e in dose.items()) + "".join(f", coalesce({c}, 0) AS {c}" for c in others)
    step(
        f"{name}_gaps",
        f"""
SELECT * EXCLUDE ({", ".join([*zero, *others])}){fills},
       max(CASE WHEN glc IS NOT NULL THEN n END) OVER up AS n_a, min(CASE WHEN glc IS NOT NULL THEN n END) OVER down AS n_b
FROM {name}_head
WINDOW up AS (PARTITION BY stay_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       down AS (PARTITION BY stay_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        f"{name}_head",
    )
    step(
        name,
        f"""
SELECT g.* REPLACE (CASE WHEN g.glc IS NOT NULL THEN g.glc WHEN n_b IS NULL THEN a.glc
                         ELSE a.glc + (b.glc - a.glc) * (g.n - n_a) / (n_b - n_a) END AS glc),
       {minutes('timer', 'timer_next')} / 60 AS delta_t, {minutes('icu_intime', 'timer')} / 60 AS timer_d,
       {minutes('icu_intime', 'timer_next')} / 60 AS timer_next_d,
       CASE WHEN gender = 'M' THEN 1.0 ELSE 0.0 END AS gender_m,
       CASE WHEN g.glc_next IS NULL THEN 1.0 ELSE 0.0 END AS msk
FROM {name}_gaps g
LEFT JOIN (SELECT stay_id AS sa, n AS na, glc FROM {name}_head) a ON a.sa = g.stay_id AND a.na = g.n_a
LEFT JOIN (SELECT stay_id AS sb, n AS nb, glc FROM {name}_head) b ON b.sb = g.stay_id AND b.nb = g.n_b""",
        f"{name}_gaps",
    )


cohort_steps("cohort", "rows", "timer")
cohort_steps("clinical_cohort", "fed_kept", "timer")

# ------------------------------------------------------------------ forecasts and scores

step(
    "forecasts",
    f"""
SELECT event_id AS rn, user_id, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, user_id % 3 AS fold,
       ln(glc / 140) AS mu, 0.05 + CAST(k AS DOUBLE) / 100 AS sigma, ln(glc_next / 140) AS target, glc_next
FROM (SELECT *, lead(glc) OVER (PARTITION BY user_id ORDER BY ts) AS glc_next
      FROM (SELECT event_id, user_id, ts, 60 + 2 * value AS glc, {K} AS k FROM events WHERE event_type IN ('view', 'click')))
WHERE glc_next IS NOT NULL""",
)
step(
    "scored",
    """
SELECT model, fold, mu, CASE WHEN sigma * 3 > 2 THEN 2.0 ELSE sigma * 3 END AS sigma, target
FROM forecasts WHERE rn % 7 <> 0""",
    "forecasts",
)
step("stratum", "SELECT model, fold, mu, least(sigma, 2.0) AS sigma, target FROM forecasts WHERE user_id % 4 = 0", "forecasts")


def scoring(name: str, source: str, by: str, alpha: float) -> None:
    half = {0.05: 1.959963984540054, 0.2: 1.2815515655446004}[alpha]
    step(
        f"{name}_cdf",
        f"""
SELECT {by}, mu, sigma, target, z,
       0.5 + sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                 * exp(-pow(zc * k / 2000, 2) / 2)) * zc / 6000 / sqrt(2 * pi()) AS cdf
FROM (SELECT row_number() OVER () AS id, *, (target - mu) / sigma AS z,
             greatest(-10, least(10, (target - mu) / sigma)) AS zc FROM {source}), generate_series(0, 2000) AS g(k)
GROUP BY id, {by}, mu, sigma, target, z, zc""",
        source,
    )
    step(
        name,
        f"""
SELECT {by}, avg(sigma * (z * (2 * cdf - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps_mean,
       avg(-0.5 * ln(2 * pi()) - ln(sigma) - z * z / 2) AS ig_mean,
       avg(u - l + 2 / {alpha} * greatest(l - y, 0) + 2 / {alpha} * greatest(y - u, 0)) AS int_score_mean,
       var_pop(cdf) AS var_pit, avg(CAST(l < y AND y < u AS INT)) AS int_coverage, avg(u - l) AS int_av_width,
       median(u - l) AS int_med_width, sqrt(avg(pow(exp(mu) * 140 - y, 2))) AS rmse
FROM (SELECT *, exp(mu - {half} * sigma) * 140 AS l, exp(mu + {half} * sigma) * 140 AS u, exp(target) * 140 AS y
      FROM {name}_cdf)
GROUP BY {by}""",
        f"{name}_cdf",
    )


scoring("by_fold", "scored", "model, fold", 0.05)
scoring("by_model", "scored", "model", 0.05)
scoring("of_stratum", "stratum", "model", 0.2)

# ------------------------------------------------------------------ least squares per fold


def folded(name: str, k: int) -> None:
    """The cohort's scored rows with the label and one of `k` folds of stays."""
    step(
        name,
        f"""
SELECT c.*, ln(glc_next / 140) AS target, fold FROM cohort c
JOIN (SELECT stay_id AS s, ntile({k}) OVER (ORDER BY stay_id) - 1 AS fold FROM (SELECT DISTINCT stay_id FROM cohort)) ON s = c.stay_id
WHERE msk = 0""",
        "cohort",
    )


def least_squares(name: str, source: str, inputs, k: int) -> None:
    """Each row's `mu` and `v` from a fit on the other folds' rows.

    Inputs are made orthogonal one after the other on the rows of the fit; a row's fitted value is then the mean and,
    per input, its share. Missing inputs are 0; an input that the ones before it explain has no share.
    """
    x = [f"x{n}" for n in range(len(inputs))]

    def fitted(of: str) -> str:
        parts = [f"avg({of}) FILTER (train) OVER w"]
        parts += [f"coalesce({q} * sum({of} * {q}) FILTER (train) OVER w / nullif(CASE WHEN s{q} > 1e-9 * n THEN s{q} END, 0), 0)" for q in x]
        return " + ".join(parts)

    columns = ", ".join(f"coalesce({c}, 0) AS {q}" for c, q in zip(inputs, x))
    step(
        f"{name}_c",
        f"""
SELECT rn, fold, i AS fit, fold <> i AS train, target, count(*) FILTER (fold <> i) OVER (PARTITION BY i) AS n,
       {", ".join(f"{q} - avg({q}) FILTER (fold <> i) OVER (PARTITION BY i) AS {q}" for q in x)}
FROM (SELECT rn, fold, target, {columns} FROM {source}), generate_series(0, {k - 1}) AS g(i)""",
        source,
    )
    last = f"{name}_c"
    for n, q in enumerate(x):
        share = f"coalesce(sum({{0}} * {q}) FILTER (train) OVER w / nullif(CASE WHEN s{q} > 1e-9 * n THEN s{q} END, 0), 0) * {q}"
        rest = ", ".join(f"{later} - {share.format(later)} AS {later}" for later in x[n + 1 :])
        step(
            f"{name}_{q}",
            f"""
SELECT * {f"REPLACE ({rest})" if rest else ""} FROM (
    SELECT *, sum({q} * {q}) FILTER (train) OVER (PARTITION BY fit) AS s{q} FROM {last}) WINDOW w AS (PARTITION BY fit)""",
            last,
        )
        last = f"{name}_{q}"
    step(f"{name}_mu", f"SELECT *, {fitted('target')} AS mu FROM {last} WINDOW w AS (PARTITION BY fit)", last)
    step(f"{name}_e", f"SELECT *, (target - mu) ** 2 + 0.01 AS e FROM {name}_mu", f"{name}_mu")
    step(
        name,
        f"""
SELECT rn, fold, target, mu, v, CASE WHEN v >= 0 THEN sqrt(v) END AS sigma, 'LinearModel' AS model
FROM (SELECT *, {fitted('e')} AS v FROM {name}_e WINDOW w AS (PARTITION BY fit)) WHERE fit = fold""",
        f"{name}_e",
    )


INPUTS = ["glc", "input_bolus_push", "input_bolus_injection", "input_hrs", "admission_age", "gender_m", "weight", "diabetes_with_cc",
          "diabetes_without_cc", "n", "timer_d", "timer_next_d"]
folded("folded3", 3)
folded("folded2", 2)
least_squares("linear3", "folded3", INPUTS, 3)
least_squares("linear2", "folded2", INPUTS, 2)
least_squares("linear3_fixed", "folded3", [c for c in INPUTS if c != "input_hrs"], 3)
least_squares("linear3_two", "folded3", ["glc", "n"], 3)
step("linear3_known", "SELECT * FROM linear3 WHERE sigma IS NOT NULL", "linear3")
scoring("linear3_scores", "linear3_known", "model, fold", 0.05)

step(
    "simulated_folded",
    """
SELECT *, ln(glucose_t_obs_next / 140) AS target, glucose_t_obs + id % 7 AS glucose_t, ntile_of - 1 AS fold FROM (
    SELECT *, row_number() OVER (ORDER BY id, t) - 1 AS rn FROM simulated_next)
JOIN (SELECT s, ntile(3) OVER (ORDER BY s) AS ntile_of FROM (
    SELECT DISTINCT id AS s FROM simulated_next WHERE obs AND glucose_t_obs_next IS NOT NULL)) ON s = id
WHERE obs AND glucose_t_obs_next IS NOT NULL""",
    "simulated_next",
)
least_squares("simulated_linear", "simulated_folded", ["glucose_t", "n", "t", "t1"], 3)

# ------------------------------------------------------------------ final statements

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, *needs: str) -> None:
    ORACLES[name] = f"{chain(*needs)}\n{select}" if needs else select


def plain(name: str, source: str, kinds: str, digits: int = 6, where: str = "") -> None:
    oracle(name, f"SELECT {pick(kinds, digits)} FROM {source} {where}", source)


plain("readings_raw", "readings_raw", "i:subject_id hadm_id stay_id t:charttime storetime r:glucose i:item_glc")
plain("readings_clean", "readings_clean", "i:subject_id hadm_id stay_id t:charttime r:glucose glucose_lab p:glcsource")
T_KINDS = (
    "i:subject_id hadm_id stay_id t:starttime endtime r:amount rate originalrate i:itemid p:ordercategoryname insulintype "
    "insulinadmin i:infxstop"
)
for q, s in (
    ("treatments_raw", "treatments_raw"),
    ("boluses_capped", "boluses"),
    ("infusions_capped", "infusions"),
    ("treatments_clean", "treatments_clean"),
):
    plain(q, s, T_KINDS)
ORACLES["boluses_capped_by_parts"] = ORACLES["boluses_capped"]
ORACLES["boluses_capped_by_sketch"] = ORACLES["boluses_capped"]
oracle(
    "limits_from_parts",
    """
SELECT kind, count(DISTINCT v) AS n_distinct, TRUE AS near FROM (
    SELECT CASE WHEN insulinadmin = 'INFUSION' THEN 'infusion' ELSE 'bolus' END AS kind,
           CASE WHEN insulinadmin = 'INFUSION' THEN coalesce(rate, originalrate) ELSE amount END AS v
    FROM treatments_raw WHERE upper(insulintype) = 'SHORT' AND insulinadmin IS NOT NULL) GROUP BY kind""",
    "treatments_raw",
)
plain(
    "parenteral_components",
    "parenteral",
    "i:stay_id t:starttime endtime r:dextrose_fluid tpn i:tpn_lipids r:dextrose_tpn lipids_tpn amino_acids_tpn lipids_10_20",
)
plain("parenteral_rates", "parenteral_rates", "i:stay_id t:timer starttime endtime r:tpn_length dextrose_fluid tpn_rate")
oracle(
    "solution_units",
    f"""
SELECT CAST(itemid AS BIGINT) AS itemid,
       CASE WHEN amountuom = 'mL' AND itemid IN ({values(codes.DEXTROSE_SOLUTIONS)}) THEN 'grams' ELSE amountuom END AS unit,
       count(*) AS n FROM orders_raw GROUP BY ALL""",
    "orders_raw",
)
NUTRIENT_COLS = " ".join(f"{n}_enteral" for n in codes.NUTRIENTS)
plain("enteral_amounts", "enteral", f"i:stay_id hadm_id subject_id t:starttime endtime r:amount_enteral {NUTRIENT_COLS}")
plain(
    "enteral_rates",
    "enteral_rates",
    f"i:stay_id hadm_id subject_id t:timer starttime endtime r:enteral_length enteral_rate {NUTRIENT_COLS}",
)
ATTRIBUTE_KINDS = (
    "i:diabetes_without_cc diabetes_with_cc r:weight p:gender t:admittime dischtime icu_intime icu_outtime "
    "r:los_hospital admission_age los_icu p:ethnicity i:hospital_expire_flag hospstay_seq icustay_seq "
    "p:first_hosp_stay first_icu_stay"
)
DOD = ", CAST(dod AS VARCHAR) AS dod"


def attributed(name: str, source: str, kinds: str) -> None:
    oracle(name, f"SELECT {pick(kinds + ' ' + ATTRIBUTE_KINDS)}{DOD} FROM {source}", source)


TIMELINE_KINDS = (
    "i:subject_id hadm_id stay_id t:timer glctimer r:glc glc_lab p:glcsource t:starttime endtime r:input input_hrs "
    "p:insulintype event i:infxstop"
)
attributed("stay_attributes", "stay_attributes", "i:subject_id hadm_id stay_id")
plain("clinical_timeline", "clinical_timeline", TIMELINE_KINDS)
attributed("stay_timeline", "stay_timeline", TIMELINE_KINDS)
attributed("stay_timeline_long", "clinical_long", TIMELINE_KINDS + " t:timer_next")
WIDE_KINDS = (
    "i:subject_id hadm_id stay_id t:timer timer_next timer_prev glctimer starttime endtime p:glcsource "
    "r:glc glc_next glc_lab input_bolus_push input_bolus_injection input_hrs"
)
FED_KINDS = f"{WIDE_KINDS} r:{' '.join(ENTERAL)} tpn_rate dextrose_fluid t:ent_starttime ent_endtime"
attributed("wide_with_nutrition", "fed_kept", FED_KINDS)
attributed(
    "clinical_cohort",
    "clinical_cohort",
    FED_KINDS + " i:rn n r:msk0 sum_msk0 delta_t timer_d timer_next_d gender_m msk",
)

oracle(
    "pairing_rule_counts",
    f"SELECT {i('rule')}, count(*) AS n, {r('sum(glc_al)', 'sum_glc')} FROM paired90 GROUP BY rule",
    "paired90",
)
PAIR_KINDS = "i:stay_id hadm_id t:timer r:glc_al t:glctimer_al p:glcsource_al i:rule"
plain("paired_within_90_minutes", "paired90", PAIR_KINDS)
plain("paired_within_720_minutes", "paired720", PAIR_KINDS)
plain("paired_one_reading_per_rule", "paired_same", PAIR_KINDS)
plain("repeated_readings", "paired720_flagged", "i:stay_id t:timer glctimer_al i:repeated")
plain("long_timeline", "simple_long", TIMELINE_KINDS + " t:timer_next")
plain("wide_timeline", "simple_wide", WIDE_KINDS)
plain("wide_timeline_without_fan_out", "simple_wide", WIDE_KINDS, where=f"WHERE stay_id NOT IN ({FAN_OUT.format('simple_wide')})")

step(
    "probes",
    """
SELECT stay_id, timer, glc, lag(timer) OVER (PARTITION BY stay_id ORDER BY timer) AS timer_prev
FROM timeline WHERE glc IS NOT NULL""",
    "timeline",
)
step(
    "intervals",
    """
SELECT stay_id, starttime AS from_time, starttime + INTERVAL 600 MINUTE AS to_time, input_hrs, input
FROM timeline WHERE event = 'INFUSION'""",
    "timeline",
)
oracle(
    "points_between_rows",
    f"""
SELECT p.stay_id, {t('p.timer', 'timer')}, {r('sum(b.input)', 'dose')} FROM probes p
LEFT JOIN (SELECT * FROM timeline WHERE event = 'BOLUS_PUSH') b
ON b.stay_id = p.stay_id AND b.starttime >= p.timer_prev AND b.starttime < p.timer GROUP BY p.stay_id, p.timer""",
    "probes",
)
IN_FORCE = "probes p LEFT JOIN intervals v ON v.stay_id = p.stay_id AND v.from_time <= p.timer AND p.timer < v.to_time"
oracle(
    "averages_in_force",
    f"""
SELECT p.stay_id, {t('p.timer', 'timer')}, {t('p.timer_prev', 'timer_prev')}, {r('p.glc', 'glc')},
       {r('avg(v.input_hrs)', 'rate')}, {t('min(v.from_time)', 'first_start')}, {t('max(v.to_time)', 'last_end')},
       nullif(count(v.stay_id), 0) AS n_in_force
FROM {IN_FORCE} GROUP BY p.stay_id, p.timer, p.timer_prev, p.glc""",
    "probes",
    "intervals",
)
ORACLES["sweep_in_force"] = ORACLES["averages_in_force"]
oracle(
    "extreme_rates_in_force",
    f"""
SELECT p.stay_id, {t('p.timer', 'timer')}, nullif(count(v.stay_id), 0) AS n_in_force,
       {r('avg(v.rate) / pow(2.0, 66)', 'rate_huge')}, {r('CASE WHEN avg(v.rate) < 1 THEN avg(v.rate) * pow(2.0, 63) END', 'rate_tiny')}
FROM probes p LEFT JOIN (
    SELECT *, input * CASE WHEN stay_id % 3 = 0 OR (stay_id % 3 = 2 AND input % 2 = 0) THEN pow(2.0, 66) ELSE pow(2.0, -63) END AS rate
    FROM intervals) v ON v.stay_id = p.stay_id AND v.from_time <= p.timer AND p.timer < v.to_time
GROUP BY p.stay_id, p.timer""",
    "probes",
    "intervals",
)
ORACLES["price_medians"] = f"""
SELECT l_returnflag, l_linestatus, {r('median(l_extendedprice)', 'median_price')},
       {r('(SELECT median(-l_extendedprice) FROM lineitem)', 'median_negated')}
FROM lineitem GROUP BY ALL"""
ORACLES["neighbours_within_one_time"] = f"""
WITH x AS (SELECT user_id, event_id, value,
                  CASE user_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 2 THEN ts END AS t FROM events)
SELECT user_id, event_id, {r('value')}, {t('t')}, {r('lag(value) OVER w', 'before')}, lead(event_id, 2) OVER w AS after,
       row_number() OVER w AS n, {r('max(value) OVER (w ROWS UNBOUNDED PRECEDING)', 'highest')},
       count(*) OVER (PARTITION BY user_id) AS size
FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t NULLS FIRST, event_id)"""
oracle(
    "nutrition_with_repeated_rows",
    f"""
SELECT p.stay_id, {t('p.timer', 'timer')}, {t('p.timer_prev', 'timer_prev')}, {r('p.glc', 'glc')},
       {", ".join(r('e.' + c, c) for c in ENTERAL)}, {t('e.ent_starttime', 'ent_starttime')},
       {t('e.ent_endtime', 'ent_endtime')}, {r('q.tpn_rate', 'tpn_rate')}, {r('d.given', 'dextrose_fluid')}
FROM probes p
LEFT JOIN (SELECT p.stay_id, p.timer, {", ".join(f"avg({c}) AS {c}" for c in ENTERAL)},
                  min(x.starttime) AS ent_starttime, max(x.endtime) AS ent_endtime
           FROM probes p JOIN enteral_rates x ON x.stay_id = p.stay_id AND p.timer >= x.starttime AND p.timer < x.endtime
           GROUP BY p.stay_id, p.timer) e ON e.stay_id = p.stay_id AND e.timer = p.timer
LEFT JOIN parenteral_rates q ON q.tpn_rate IS NOT NULL AND q.stay_id = p.stay_id
    AND p.timer >= q.starttime AND p.timer < q.endtime
LEFT JOIN (SELECT p.stay_id, p.timer, sum(x.dextrose_fluid) AS given
           FROM probes p JOIN parenteral_rates x ON x.stay_id = p.stay_id AND x.starttime >= p.timer_prev
                AND x.starttime < p.timer GROUP BY p.stay_id, p.timer) d ON d.stay_id = p.stay_id AND d.timer = p.timer""",
    "probes",
    "enteral_rates",
    "parenteral_rates",
)
oracle(
    "rows_in_force",
    f"""
SELECT p.stay_id, {t('p.timer', 'timer')}, {t('p.timer_prev', 'timer_prev')}, {r('p.glc', 'glc')},
       {t('v.from_time', 'from_time')}, {t('v.to_time', 'to_time')}, {r('v.input_hrs', 'input_hrs')}, {r('v.input', 'input')}
FROM {IN_FORCE}""",
    "probes",
    "intervals",
)
oracle(
    "row_quality",
    """
SELECT 'duplicate_readings' AS check_name, count(*) AS n_rows FROM (
    SELECT 1 FROM stay_timeline WHERE glctimer IS NOT NULL GROUP BY stay_id, glctimer, glc, glcsource HAVING count(*) > 1)
UNION ALL SELECT 'stay_unknown', count(*) FROM stay_timeline WHERE stay_id IS NULL
UNION ALL SELECT 'timer_unknown', count(*) FROM stay_timeline WHERE timer IS NULL
UNION ALL SELECT 'unpaired', count(*) FROM stay_paired WHERE insulintype IS NOT NULL AND rule IS NULL""",
    "stay_paired",
)

oracle(
    "readings_per_stay",
    f"""
SELECT stay_id, {t('timer')}, row_number() OVER (PARTITION BY stay_id ORDER BY timer) AS n,
       count(*) OVER (PARTITION BY stay_id) AS size FROM rows""",
    "rows",
)
oracle(
    "stays_with_readings",
    f"""
SELECT {pick('i:stay_id t:timer r:glc')} FROM rows
WHERE stay_id IN (SELECT stay_id FROM rows GROUP BY stay_id HAVING count(glc) >= 27)""",
    "rows",
)
oracle(
    "trailing_trim",
    f"""
SELECT {pick('i:stay_id t:timer r:glc glc_next')} FROM rows a
WHERE timer <= (SELECT max(timer) FROM rows b WHERE b.stay_id = a.stay_id AND b.glc_next IS NOT NULL)""",
    "rows",
)
oracle(
    "leading_trim",
    f"""
SELECT {pick('i:stay_id t:timer r:glc')}, row_number() OVER w AS n,
       CASE WHEN glc IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS msk0,
       CAST(missing_before + count(*) OVER w - count(glc) OVER w AS DOUBLE) AS sum_msk0
FROM (SELECT a.*, (SELECT count(*) FROM rows c WHERE c.stay_id = a.stay_id AND c.timer < f.first_time) AS missing_before
      FROM rows a JOIN (SELECT stay_id AS s, min(timer) AS first_time FROM rows WHERE glc IS NOT NULL GROUP BY stay_id) f
      ON f.s = a.stay_id AND a.timer >= f.first_time)
WINDOW w AS (PARTITION BY stay_id ORDER BY timer ROWS UNBOUNDED PRECEDING)""",
    "rows",
)
step("numbered", "SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY timer) AS pos FROM rows", "rows")
oracle(
    "interpolated",
    f"""
SELECT g.stay_id, {t('g.timer', 'timer')},
       {r('''CASE WHEN g.glc IS NOT NULL THEN g.glc WHEN a.pos IS NULL AND b.pos - g.pos <= 2 THEN b.glc
             WHEN a.pos IS NULL THEN NULL WHEN b.pos IS NULL THEN a.glc
             ELSE a.glc + (b.glc - a.glc) * (g.pos - a.pos) / (b.pos - a.pos) END''', 'glc')}
FROM numbered g
ASOF LEFT JOIN (SELECT * FROM numbered WHERE glc IS NOT NULL) a ON a.stay_id = g.stay_id AND g.pos >= a.pos
ASOF LEFT JOIN (SELECT * FROM numbered WHERE glc IS NOT NULL) b ON b.stay_id = g.stay_id AND g.pos <= b.pos""",
    "numbered",
)
LIMITED = ", ".join(
    r(f"CASE WHEN {c} > 15 THEN (SELECT median({c}) FROM rows WHERE {c} > 0) ELSE {c} END", c) for c in codes.DOSE_COLUMNS
)
oracle("doses_without_outliers", f"SELECT stay_id, {t('timer')}, {LIMITED} FROM rows", "rows")
oracle(
    "masks_and_clocks",
    f"""
SELECT stay_id, {t('timer')}, CAST(gender = 'M' AS DOUBLE) AS gender_m, CAST(glc_next IS NULL AS DOUBLE) AS msk,
       {r(minutes('icu_intime', 'timer') + ' / 60', 'timer_d')}, {r(minutes('icu_intime', 'timer_next') + ' / 60', 'timer_next_d')},
       {r(minutes('timer', 'timer_next') + ' / 60', 'delta_t')}, {", ".join(r(f'coalesce({c}, 0)', c) for c in codes.DOSE_COLUMNS)}
FROM rows""",
    "rows",
)
plain(
    "modelling_cohort",
    "cohort",
    "i:rn stay_id n t:timer r:glc glc_next msk msk0 sum_msk0 timer_d timer_next_d delta_t gender_m "
    + " ".join(codes.DOSE_COLUMNS),
)
oracle(
    "cohort_audit",
    f"""
SELECT count(*) AS n_rows, count(*) FILTER (glc_next IS NULL) AS no_target,
       count(*) FILTER ({minutes('timer', 'timer_next')} = 0) AS zero_gap, count(*) FILTER (glc IS NULL) AS no_value FROM rows""",
    "rows",
)
oracle(
    "cohort_summary",
    f"""
SELECT count(DISTINCT stay_id) AS stays, count(DISTINCT hadm_id) AS admissions, count(DISTINCT subject_id) AS patients,
       (SELECT {r('median(a)', 'a')} FROM (SELECT min(admission_age) AS a FROM rows GROUP BY stay_id)) AS median_age,
       (SELECT CAST(sum(d) AS BIGINT) FROM (SELECT max(diabetes_without_cc) AS d FROM rows GROUP BY hadm_id)) AS diabetes,
       (SELECT CAST(sum(d) AS BIGINT) FROM (SELECT max(diabetes_with_cc) AS d FROM rows GROUP BY hadm_id)) AS diabetes_complicated,
       {r('sqrt(avg((glc - glc_next) ** 2))', 'no_change_rmse')}
FROM rows""",
    "rows",
)
oracle(
    "no_change_error_by_stay",
    f"SELECT stay_id, {r('sqrt(avg((glc - glc_next) ** 2))', 'rmse')} FROM rows GROUP BY stay_id",
    "rows",
)


def histogram(name: str, value: str, source: str, bins: int, *needs: str) -> None:
    head = (chain(*needs) + ", ") if needs else "WITH "
    ORACLES[name] = f"""{head}x AS MATERIALIZED (SELECT CAST({value} AS DOUBLE) AS v FROM {source}),
ends AS MATERIALIZED (SELECT min(v) AS lo, max(v) AS hi FROM x),
placed AS (SELECT CASE WHEN v = hi THEN {bins - 1} ELSE CAST(floor((v - lo) * {bins} / (hi - lo)) AS BIGINT) END AS bin
           FROM x, ends WHERE v IS NOT NULL)
SELECT b.bin AS bin, round(lo + b.bin * (hi - lo) / {bins}, 6) AS from_value,
       round(lo + (b.bin + 1) * (hi - lo) / {bins}, 6) AS to_value, count(p.bin) AS n
FROM generate_series(0, {bins - 1}) AS b(bin) LEFT JOIN placed p ON p.bin = b.bin, ends GROUP BY b.bin, lo, hi"""


GAP = f"{minutes('timer', 'timer_next')} / 60"
histogram("gap_histogram", GAP, f"rows WHERE {GAP} < 24", 30, "rows")
histogram("price_histogram", "l_extendedprice", "lineitem", 50)
histogram("value_change_histogram", "glc - glc_next", "rows", 60, "rows")
ORACLES["numbered_rows"] = (
    f"SELECT event_id, user_id, {t('ts')}, row_number() OVER (ORDER BY user_id, ts) - 1 AS rn FROM events"
)
ORACLES["numbered_csv"] = f"""
SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rn, o_orderkey, o_custkey, {r('o_totalprice')} FROM orders"""
step(
    "simulated",
    """
SELECT user_id AS id, date_sub('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600 + event_id / 1e9 AS t,
       event_type IN ('view', 'click') AS obs, 60 + 2 * value AS glucose_t_obs, value / 20 AS insulin_t FROM events""",
)
step(
    "simulated_next",
    """
SELECT s.*, o.glucose_t_obs_next, o.t1, o.n FROM simulated s
LEFT JOIN (SELECT id, t, lead(glucose_t_obs) OVER w AS glucose_t_obs_next, lead(t) OVER w AS t1, row_number() OVER w AS n
           FROM simulated WHERE obs WINDOW w AS (PARTITION BY id ORDER BY t)) o ON o.id = s.id AND o.t = s.t AND s.obs""",
    "simulated",
)
oracle(
    "next_observed_value",
    f"""
SELECT {pick('i:id r:t p:obs r:glucose_t_obs insulin_t glucose_t_obs_next t1 i:n')},
       CASE WHEN obs THEN CAST(0 AS BIGINT) END AS msk, CASE WHEN obs THEN CAST(0 AS BIGINT) END AS msk0 FROM simulated_next""",
    "simulated_next",
)
plain(
    "only_observed_rows",
    "simulated_next",
    "i:id r:t glucose_t_obs glucose_t_obs_next t1 i:n",
    where="WHERE obs AND glucose_t_obs_next IS NOT NULL",
)
ORACLES["customer_folds"] = f"""
SELECT {i('fold')}, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_custkey) AS first_customer,
       max(o_custkey) AS last_customer, {r('sum(o_totalprice)', 'total', 2)}
FROM orders JOIN (SELECT o_custkey AS c, ntile(3) OVER (ORDER BY o_custkey) - 1 AS fold
                  FROM (SELECT DISTINCT o_custkey FROM orders)) ON c = o_custkey GROUP BY fold"""
KEPT = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
ORACLES["orders_in_and_out"] = f"""
SELECT CASE WHEN {KEPT} THEN 'kept' ELSE 'dropped' END AS side, count(*) AS n, {r('sum(o_totalprice)', 'total', 2)}
FROM orders GROUP BY 1"""
ORACLES["customers_with_orders"] = "SELECT DISTINCT o_custkey FROM orders"
ORACLES["customer_split"] = """
SELECT held_out, CAST(CASE WHEN held_out THEN ceil(0.1 * n) ELSE n - ceil(0.1 * n) END AS BIGINT) AS customers
FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders), (VALUES (TRUE), (FALSE)) AS v(held_out)"""
ORACLES["customer_split_covers"] = f"""
SELECT o_custkey, CAST(1 AS BIGINT) AS sides, count(*) AS n, {r('sum(o_totalprice)', 'total')} FROM orders GROUP BY o_custkey"""
ORACLES["first_orders"] = f"""
SELECT o_custkey, o_orderkey, {r('o_totalprice')} FROM orders ORDER BY o_custkey, o_orderkey LIMIT 8000"""
LAGS = ", ".join(
    r(f"lag({c}, {k}) OVER w", f"{c}_s{k}") for c in ("glc", "input_hrs") for k in range(1, 6)
)
oracle(
    "lagged_doses",
    f"""
SELECT stay_id, {t('timer')}, {LAGS},
       {r(minutes('icu_intime', 'timer_next') + ' / 60 - ' + minutes('icu_intime', 'timer') + ' / 60', 'delta_t')}
FROM rows WINDOW w AS (PARTITION BY stay_id ORDER BY timer)""",
    "rows",
)


def log140(c: str) -> str:
    return f"CASE WHEN {c} > 0 THEN ln({c} / 140) ELSE {c} END"


STATIC = ["admission_age", "gender_m", "weight", "diabetes_with_cc", "diabetes_without_cc"]
SCALED = ", ".join(
    r(f"coalesce(({c} - {c}_m) / (CASE WHEN {c}_s > 0 THEN {c}_s ELSE 1 END), 0)", c) for c in STATIC
)
FITTED = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in STATIC)
oracle(
    "scaled_features",
    f"""
SELECT {i('rn')}, {r(log140('glc'), 'glc')}, {r(log140('glc_next'), 'glc_next')}, {r('input_hrs / 20', 'input_hrs')},
       {r('input_bolus_push / 20', 'input_bolus_push')}, {r('input_bolus_injection / 30', 'input_bolus_injection')}, {SCALED}
FROM cohort, (SELECT {FITTED} FROM cohort WHERE stay_id % 5 <> 0)""",
    "cohort",
)
oracle(
    "sequence_lengths",
    f"""
SELECT stay_id, count(*) AS seqlen, {i('arg_min(rn, n)', 'first_key')}, {i('arg_max(rn, n)', 'last_key')},
       {r('coalesce(sum(glc_next), 0)', 'sum_target')}, {r('arg_min(admission_age, n)', 'age')},
       {r('arg_max(glc, n)', 'last_value')}, {r('arg_min(timer_next_d, n)', 'first_end')},
       {r('arg_min(input_hrs, n)', 'first_rate')}
FROM cohort WHERE n <= 40 GROUP BY stay_id""",
    "cohort",
)
oracle(
    "padded_batches",
    """
SELECT batch, stay_id, seqlen, sum_rates, sum_ends, max(seqlen) OVER (PARTITION BY batch) AS padded_len,
       max(seqlen) OVER (PARTITION BY batch) - seqlen AS pad_keys,
       CAST(masked + max(seqlen) OVER (PARTITION BY batch) - seqlen AS BIGINT) AS masked, CAST(5 AS BIGINT) AS width
FROM (SELECT stay_id, count(*) AS seqlen, sum(msk) AS masked, """ + f"""{r('coalesce(sum(input_hrs), 0)', 'sum_rates', digits=4)},
             {r('coalesce(sum(timer_next_d), 0)', 'sum_ends', digits=4)}, (row_number() OVER (ORDER BY stay_id) - 1) // 32 AS batch
      FROM cohort GROUP BY stay_id)""",
    "cohort",
)
oracle(
    "sequences_of_large_keys",
    f"""
SELECT stay_id, seg, count(*) AS seqlen, any_value(steps) AS steps, {i('arg_min(rn, n) + 3000000000', 'first_key')},
       {r('coalesce(sum(timer_next_d), 0)', 'sum_ends', digits=4)}
FROM (SELECT *, (n - 1) // 7 AS seg, count(*) OVER (PARTITION BY stay_id) AS steps FROM cohort) GROUP BY stay_id, seg""",
    "cohort",
)
oracle("unpadded_targets", f"SELECT {i('rn', 'key')}, {r('glc_next', 'y')} FROM cohort WHERE msk = 0", "cohort")
step("steps", "SELECT *, rn / 1000 AS t0, rn / 1000 + 1 AS t1 FROM forecasts", "forecasts")
oracle(
    "time_grid",
    f"SELECT {pick('i:rn r:t0 t1')}, CAST(k AS BIGINT) AS k, {r('t0 + (t1 - t0) * k / 4', 'ts')} FROM steps, generate_series(0, 4) AS g(k)",
    "steps",
)
ORACLES["flattened_steps"] = f"""
SELECT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS step,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_discount) - 1 AS k,
       {r('l_quantity', 'mu')}, {r('l_discount', 'sigma')} FROM lineitem"""
oracle(
    "observed_series",
    f"""
SELECT user_id, CAST(0 AS BIGINT) AS k, {r('min(t0)', 't')}, {r('arg_min(mu, t0)', 'y')} FROM steps GROUP BY user_id
UNION ALL
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t0), {r('t1', 't')}, {r('target', 'y')} FROM steps""",
    "steps",
)
LEVELS = ", ".join(f"({n}, CAST({x!r} AS DOUBLE))" for n, x in enumerate(fan_levels()))
oracle(
    "fan_bands",
    f"""
SELECT rn, {r('mu')}, {r('sigma')}, {r('t0', 'ts')}, CAST(band AS BIGINT) AS band, {r('level')},
       {r('140 * exp(mu - level * sigma)', 'lower')}, {r('140 * exp(mu + level * sigma)', 'upper')}
FROM steps, (VALUES {LEVELS}) AS v(band, level) WHERE t0 < 8""",
    "steps",
)
SCORES = "r:" + " ".join(codes.METRICS)
plain("scores_by_model_and_fold", "by_fold", f"p:model i:fold {SCORES}", 5)
plain("scores_by_model", "by_model", f"p:model {SCORES}", 5)
plain("scores_of_one_stratum", "of_stratum", f"p:model {SCORES}", 5)
oracle(
    "point_scores",
    f"""
SELECT model, {i('fold')}, {r('sqrt(avg((140 * exp(mu) - 140 * exp(target)) ** 2))', 'rmse', 5)} FROM scored GROUP BY model, fold""",
    "scored",
)
OWN = "(-0.5 * ln(2 * pi()) - ln(0.05))"
oracle(
    "training_losses",
    f"""
SELECT model, count(*) AS n, {r('sum(-lp)', 'nll', 3)}, {r('avg(-lp)', 'nll_mean', 3)}, {r('sum(e * e)', 'sse', 3)},
       {r('sum(0.5 * ln(2 * pi()) + ln(sigma + 1e-5) + (target - mu) ** 2 / (2 * (sigma + 1e-5) ** 2))', 'nll_update', 3)},
       {r('sqrt(avg(e * e))', 'rmse', 3)}, {r(f'sum(exp{OWN} * ({OWN} - lp))', 'update_divergence', 3)},
       {r('sum((mu - target) ** 2)', 'sse_link', 3)}
FROM (SELECT *, -0.5 * ln(2 * pi()) - ln(sigma) - (target - mu) ** 2 / (2 * sigma ** 2) AS lp,
             140 * exp(mu) - 140 * exp(target) AS e FROM scored) GROUP BY model""",
    "scored",
)
SUMMARY = ", ".join(
    f"{r(f'avg({c})', f'{c}_mean', 5)}, {r(f'stddev_samp({c})', f'{c}_std', 5)}"
    for c in ("crps_mean", "rmse", "int_coverage", "ig_mean")
)
oracle("metric_summary", f"SELECT model, {SUMMARY} FROM by_fold GROUP BY model", "by_fold")
oracle(
    "metrics_long",
    "SELECT model, CAST(fold AS BIGINT) AS fold, measurement, round(value, 5) AS value, "
    "CASE model WHEN 'even' THEN 'Even ids' ELSE 'Odd ids' END AS model_name FROM ("
    + " UNION ALL ".join(
        f"SELECT model, fold, '{c}' AS measurement, {'-' if c == 'ig_mean' else ''}{c} AS value FROM by_fold"
        for c in ("rmse", "crps_mean", "ig_mean")
    )
    + ")",
    "by_fold",
)
ORACLES["last_order_per_customer"] = f"""
SELECT o_custkey, o_orderkey, {r('o_totalprice')}, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"""
oracle(
    "saved_predictions",
    f"""
SELECT model, {i('fold')}, count(*) AS n, {r('sum(mu)', 'sum_mu')}, {r('sum(sigma)', 'sum_sigma')} FROM forecasts GROUP BY model, fold""",
    "forecasts",
)
oracle(
    "runs_from_files",
    f"""
SELECT model, {i('fold')}, 1 + {i('fold')[: -len(' AS fold')]} AS run, count(*) AS n, {r('sum(mu)', 'sum_mu')}
FROM forecasts GROUP BY model, fold""",
    "forecasts",
)
oracle(
    "metrics_from_files",
    f"""
SELECT 'version_' || (fold + 1 + CASE model WHEN 'odd' THEN 10 ELSE 0 END) AS run_folder, model,
       {r('crps_mean', digits=5)}, {r('rmse', digits=5)}
FROM by_fold WHERE NOT (model = 'odd' AND fold = 2)""",
    "by_fold",
)
oracle(
    "swept_results",
    f"""
SELECT CAST(value AS BIGINT) AS value, model, {r('rmse', digits=5)}, ig_mean FROM (
    SELECT 1 AS value, model, rmse, {r('ig_mean', digits=5)} FROM by_model
    UNION ALL SELECT 2, model, rmse, NULL FROM by_model)""",
    "by_model",
)
ORACLES["linear_price_model"] = f"""
WITH x AS (SELECT *, l_extendedprice / 10000 AS y, l_quantity AS q FROM lineitem),
a AS MATERIALIZED (SELECT regr_intercept(y, q) AS a0, regr_slope(y, q) AS a1 FROM x WHERE l_orderkey % 2 = 0),
b AS MATERIALIZED (SELECT regr_intercept((y - a0 - a1 * q) ** 2 + 0.01, q) AS b0,
                          regr_slope((y - a0 - a1 * q) ** 2 + 0.01, q) AS b1 FROM x, a WHERE l_orderkey % 2 = 0)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r('l_quantity')}, {r('y', 'target')},
       {r('a0 + a1 * q', 'mu')}, {r('CASE WHEN b0 + b1 * q >= 0 THEN sqrt(b0 + b1 * q) END', 'sigma')}
FROM x, a, b WHERE l_orderkey % 2 = 1"""
plain("linear_fold_predictions", "linear3", "i:rn fold r:mu sigma target p:model", 5)
plain("linear_folds", "linear3_scores", f"p:model i:fold {SCORES}", 4)
SWEPT = [
    ("roles", "all", "NULL", "linear3", True), ("roles", "without_interventions", "NULL", "linear3_fixed", True),
    ("roles", "glc+n", "NULL", "linear3_two", True), ("task", "gaussian", "NULL", "linear3", True),
    ("task", "conditional_expectation", "NULL", "linear3", False), ("k", "2", "2", "linear2", True), ("k", "3", "3", "linear3", True),
]
oracle(
    "linear_sweep",
    " UNION ALL ".join(
        f"SELECT model, {i('fold')}, '{param}' AS param, '{value}' AS value, CAST({number} AS DOUBLE) AS number, "
        f"{r('sqrt(avg((140 * exp(mu) - 140 * exp(target)) ** 2))', 'rmse', 4)} FROM {source} "
        f"{'WHERE sigma IS NOT NULL' if known else ''} GROUP BY model, fold"
        for param, value, number, source, known in SWEPT
    ),
    "linear3", "linear2", "linear3_fixed", "linear3_two",
)
plain("simulated_fold_predictions", "simulated_linear", "i:rn fold r:mu sigma target p:model", 5)
plain("role_columns", "cohort", "i:rn stay_id r:glc_next glc input_hrs i:diabetes_with_cc diabetes_without_cc n r:timer_d timer_next_d")
plain("interval_scores", "by_model", "p:model r:int_score_mean int_coverage int_av_width int_med_width", 5)
plain("appended_metrics", "by_fold", f"p:model i:fold {SCORES}", 5)
ORACLES["sample_is_whole_stays"] = "SELECT least(20, count(DISTINCT user_id)) AS n_stays, TRUE AS whole FROM events"
oracle("exported_cohort", f"SELECT {pick('i:rn stay_id t:timer r:glc glc_next i:n')}, CAST(1 AS BIGINT) AS sides FROM cohort", "cohort")
oracle(
    "held_out_stays",
    """
SELECT held_out, CAST(CASE WHEN held_out THEN ceil(0.1 * k) ELSE k - ceil(0.1 * k) END AS BIGINT) AS stays
FROM (SELECT count(DISTINCT stay_id) AS k FROM cohort), (VALUES (TRUE), (FALSE)) AS v(held_out)""",
    "cohort",
)
ORACLES["sorted_view"] = f"""
SELECT o_orderkey, {r('o_totalprice')}, customer FROM (
    SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS customer FROM orders)
ORDER BY customer NULLS FIRST, o_totalprice, o_orderkey LIMIT 700"""
