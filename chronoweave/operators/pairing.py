"""Pairing each treatment with the reading it most plausibly answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.clock import minutes_between
from chronoweave.operators.ordered import with_neighbours
from chronoweave.operators.splits import Splits

# fixed values
TREATMENT_EVENTS = ("BOLUS_INJECTION", "BOLUS_PUSH", "INFUSION")
READING_SOURCES = ("BLOOD", "FINGERSTICK")
FAST_TYPE = "SHORT"
# rule code reported for each clause, clause 1 first
RULE_CODES = (1, 3, 4, 4, 4, 4, 1, 2)

_NEIGHBOURS = {"p2": -2, "p1": -1, "n1": 1, "n2": 2}


def timeline_order(df: DataFrame) -> list[str | Column]:
    """Time, then readings before treatments, then the other columns, so that equal times have one order."""
    last = ["event", "glcsource", "glc", "starttime", "endtime", "input", "input_hrs", "stay_id", "icu_intime"]
    return ["timer", F.col("event").isNotNull(), *[F.col(c) for c in last if c in df.columns]]


def pair_events(
    df: DataFrame,
    partition: str = "hadm_id",
    tolerance_min: int = 90,
    floor: float = 90.0,
    strict_reference: bool = True,
    splits: Splits | None = None,
) -> DataFrame:
    """Add `glc_al`, `glctimer_al`, `glcsource_al` and `rule` to every row (NULL where nothing pairs).

    Eight clauses are tried in turn on the two rows before (p2, p1) and after (n1, n2). By default the four
    outputs keep the original's small differences (which insulin types clauses 2 and 6 ask for), so value and
    source can describe different readings; `strict_reference=False` uses one reading of clause 6 for all.
    """

    def neighbours(w) -> dict[str, Column]:
        columns = {}
        for tag, step in _NEIGHBOURS.items():
            def at(c: Column, step=step) -> Column:
                return F.lag(c, -step).over(w) if step < 0 else F.lead(c, step).over(w)

            columns[f"_{tag}_src"] = at(F.upper("glcsource"))
            columns[f"_{tag}_glc"] = at(F.col("glc"))
            columns[f"_{tag}_time"] = at(F.col("timer"))
            columns[f"_{tag}_event"] = at(F.upper("event"))
            columns[f"_{tag}_type"] = at(F.upper("insulintype"))
        return columns

    seen = with_neighbours(df, [partition], timeline_order(df), 2, neighbours, splits)

    def source(tag: str) -> Column:
        return F.col(f"_{tag}_src").isin(*READING_SOURCES)

    def treated(tag: str) -> Column:
        return F.col(f"_{tag}_event").isin(*TREATMENT_EVENTS)

    def fast(tag: str) -> Column:
        return F.col(f"_{tag}_type") == FAST_TYPE

    def gap(tag: str) -> Column:
        return F.col(f"_{tag}_gap")

    def glc(tag: str) -> Column:
        return F.col(f"_{tag}_glc")

    seen = seen.withColumns({f"_{t}_gap": F.abs(minutes_between("timer", f"_{t}_time")) for t in _NEIGHBOURS})
    treatment = F.upper("event").isin(*TREATMENT_EVENTS)
    fast_now = F.upper("insulintype") == FAST_TYPE

    def near(tag: str) -> Column:
        return gap(tag) <= tolerance_min

    def earlier_wins(a: str, b: str) -> Column:
        return (gap(a) <= gap(b)) & near(a) & (glc(a) >= floor) & (glc(a) >= glc(b))

    def later_wins(a: str, b: str) -> Column:
        return (gap(a) > gap(b)) & near(a) & near(b) & (glc(b) >= floor) & (glc(a) < glc(b))

    sixth = source("p1") & source("n2") & treated("n1") & later_wins("p1", "n2")
    clauses = {
        1: source("p1") & source("n1") & earlier_wins("p1", "n1"),
        2: source("p1") & source("n1") & later_wins("p1", "n1"),
        3: fast_now & source("p2") & fast("p2") & treated("p1") & source("n1") & earlier_wins("p2", "n1"),
        4: fast_now & source("p2") & treated("p1") & fast("p1") & source("n1") & later_wins("p2", "n1"),
        5: fast_now & source("p1") & source("n2") & treated("n1") & fast("n1") & earlier_wins("p1", "n2"),
        6: sixth,
        7: source("p1") & near("p1") & (glc("p1") >= floor),
        8: fast_now & source("p1") & source("n1") & (gap("p1") > tolerance_min) & near("n1") & (glc("n1") >= floor),
    }
    chosen = {1: "p1", 2: "n1", 3: "p2", 4: "n1", 5: "p1", 6: "n2", 7: "p1", 8: "n1"}
    seen = seen.withColumns({f"_c{n}": F.coalesce(treatment & c, F.lit(False)) for n, c in clauses.items()})

    # which clauses each output asks more of
    extra: dict[str, dict[int, Column]] = {"glc": {}, "time": {}, "src": {}, "rule": {}}
    if strict_reference:
        extra["time"][6] = fast_now & fast("n1")
        extra["src"][6] = F.lit(False)  # compares an upper-cased type with a mixed-case word: never true
        extra["rule"][6] = F.lit(False)
        extra["rule"][2] = fast_now

    def first_true(kind: str, value) -> Column:
        out = F
        for n in range(1, 9):
            test = F.col(f"_c{n}")
            if n in extra[kind]:
                test = test & F.coalesce(extra[kind][n], F.lit(False))
            out = out.when(test, value(n))
        return out

    seen = seen.withColumns(
        {
            "glc_al": first_true("glc", lambda n: glc(chosen[n])),
            "glctimer_al": first_true("time", lambda n: F.col(f"_{chosen[n]}_time")),
            "glcsource_al": first_true("src", lambda n: F.col(f"_{chosen[n]}_src")),
            "rule": first_true("rule", lambda n: F.lit(RULE_CODES[n - 1])),
        }
    )
    return seen.select(*df.columns, "glc_al", "glctimer_al", "glcsource_al", "rule")


def flag_repeated(df: DataFrame, partition: str = "stay_id", splits: Splits | None = None) -> DataFrame:
    """Add `repeated` = 1 on an unpaired row whose reading time was taken over by a neighbouring treatment."""

    def neighbours(w) -> dict[str, Column]:
        return {
            "_next_al": F.lead("glctimer_al").over(w),
            "_prev_al": F.lag("glctimer_al").over(w),
            "_prev_end": F.lag("endtime").over(w),
        }

    seen = with_neighbours(df, [partition], timeline_order(df), 1, neighbours, splits)
    taken = (F.col("_next_al") == F.col("glctimer")) | (
        (F.col("_prev_al") == F.col("glctimer")) & F.col("_prev_end").isNotNull()
    )
    flag = F.when(F.col("glcsource_al").isNull() & taken, F.lit(1))
    return seen.withColumn("repeated", flag).drop("_next_al", "_prev_al", "_prev_end")
