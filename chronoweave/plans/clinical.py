"""The model graph: raw clinical tables to the wide table with nutrition."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.nutrition import enteral_amounts, enteral_rates, parenteral_components, parenteral_rates
from chronoweave.operators.pairing import flag_repeated, pair_events
from chronoweave.operators.readings import clean_readings
from chronoweave.operators.splits import Splits, find_splits
from chronoweave.operators.timeline import (
    add_nutrition,
    assign_stays,
    build_timeline,
    drop_fanned_out_entities,
    stay_attributes,
    to_long,
    to_wide,
)
from chronoweave.operators.treatments import clean_treatments
from chronoweave.session import pin, shared_folder
from chronoweave.sources.tables import as_view, save_table


@dataclass(frozen=True)
class RawTables:
    chart: DataFrame
    labs: DataFrame
    orders: DataFrame
    stays: DataFrame
    comorbidity: DataFrame
    weight: DataFrame


def stay_timeline(raw: RawTables, cap: str = "distinct_count", exact: bool = False) -> DataFrame:
    """Readings and treatments inside a stay, with the stay's attributes."""
    # stored, because the stay assignment first measures the timeline and then joins it
    timeline = pin(build_timeline(clean_readings(raw.chart, raw.labs), clean_treatments(raw.orders, cap, exact)))
    return assign_stays(timeline, stay_attributes(raw.stays, raw.comorbidity, raw.weight))


def paired_timeline(
    timeline: DataFrame, tolerance_min: int = 90, strict_reference: bool = True
) -> tuple[DataFrame, Splits]:
    """The flagged pairing, and the stays' splits for the steps after it."""
    by_admission = find_splits(timeline, ["hadm_id"], "timer")
    by_stay = find_splits(timeline, ["stay_id"], "timer")
    paired = pair_events(
        timeline, tolerance_min=tolerance_min, strict_reference=strict_reference, splits=by_admission
    )
    if by_admission.any or by_stay.any:
        # every step along cut entities reads its input twice, for the rows at the cuts and for all rows
        return pin(flag_repeated(pin(paired), splits=by_stay)), by_stay
    return flag_repeated(paired, splits=by_stay), by_stay


def wide_with_nutrition(wide: DataFrame, orders: DataFrame, splits: Splits | None = None) -> DataFrame:
    """The wide table with nutrition, without the stays that have treatments of one kind at the same time.

    Such stays go, so overlapping TPN orders are counted rather than written out as repeated rows.
    """
    parenteral = parenteral_rates(parenteral_components(orders))
    enteral = enteral_rates(enteral_amounts(orders))
    fed = pin(add_nutrition(wide, parenteral, enteral, repeat_rows=False, splits=splits))
    return drop_fanned_out_entities(fed, also=F.col("n_tpn") > 1).drop("n_tpn")


def build_tables(
    raw: RawTables, root: str | None = None, cap: str = "distinct_count", exact: bool = False
) -> dict[str, DataFrame]:
    """Run the whole graph, storing the stay timeline and the three output tables under `root`.

    Every stored table is read back, so no later step repeats an earlier one, and the entity sizes are
    counted once on the stored timeline. Without `root` the tables go to the session's shared folder.
    """
    root = root or f"{shared_folder(raw.chart.sparkSession)}/graph-{uuid.uuid4().hex}"
    timeline = save_table(stay_timeline(raw, cap, exact), f"{root}/stay_timeline")
    paired, by_stay = paired_timeline(timeline)
    as_view(paired, "paired_timeline")
    long = save_table(to_long(paired, by_stay), f"{root}/long")
    wide = save_table(to_wide(long, by_stay), f"{root}/wide")
    fed = save_table(wide_with_nutrition(wide, raw.orders, by_stay), f"{root}/wide_nutrition")
    return {"stay_timeline": timeline, "long": long, "wide": wide, "wide_nutrition": fed}
