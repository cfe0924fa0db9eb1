"""Parenteral and enteral nutrition orders to component amounts and hourly rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import codes
from chronoweave.functions.clock import hours_between


def dilution_lookup(spark: SparkSession) -> DataFrame:
    """itemid -> grams per ml of dextrose solutions and of lipid emulsions."""
    rows = [(i, s, None) for i, s in codes.DEXTROSE_SHARE.items()]
    rows += [(i, None, s) for i, s in codes.LIPID_SHARE.items()]
    return spark.createDataFrame(rows, "itemid int, dextrose_share double, lipid_share double")


def product_lookup(spark: SparkSession) -> DataFrame:
    """itemid -> product and its nutrient factors per ml."""
    rows = [(i, p, *codes.ENTERAL_FACTORS[p]) for p, items in codes.ENTERAL_ITEMS.items() for i in items]
    factors = ", ".join(f"{n}_factor double" for n in codes.NUTRIENTS)
    return spark.createDataFrame(rows, f"itemid int, product string, {factors}")


def parenteral_components(orders: DataFrame, dilution: DataFrame | None = None) -> DataFrame:
    """Per (stay, start, end): dextrose, TPN, lipid and amino acid amounts; a NULL status is kept."""
    dilution = dilution if dilution is not None else dilution_lookup(orders.sparkSession)
    amount = F.when(F.col("amount") >= 0, F.col("amount"))

    def of(*items: int) -> Column:
        return F.when(F.col("itemid").isin(*items), amount)

    rows = (
        orders.filter(F.col("itemid").isin(*codes.PARENTERAL_ITEMS))
        .filter(~F.col("statusdescription").eqNullSafe(codes.REWRITTEN))
        .join(F.broadcast(dilution), "itemid", "left")
    )
    lipids_flag = F.when(F.col("itemid") == codes.TPN_WITH_LIPIDS, F.lit(1)).when(
        F.col("itemid") == codes.TPN_WITHOUT_LIPIDS, F.lit(0)
    )
    return rows.groupBy("stay_id", "starttime", "endtime").agg(
        F.sum(amount * F.col("dextrose_share")).alias("dextrose_fluid"),
        F.sum(of(codes.TPN_WITH_LIPIDS, codes.TPN_WITHOUT_LIPIDS)).alias("tpn"),
        F.max(F.when(amount.isNotNull(), lipids_flag)).alias("tpn_lipids"),
        F.sum(of(codes.DEXTROSE_TPN)).alias("dextrose_tpn"),
        F.sum(of(codes.LIPIDS_TPN)).alias("lipids_tpn"),
        F.sum(of(codes.AMINO_ACIDS_TPN)).alias("amino_acids_tpn"),
        F.sum(amount * F.col("lipid_share")).alias("lipids_10_20"),
    )


def solution_unit(item: str = "itemid", unit: str = "amountuom") -> Column:
    """Dextrose solutions given in ml count in grams; other units stay."""
    return F.when(
        F.col(item).isin(*codes.DEXTROSE_SOLUTIONS) & (F.lower(unit) == "ml"), F.lit("grams")
    ).otherwise(F.col(unit))


def parenteral_rates(components: DataFrame) -> DataFrame:
    """TPN per hour; a zero-length interval gives NULL."""
    length = hours_between("starttime", "endtime")
    return components.select(
        "stay_id",
        F.col("starttime").alias("timer"),
        F.when(F.col("tpn").isNotNull(), length).alias("tpn_length"),
        "starttime",
        "endtime",
        "dextrose_fluid",
        F.try_divide("tpn", length).alias("tpn_rate"),
    )


def enteral_amounts(orders: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Nutrient amounts of enteral products: amount times the product's factors."""
    products = products if products is not None else product_lookup(orders.sparkSession)
    amount = F.when(F.col("amount") >= 0, F.col("amount"))
    return (
        orders.filter(~F.col("statusdescription").eqNullSafe(codes.REWRITTEN))
        .join(F.broadcast(products), "itemid")
        .select(
            "stay_id",
            "hadm_id",
            "subject_id",
            "starttime",
            "endtime",
            amount.alias("amount_enteral"),
            *[(amount * F.col(f"{n}_factor")).alias(f"{n}_enteral") for n in codes.NUTRIENTS],
        )
    )


def enteral_rates(amounts: DataFrame) -> DataFrame:
    """Nutrients per hour over each order's interval; a zero-length interval gives NULL."""
    length = hours_between("starttime", "endtime")
    return amounts.select(
        "stay_id",
        "hadm_id",
        "subject_id",
        F.col("starttime").alias("timer"),
        length.alias("enteral_length"),
        "starttime",
        "endtime",
        F.try_divide("amount_enteral", length).alias("enteral_rate"),
        *[F.try_divide(f"{n}_enteral", length).alias(f"{n}_enteral") for n in codes.NUTRIENTS],
    )
