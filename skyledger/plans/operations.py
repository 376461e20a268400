"""Annual operations with rule-based imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyledger.functions.numbers import summer_from_annual, to_number
from skyledger.functions.rules import last_rule
from skyledger.operators.joins import lookup

# Imputed annual operations.
MEDICAL_HELIPORT_OPS = 156.0
HELIPORT_OPS = 110.0
FARM_OPS = 2.0
OTHER_AIRPORT_OPS = 110.0
SUMMER_GROUPS = (
    "Medical", "Other_PR_Airports", "Farm/Ranch", "Other_PR_Heliports", "Other_PU_Airports",
)


def imputed_operations(df: DataFrame) -> DataFrame:
    """Annual and summer operations by rule: ``ops_impute_annual``/``_summer``.

    Needs ``prior_ops``, ``facility_type``, ``facility_group``. The heliport
    default applies only where nothing is known yet; the rest always apply.
    """
    heli = F.col("facility_type") == "HELIPORT"
    group = F.col("facility_group")
    prior = F.col("prior_ops").cast("double")
    annual = last_rule(
        [
            (heli & prior.isNull(), HELIPORT_OPS),
            (heli & (group == "Medical"), MEDICAL_HELIPORT_OPS),
            (group == "Farm/Ranch", FARM_OPS),
            (group.isin("Other_PU_Airports", "Other_PR_Airports"), OTHER_AIRPORT_OPS),
        ],
        prior,
    )
    return df.withColumn("ops_impute_annual", annual).withColumn(
        "ops_impute_summer",
        F.when(group.isin(*SUMMER_GROUPS), summer_from_annual("ops_impute_annual")),
    )


def ops_with_metadata(facilities: DataFrame, ops: DataFrame, counties: DataFrame) -> DataFrame:
    """Facilities with reported or imputed operations and the corrected county.

    A facility counts as lacking data when its summer operations are unknown.
    ``imputed`` tells whether a value was filled.
    """
    clean = ops.select(
        "facility_id",
        to_number("annual_operations").alias("annual_operations"),
        to_number("summer_daily", zeros=()).alias("summer_daily"),
    )
    joined = lookup(facilities, clean, ["facility_id"])
    filled = imputed_operations(joined)
    lacking = F.col("summer_daily").isNull()
    use = F.col("annual_operations").isNull()
    filled = filled.withColumns({
        "ops_impute_annual": F.when(lacking, F.col("ops_impute_annual")),
        "ops_impute_summer": F.when(lacking, F.col("ops_impute_summer")),
    }).withColumns({
        "imputed": use & F.col("ops_impute_annual").isNotNull(),
        "summer_daily": F.when(use, F.col("ops_impute_summer")).otherwise(F.col("summer_daily")),
        "annual_operations": F.coalesce("annual_operations", "ops_impute_annual"),
    }).withColumn("facility_id", F.lower("facility_id"))
    return lookup(filled, counties, ["facility_id"]).drop(
        "ops_impute_annual", "ops_impute_summer", "prior_ops"
    )
