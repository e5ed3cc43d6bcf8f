"""MCC → category.

The MCC dimension is joined without a hint: Spark broadcasts it when its
measured size allows.  A ledger without one takes the built-in fallback map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "Other"

# Fallback MCC → category map of the spending pages (7 codes).
SPENDING_FALLBACK = {
    5812: "Eating Places and Restaurants",
    5814: "Eating Places and Restaurants",
    5541: "Service Stations",
    5411: "Grocery Stores, Supermarkets",
    4900: "Utilities",
    5942: "Book Stores",
    7996: "Amusement Parks, Carnivals, Circuses",
}

# Fallback MCC → category map of the rewards optimiser (12 codes).
REWARDS_FALLBACK = {
    5411: "Grocery Stores, Supermarkets",
    5542: "Service Stations",
    5812: "Eating Places and Restaurants",
    5814: "Eating Places and Restaurants",
    5815: "Eating Places and Restaurants",
    7832: "Amusement Parks, Carnivals, Circuses",
    7841: "Amusement Parks, Carnivals, Circuses",
    7996: "Amusement Parks, Carnivals, Circuses",
    5912: "Book Stores",
    5942: "Book Stores",
    4900: "Utilities",
    5999: "Retail",
}

FALLBACK_MAPS = {"spending": SPENDING_FALLBACK, "rewards": REWARDS_FALLBACK}


def with_category(df: DataFrame, mcc_codes: DataFrame | None, mcc_col: str = "mcc",
                  fallback: str = "spending") -> DataFrame:
    """Left join on mcc, a miss (or NULL mcc) → ``Other``.  Duplicate MCC
    rows fan out, as a plain left merge does.  Without an MCC table (``None``)
    the categories come from the ``fallback`` map (C14)."""
    if mcc_codes is None:
        return with_fallback_category(df, fallback, mcc_col)
    dim = mcc_codes.select(F.col("mcc").alias("_mcc"), F.col("category"))
    return (df.join(dim, F.col(mcc_col) == F.col("_mcc"), "left")
              .drop("_mcc")
              .withColumn("category", F.coalesce(F.col("category"), F.lit(OTHER))))


def with_fallback_category(df: DataFrame, which: str = "spending",
                           mcc_col: str = "mcc") -> DataFrame:
    """C14: category from one of the two built-in fallback maps."""
    mapping = FALLBACK_MAPS[which]
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(
        "category", F.coalesce(F.try_element_at(m, F.col(mcc_col)), F.lit(OTHER)))
