"""The end-to-end chain: load -> clean -> engineer features -> regression influence.

Each stage returns a lazily evaluated DataFrame; only the small fit steps
(means, quantiles, a 3 x 3 solve) run as actions on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as D
from ..operators import regress as G
from ..sources.readers import load
from .cleaning import CleaningSpec


def lineitem_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean lineitem (dedup, winsorise price outliers), add a unit price feature, diagnose
    ``l_extendedprice ~ l_quantity + l_discount + unit_price``."""
    li = load(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    spec = CleaningSpec(remove_dups=True, outlier_method="iqr", outlier_action="cap")
    cleaned, _ = spec.apply(li)
    feat = D.formula(cleaned, "unit_price", "l_extendedprice / l_quantity")
    model = G.ols_fit(feat, "l_extendedprice", ["l_quantity", "l_discount", "unit_price"])
    return G.influence(feat, model, ["l_orderkey", "l_linenumber"])
