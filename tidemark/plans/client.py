"""What a client shows: an offer's place relative to the reference price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.profiles import BASE, PROFILES

# Bands of the price position index, colours of signals, overlays of statuses.
NEAR, WIDE = 0.05, 0.15
COLORS = {
    "BELOW_MARKET": "#C9A227",
    "SLIGHTLY_BELOW": "#E6C65C",
    "NEAR_MARKET": "#2ECC71",
    "SLIGHTLY_ABOVE": "#F39C12",
    "ABOVE_MARKET": "#E74C3C",
    "NO_DATA": "#95A5A6",
}
OVERLAYS = {"BURST_DETECTED": "warning_flag", "DOMAIN_DOMINANCE": "dominance_flag", "CLUSTER_COLLAPSE": "clustering_warning"}


def _look_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def signals(rows: DataFrame) -> DataFrame:
    """rows (a result's columns, region, currency, P_offer, P_offer_currency, P_offer_region) -> the same rows with
    signal, color, ppi, overlay and reduced_identity_scope. Null currencies or regions match null ones."""
    c = F.col
    least = F.lit(BASE.display_confidence)
    for p in PROFILES.values():
        least = F.when(c("applied_profile") == p.name, p.display_confidence).otherwise(least)
    usable = (
        c("P_offer_currency").eqNullSafe(c("currency")) & c("P_offer_region").eqNullSafe(c("region")) & ~F.coalesce("cold_start_flag", F.lit(False))
        & c("P_ref").isNotNull() & c("P_offer").isNotNull() & (c("P_ref") > 0) & c("CS").between(0, 1) & (c("CS") >= least)
    )
    ppi = F.when(usable, (c("P_offer") - c("P_ref")) / F.nullif("P_ref", F.lit(0.0)))
    out = rows.withColumn("ppi", ppi)
    signal = (
        F.when(c("ppi").isNull(), "NO_DATA")
        .when(c("ppi") <= -WIDE, "BELOW_MARKET")
        .when(c("ppi") < -NEAR, "SLIGHTLY_BELOW")
        .when(c("ppi") <= NEAR, "NEAR_MARKET")
        .when(c("ppi") < WIDE, "SLIGHTLY_ABOVE")
        .otherwise("ABOVE_MARKET")
    )
    out = out.withColumn("signal", signal)
    scope = F.coalesce("identity_scope_level", F.lit(0)) > 0
    return out.withColumns({"color": _look_up(COLORS, c("signal")), "overlay": _look_up(OVERLAYS, F.coalesce("integrity_status", F.lit(""))), "reduced_identity_scope": scope})


def join_offers(offers: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Offers with their bucket's record; an offer of an unknown bucket has no data."""
    return signals(offers.join(results, keys, "left"))
