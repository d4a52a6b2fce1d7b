import pytest

from tidemark.plans.client import COLORS, signals

KIND = "i int, P_ref double, CS double, N_eff double, MAD double, integrity_status string, cold_start_flag boolean, identity_scope_level int, applied_profile string, region string, currency string, P_offer double, P_offer_currency string, P_offer_region string"
DEFAULT = {"P_ref": 100.0, "CS": 0.8, "N_eff": 5.0, "MAD": 1.0, "integrity_status": "NORMAL", "cold_start_flag": False, "identity_scope_level": 0, "applied_profile": "BASE", "region": "us", "currency": "usd", "P_offer": 100.0, "P_offer_currency": "usd", "P_offer_region": "us"}
CASES = [
    *[({"P_offer": o}, s, p) for o, s, p in [(80.0, "BELOW_MARKET", -0.2), (90.0, "SLIGHTLY_BELOW", -0.1), (102.0, "NEAR_MARKET", 0.02), (110.0, "SLIGHTLY_ABOVE", 0.1), (130.0, "ABOVE_MARKET", 0.3)]],
    *[({"P_offer": o}, s, o / 100 - 1) for o, s in [(85.0, "BELOW_MARKET"), (85.0001, "SLIGHTLY_BELOW"), (95.0, "NEAR_MARKET"), (100.0, "NEAR_MARKET"), (105.0, "NEAR_MARKET"), (105.0001, "SLIGHTLY_ABOVE"), (115.0, "ABOVE_MARKET")]],
    *[
        (change, "NO_DATA", None)
        for change in [
            {"cold_start_flag": True}, {"P_ref": None}, {"P_offer": None}, {"CS": 0.149}, {"CS": 0.2, "applied_profile": "HARDENED"}, {"P_offer_currency": "eur"},
            {"P_offer_region": "eu"}, {"P_ref": 0.0}, {"CS": -0.01}, {"CS": 1.01},
        ]
    ],
    ({"integrity_status": "BURST_DETECTED", "P_offer": 130.0}, "ABOVE_MARKET", 0.3),
    ({"integrity_status": "DOMAIN_DOMINANCE"}, "NEAR_MARKET", 0.0),
    ({"integrity_status": "CLUSTER_COLLAPSE", "P_offer": 90.0}, "SLIGHTLY_BELOW", -0.1),
    ({"identity_scope_level": 1}, "NEAR_MARKET", 0.0),
    ({"identity_scope_level": 2}, "NEAR_MARKET", 0.0),
    ({"currency": None, "P_offer_currency": None}, "NEAR_MARKET", 0.0),
]
OVERLAYS = {"BURST_DETECTED": "warning_flag", "DOMAIN_DOMINANCE": "dominance_flag", "CLUSTER_COLLAPSE": "clustering_warning"}


def test_signals(spark):
    rows = [(i, *(DEFAULT | change).values()) for i, (change, _, _) in enumerate(CASES)]
    got = signals(spark.createDataFrame(rows, KIND)).orderBy("i").collect()
    for r, (change, signal, ppi) in zip(got, CASES, strict=True):
        assert r["signal"] == signal, change
        assert r["ppi"] is None if ppi is None else r["ppi"] == pytest.approx(ppi, abs=1e-12)
        assert r["color"] == COLORS[signal]
        assert r["overlay"] == OVERLAYS.get(change.get("integrity_status"))
        assert r["reduced_identity_scope"] == (change.get("identity_scope_level", 0) > 0)
