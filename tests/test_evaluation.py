"""Evaluation records of small batches; all batches are buckets of one plan, so they also show that buckets are apart."""

import pytest

from tidemark.functions.domains import common_rules
from tidemark.operators import boundary
from tidemark.plans.evaluation import evaluate
from tidemark.profiles import BASE, HARDENED, get_profile
from tidemark.schema import PIL_FIELDS, RESULT
from tidemark.sources.json_io import raw_observations

NOW = 1_700_000_000


def _rows(entries, **pil):
    layer = {f: "" for f in PIL_FIELDS} | {"brand": "b", "model": "m"} | pil
    return [
        {"source_url": f"https://{host}/p", "merchant_id": merchant, "price": price, "currency": "usd", "region": "us", "timestamp": ts, "product_identity_layer": layer}
        for host, merchant, price, ts in entries
    ]


CASES = {
    "uniform_market": _rows(
        [(h, f"{m}_merchant", p, 1_699_900_000 + 10_000 * i) for i, (h, m, p) in enumerate([("shop.alpha.com", "alpha", 100), ("store.beta.com", "beta", 102), ("www.gamma.com", "gamma", 99), ("delta.com", "delta", 101), ("epsilon.com", "epsilon", 103)])]
    ),
    "zero_mad": _rows([(f"shop-{c}.com", f"merchant_{c}", 75, 1_699_900_000 + 10_000 * i) for i, c in enumerate("abcde")]),
    "burst_attack": _rows(
        [(h, f"legit_merchant_{i + 1}", p, 1_699_800_000 + 10_000 * i) for i, (h, p) in enumerate([("legit-shop.com", 200), ("legit-shop2.com", 205), ("legit-shop3.com", 198)])]
        + [("attacker-domain.com", f"attacker_{i + 1}", p, 1_699_990_000 + 100 * i) for i, p in enumerate([150, 148, 152, 149, 151, 147, 153])]
    ),
    "domain_dominance": _rows(
        [("dominant-shop.com", f"dom_merchant_{i + 1}", p, 1_699_900_000 + 10_000 * i) for i, p in enumerate([500, 505, 498, 502, 510, 495])]
        + [("minor-shop1.com", "minor_merchant_1", 520, 1_699_900_000), ("minor-shop2.com", "minor_merchant_2", 515, 1_699_910_000)]
    ),
    "cluster_injection": _rows(
        [("real-store.com", "real_merchant", 50, 1_699_900_000), ("another-store.com", "another_merchant", 52, 1_699_910_000), ("third-store.com", "third_merchant", 48, 1_699_920_000)]
        + [("sybil-domain.com", "sybil_merchant", p, 1_699_930_000 + 100 * i) for i, p in enumerate([30, 30.5, 29.5, 30.25, 30.75])]
    ),
    "cold_start": _rows([("only-store.com", "lone_merchant", 1000, 1_699_900_000)]),
    # every domain under the cap; one domain doubles its own earlier count and more: 3 rows now, 1 before
    "burst": _rows([(f"s{i}.com", f"m{i}", 100 + i, NOW - 3600 - i) for i in range(6)] + [("s0.com", "m0", 100, NOW - 90_000)] + [("s0.com", f"x{i}", 100, NOW - 3600 - i) for i in range(2)]),
    # six domains of equal weight, three near-identical rows of one merchant each
    "collapse": _rows([(f"c{i}.com", f"m{i}", 100 + i, NOW - 3600 - j) for i in range(6) for j in range(3)]),
    "stale": _rows([(f"o{i}.com", f"m{i}", 10, NOW - 8_000_000) for i in range(5)]),
    "level_1": _rows([("a.com", "a", 10, NOW - 9)], bundle_flag="x") + _rows([("b.com", "b", 11, NOW - 9)], bundle_flag="y"),
    "level_2": _rows([("a.com", "a", 10, NOW - 9)], warranty_type="x") + _rows([("b.com", "b", 11, NOW - 9)], warranty_type="y", bundle_flag="z"),
}
#: scope level, price, MAD, confidence, effective sample, cold, status
WANT = {
    "uniform_market": (0, 101.0, 1.0, 0.53215, 4.999672, False, "NORMAL"),
    "zero_mad": (0, 75.0, 0.0, 0.53215, 4.999672, False, "NORMAL"),
    "burst_attack": (0, 198.0, 46.5, 0.503423, 5.316136, False, "DOMAIN_DOMINANCE"),
    "domain_dominance": (0, 515.0, 11.5, 0.399346, 4.153816, False, "DOMAIN_DOMINANCE"),
    "cluster_injection": (0, 48.0, 17.375, 0.50008, 5.021674, False, "DOMAIN_DOMINANCE"),
    "cold_start": (None, None, None, 0.0, 0.0, True, "COLD_START"),
}


@pytest.fixture(scope="module")
def accepted(spark):
    raw = None
    for name, rows in CASES.items():
        part = raw_observations(spark, rows, name)
        raw = part if raw is None else raw.unionByName(part)
    return boundary.accepted(boundary.judge(raw, common_rules(spark), NOW)).cache()


@pytest.fixture(scope="module")
def records(accepted):
    return {r["batch"]: r for r in evaluate(accepted, ["batch"], NOW, BASE).collect()}


@pytest.mark.parametrize("case", WANT)
def test_records(records, case):
    r = records[case]
    assert (r["identity_scope_level"], r["P_ref"], r["MAD"], r["CS"], r["N_eff"], r["cold_start_flag"], r["integrity_status"]) == WANT[case]
    assert r["insufficient_data_flag"] == r["cold_start_flag"]
    assert list(r.asDict()) == ["batch", *RESULT]


def test_other_states(records):
    assert records["burst"]["integrity_status"] == "BURST_DETECTED"
    assert records["collapse"]["integrity_status"] == "CLUSTER_COLLAPSE"
    assert (records["stale"]["integrity_status"], records["stale"]["identity_scope_level"], records["stale"]["N_eff"]) == ("COLD_START", 0, 0.0)
    assert records["level_1"]["identity_scope_level"] == 1
    assert records["level_2"]["identity_scope_level"] == 2


def test_hardened_never_leaves_cold_start(accepted):
    for r in evaluate(accepted, ["batch"], NOW, HARDENED).collect():
        assert r["cold_start_flag"] and r["applied_profile"] == "HARDENED"


def test_unknown_profile():
    with pytest.raises(ValueError):
        get_profile("NONE")


@pytest.mark.parametrize("comparisons", [1_000_000, 4])
def test_clusters_against_brute_force(spark, monkeypatch, comparisons):
    """Undecided pairs of cells, compared at once or cut again and again."""
    import random

    from tidemark.operators import similarity
    from tidemark.shared import Scratch

    monkeypatch.setattr(similarity, "COMPARISONS", comparisons)
    rnd = random.Random(2)
    rows = []
    for i in range(160):
        v = [rnd.gauss(1, 0.4), rnd.random(), rnd.random(), rnd.random()]
        norm = sum(x * x for x in v) ** 0.5
        rows.append(("b", i, f"d{i % 3}", f"m{i % 7}", *[x / norm for x in v]))
    frame = spark.createDataFrame(rows, "bucket string, idx long, domain_id string, merchant_id string, x0 double, x1 double, x2 double, x3 double")
    for threshold in (0.92, 0.995):
        scratch = Scratch(spark)
        got = {r["idx"]: (r["cluster_id"], r["cluster_size"]) for r in scratch.finish(similarity.clusters(frame, ["bucket"], threshold, scratch)).collect()}
        up = {r[1]: r[1] for r in rows}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in rows:
            for b in rows[: a[1]]:
                if (a[2] == b[2] or a[3] == b[3]) and sum(x * y for x, y in zip(a[4:], b[4:])) >= threshold:
                    x, y = root(a[1]), root(b[1])
                    up[max(x, y)] = min(x, y)
        roots = {i: root(i) for i in up}
        assert got == {i: (r, sum(v == r for v in roots.values())) for i, r in roots.items()}
