import hashlib
import json

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.domains import common_rules, load_rules, url_roots
from tidemark.operators import boundary
from tidemark.schema import PIL_FIELDS
from tidemark.sources.json_io import raw_observations

NOW = 1_700_000_000


def _apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_string(spark):
    got = _apply(spark, ["  Hello World  ", "Straße", None, "\t  test  \n", "café", "café", " hello ", ""], S.normalize_string)
    assert got == ["hello world", "strasse", "", "test", "café", "café", " hello ", ""]


def test_hosts_and_roots(spark):
    urls = ["https://shop.example.com:443/path", "not-a-url", "", None, "https://sub.shop.example.com/path", "https://shop.example.co.uk/p", "https://localhost/p", "//u:p@X.com/p", "https://[::1]:80/p", "https://co.uk/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, source_url string")
    got = [(r["host"], r["root_domain"]) for r in url_roots(rows, common_rules(spark)).orderBy("i").collect()]
    assert got[:4] == [("shop.example.com", "example.com"), (None, None), (None, None), (None, None)]
    assert [g[1] for g in got[4:7]] == ["example.com", "example.co.uk", "localhost"]
    assert got[7:] == [("x.com", "x.com"), ("::1", "::1"), ("co.uk", "co.uk")]


def test_rule_file(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\r\ncom\r\n*.ck\r\n!www.ck\r\n\r\n")
    rules = load_rules(spark, str(tmp_path / "rules.dat"))
    rows = spark.createDataFrame([(f"https://{h}/",) for h in ("a.b.ck", "x.a.b.ck", "www.ck", "y.www.ck", "b.ck")], "source_url string")
    got = {r["host"]: r["root_domain"] for r in url_roots(rows, rules).collect()}
    assert got == {"a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "www.ck": "www.ck", "y.www.ck": "www.ck", "b.ck": "b.ck"}


def test_packaged_rules(spark):
    assert common_rules(spark).count() == 1738
    want = {"www.x.gov.uk": "x.gov.uk", "a.shop.com.mx": "shop.com.mx", "me.github.io": "me.github.io", "a.b.myshopify.com": "b.myshopify.com", "x.example.com": "example.com"}
    three = [r["rule"] for r in common_rules(spark).collect() if r["rule"].count(".") == 2]
    want |= {f"a.b.{s}": f"b.{s}" for s in three}
    assert len(three) == 5
    rows = spark.createDataFrame([(f"https://{h}/",) for h in want], "source_url string")
    assert {r["host"]: r["root_domain"] for r in url_roots(rows, common_rules(spark)).collect()} == want


def test_timestamps(spark):
    got = _apply(spark, ["1699000000.7", str(NOW + 3), str(NOW + 5), str(NOW + 10), "inf", "not-a-timestamp", None, "2023-11-14T22:13:19.5Z", "2023-11-14T22:13:19", "2023-11-14T23:13:19+01:00", "1969-12-31T23:59:59.5Z"], lambda c: S.canonical_timestamp(c, NOW))
    assert got == [1699000000, NOW + 3, NOW + 5, None, None, None, None, NOW - 1, NOW - 1, NOW - 1, -1]


def test_merchants_and_prices(spark):
    assert _apply(spark, ["MyShop", None, "a" * 256, "a" * 257, "é" * 129], S.canonical_merchant) == ["myshop", "", "a" * 256, None, None]
    assert _apply(spark, ["1.5", "0", "-1", "nan", "inf", "x", None, " 2 "], S.valid_price) == [1.5, None, None, None, None, None, None, 2.0]


def test_canonical_numbers(spark):
    values = [100.0, 99.99, 0.0001, 1e-5, 12345678.9, 1e22, 0.5, 1e15, 123456789012.25, None]
    want = ["100", "99.99", "0.0001", "1e-05", "12345678.9", "1e+22", "0.5", "1000000000000000", "123456789012.25", None]
    assert _apply(spark, values, S.canonical_number, "double") == want


def test_canonical_strings(spark):
    values = ['a"b\\c', "é\n\x1f\t", ""]
    assert _apply(spark, values, S.canonical_string) == [json.dumps(v, ensure_ascii=False) for v in values]


def test_hash_unit(spark):
    assert _apply(spark, ["example.com", ""], S.hash_unit) == [0.6385750153410176, 0.0]


def test_boundary(spark):
    pil = {f: "" for f in PIL_FIELDS}
    ok = {"source_url": "https://a.b.com/x", "merchant_id": "M", "price": 5, "currency": "USD", "region": "US", "timestamp": NOW - 1, "product_identity_layer": pil}
    faults = [{}, {"price": -50}, {"currency": ""}, {"region": None}, {"source_url": "x"}, {"merchant_id": "m" * 300}, {"timestamp": "x"}, {"product_identity_layer": None}, {"source_url": "x", "domain_id": " D "}, {"price": -1, "currency": ""}]
    judged = boundary.judge(raw_observations(spark, [ok | f for f in faults]), common_rules(spark), NOW)
    assert [r["reason"] for r in judged.orderBy("idx").collect()] == [None, *boundary.REASONS, None, "invalid_price"]
    row = boundary.accepted(judged).orderBy("idx").collect()
    assert [r["domain_id"] for r in row] == ["b.com", "d"]
    obj = {"currency": "usd", "domain_id": "b.com", "merchant_id": "m", "price": 5, "product_identity_layer": pil, "region": "us", "timestamp": NOW - 1}
    assert row[0]["evidence_hash"] == hashlib.sha256(json.dumps(obj, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    s = boundary.summary(judged, "batch").first()
    assert (s["accepted_count"], s["rejected_count"], s["rejection_reasons_summary"]["invalid_price"]) == (2, 8, 2)


def test_iso_texts_in_any_session_zone(spark):
    """Texts that name no zone are UTC, whatever the session's zone is; compact and week dates as datetime.fromisoformat reads them."""
    from datetime import UTC, datetime

    from tidemark.functions import scalars

    texts = [
        "2023-11-14T22:13:19", "20231114T221319", "2023-11-14 22:13", "2023-11-14", "20231114", "2023-11-14T22:13:19.999999", "2023-11-14T22:13:19,5", "2023-11-14T22", "20231114T2213",
        "2023-11-14T22:13:19Z", "2023-11-14T22:13:19+02:00", "2023-11-14T22:13:19-0530", "2023-11-14T221319+02", "2023-11-14T22:13:19+01:02:03", "2023-W46-2", "2023W462T10:11:12", "2023-W46", "2020-W53-7", "2021-W01-1", "1969-12-31T23:59:58.5",
        "2023-02-29", "2023-13-01", "2023-11-14T25:00", "2023-11-14T22:60", "2021-W53-1", "2023-W00-1", "2023-W46-8", "2023-11-1", "2023/11/14", "14.11.2023", "2023-1114", "2023-11-14T22:13:19+25:00", "2023-11-14T22:1319", "2023-11-14T22:13:19 UTC", "soon", "T22:13", "2024-02-29T00:00:00",
    ]

    def want(text):
        if text.isdecimal():
            return int(text)  # a number is one before it may be a compact date
        try:
            t = datetime.fromisoformat(text)
        except ValueError:
            return None
        return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() // 1)

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.canonical_timestamp(F.col("t"), 2_000_000_000).alias("s")).collect()
            assert {r["t"]: r["s"] for r in rows} == {t: want(t) for t in texts}, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
