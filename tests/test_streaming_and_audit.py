import hashlib
import json

from tidemark.functions.domains import common_rules
from tidemark.operators import audit
from tidemark.streaming import jobs
from tests.test_evaluation import CASES, NOW


def test_queue(spark, tmp_path):
    base = str(tmp_path / "queue")
    good = jobs.enqueue(base, CASES["uniform_market"], NOW, job_id="good")
    jobs.enqueue(base, [{"price": -1}], NOW, job_id="refused")
    jobs.enqueue(base, [], NOW, job_id="empty")
    jobs.enqueue(base, [], NOW, "NONE", job_id="bad profile")
    jobs.enqueue(base, [], None, job_id="no time")
    # as another program writes it: indented, with an unknown field
    job = {"job_id": "published", "created_at": 5.5, "payload": {"observations": CASES["uniform_market"], "current_time_utc": NOW, "applied_profile": "HARDENED", "extra": [1, {"a": None}]}}
    (tmp_path / "queue" / "pending" / "published.json").write_text(json.dumps(job, indent=2) + "\n")
    (tmp_path / "queue" / "pending" / "broken.json").write_text("{not json")
    assert {r["job"] for r in jobs.pending(spark, base).collect()} == {"good", "refused", "empty", "bad profile", "no time", "published", "broken"}
    jobs.run(spark, base, common_rules(spark)).awaitTermination(300)
    read = lambda folder: {p.stem: json.loads(p.read_text()) for p in (tmp_path / "queue" / folder).glob("*.json")}
    done, failed = read("completed"), read("failed")
    assert set(done) == {good, "refused", "empty", "published"}
    assert {k: (v["error"], v["status"], v["error_details"]["exception_type"]) for k, v in failed.items()} == {
        "bad profile": ("Invalid profile: NONE", "failed", "ValueError"),
        "no time": ("Missing current_time_utc in job payload", "failed", "ValueError"),
        "broken": ("unreadable job", "failed", "JSONDecodeError"),
    }
    assert set(failed["no time"]) == {"job_id", "created_at", "failed_at", "status", "error", "error_details", "original_payload"}
    assert failed["bad profile"]["original_payload"] == {"observations": [], "current_time_utc": NOW, "applied_profile": "NONE", "metadata": None}
    assert list(done[good]) == ["job_id", "created_at", "completed_at", "status", "result"] and done[good]["status"] == "completed"
    result = done[good]["result"]
    assert list(result) == ["status", "protocol_version", "constants_version", "applied_profile", "accepted_count", "rejected_count", "rejection_reasons_summary", "result"]
    assert (result["status"], result["result"]["P_ref"], result["accepted_count"], result["rejection_reasons_summary"]) == ("ok", 101.0, 5, {})
    assert done["refused"]["result"]["result"]["integrity_status"] == "COLD_START" and done["refused"]["result"]["rejection_reasons_summary"] == {"invalid_price": 1}
    assert done["empty"]["result"]["result"]["cold_start_flag"] and done["empty"]["result"]["accepted_count"] == 0
    assert done["published"]["created_at"] == 5.5 and done["published"]["result"]["applied_profile"] == "HARDENED"
    assert jobs.pending(spark, base).count() == 0


def test_large_jobs(spark, tmp_path, monkeypatch):
    """Jobs read element by element end as jobs read whole do, their records alike."""
    from tidemark.sources import pieces

    payload = {"observations": [*CASES["uniform_market"], None, {"price": "}é\n", "x": [1]}], "current_time_utc": NOW, "applied_profile": "BASE", "metadata": {"a": "b"}}
    texts = {
        "good": json.dumps({"job_id": "good", "created_at": 5.5, "payload": payload}, indent=2) + "\n",
        "hardened": json.dumps({"job_id": "hardened", "created_at": 5.5, "payload": payload | {"applied_profile": "HARDENED"}}),
        "late of[it]": json.dumps({"job_id": "late", "payload": {k: v for k, v in payload.items() if k != "current_time_utc"}}, ensure_ascii=False),
        "nobody": json.dumps({"job_id": "nobody", "payload": payload | {"applied_profile": "NONE", "observations": []}}),
        "bare": '{"job_id":"bare","payload":{"applied_profile":"BASE"}}',
        "cut": json.dumps({"job_id": "cut", "payload": payload})[:-2],
        "cut in a text": json.dumps({"job_id": "cut", "payload": payload})[:-60] + "\n",
        "odd": json.dumps({"job_id": "odd", "payload": payload | {"observations": [{"product_identity_layer": "x"}, 5, "s", {}]}}),
        "nan": '{"job_id":"nan","payload":{"observations":[{"price":NaN}]}}',
    }

    def worked_off(base):
        jobs.ensure(str(base))
        for name, text in texts.items():
            (base / "pending" / f"{name}.json").write_text(text)
        jobs.run(spark, str(base), common_rules(spark)).awaitTermination(300)
        read = lambda p: {k: v for k, v in json.loads(p.read_text()).items() if k not in ("failed_at", "completed_at")}
        return {(folder, p.name): (read(p), len(p.read_text().splitlines())) for folder in ("completed", "failed") for p in (base / folder).glob("*.json")}

    whole = worked_off(tmp_path / "whole")
    assert len(whole) == len(texts)
    monkeypatch.setattr(pieces, "LARGE", 0)
    assert worked_off(tmp_path / "large") == whole


def test_jobs_of_many_times_are_one_plan(spark, monkeypatch):
    from tidemark.plans import evaluation

    plans = []
    monkeypatch.setattr(jobs, "respond", lambda *a: plans.append(1) or evaluation.respond(*a))
    files = [(json.dumps({"job_id": f"j{i}", "created_at": 1.0, "payload": {"observations": CASES["uniform_market"], "current_time_utc": NOW + i, "applied_profile": "BASE"}}), f"j{i}.json") for i in range(30)]
    done, _ = jobs.process(jobs._jobs(spark.createDataFrame(files, "value string, file string")), common_rules(spark))
    got = {r["name"]: json.loads(r["json"])["result"]["result"]["P_ref"] for r in done.collect()}
    assert len(plans) == 1 and got == {f"j{i}": 101.0 for i in range(30)}


def test_documents_in_parts():
    """An array's elements are the same wherever a document is cut, and what is no document is known."""
    from tidemark.sources.pieces import Splitter

    def split(text, path, size):
        s = Splitter(path)
        found = [e for i in range(0, len(text), size) for e in s.feed(text[i : i + size])]
        return found + s.feed("", last=True), s

    rows = [{"x": '}],"{ \\', "y": [1, {"z": ",}"}]}, None, 5, "s,]", [], {}, {"p": {"q": {"r": "é"}}}]
    for doc in ({"a": {"observations": [1]}, "observations": rows, "z": "}"}, {"observations": []}, {"x": 1}, {"observations": None}):
        for text in (json.dumps(doc, ensure_ascii=False), json.dumps(doc, indent=2) + "\n"):
            for size in (1, 2, 7, 1000):
                found, s = split(text, ("observations",), size)
                assert not s.broken and [(i, json.loads(e)) for i, e in found] == list(enumerate(doc.get("observations") or []))
                assert json.loads(s.rest()) == doc | ({"observations": []} if doc.get("observations") else {})
    for text in ('{"observations":[{}', '{"observations":[{}}]', '{"observations":[{},,{}]}', '{"observations":[{} {}]}', '{"observations":[{}] ', '{"observations":["a]}', "", "{not json"):
        assert all(split(text, ("observations",), size)[1].broken for size in (1, 3, 100))
    found, s = split('[{"observations":[1,2]},{"observations":[3]}] }', ("observations",), 2)
    assert found == [(0, "1"), (1, "2"), (0, "3")] and s.rest() == '[{"observations":[]},{"observations":[]}]'


def test_large_batches(spark, tmp_path, monkeypatch):
    """Batches read element by element are those read whole, and a broken document gives no rows."""
    from tidemark.sources import json_io, pieces

    odd = [{"price": 1.50, "extra": {"a": [1]}, "source_url": "a}b\n"}, {"price": float("nan")}, None, {}, {"product_identity_layer": {"brand": "é"}}]
    (tmp_path / "a.json").write_text(json.dumps({"observations": CASES["uniform_market"], "description": "}"}, indent=2) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"observations": odd}, ensure_ascii=False))
    (tmp_path / "raw.json").write_text('{"observations":[{"price": 1.50, "region": {"a" : [ 1 ]}}, {"price": 1E5}, {"product_identity_layer": "x"}]}')
    (tmp_path / "scalar.json").write_text('{"observations":[{"price":1},5]}')
    (tmp_path / "c.json").write_text('{"observations":[{"price":1},{"price":2}')
    (tmp_path / "d.json").write_text('{"observations":[{"price":1},{"price":}]}')
    (tmp_path / "e.json").write_text('{"observations":[]}')
    read = lambda: sorted(repr(r) for r in json_io.read_batches(spark, f"{tmp_path}/*.json").collect())
    whole = read()
    assert len(whole) == len(CASES["uniform_market"]) + 8
    monkeypatch.setattr(pieces, "LARGE", 0)
    assert read() == whole


def test_request_and_ingest(spark, tmp_path):
    from tidemark.plans import service

    request = {"observations": CASES["uniform_market"] + [{"price": "x"}], "current_time_utc": NOW, "applied_profile": "BASE"}
    got = service.evaluate_request(spark, request, common_rules(spark))
    assert (got["status"], got["accepted_count"], got["rejected_count"], got["result"]["P_ref"]) == ("ok", 5, 1, 101.0)
    taken = jobs.ingest(str(tmp_path), request)
    assert (taken["status"], taken["observations_count"]) == ("ok", 6)
    assert json.loads((tmp_path / "pending" / f"{taken['job_id']}.json").read_text())["payload"]["current_time_utc"] == NOW


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from tidemark import __main__ as cli

    (tmp_path / "a.json").write_text(json.dumps({"description": "x", "observations": CASES["zero_mad"]}))
    (tmp_path / "b.json").write_text(json.dumps({"observations": []}))
    monkeypatch.setattr("sys.argv", ["tidemark", "--input", f"{tmp_path}/*.json", "--now", str(NOW)])
    cli.main()
    a, b = (json.loads(x if x.endswith("}") else x + "}") for x in capsys.readouterr().out.strip().split("}\n"))
    assert (a["P_ref"], a["MAD"], a["integrity_status"]) == (75.0, 0.0, "NORMAL")
    assert (b["P_ref"], b["identity_scope_level"], b["integrity_status"], b["CS"]) == (None, None, "COLD_START", 0.0)


def test_config():
    from tidemark.sources import config

    assert config.load({}) == config.Config()
    got = config.load({"TIDEMARK_QUEUE": "q", "TIDEMARK_POLL_SECONDS": "x", "TIDEMARK_PROFILE": "HARDENED"})
    assert (got.queue, got.poll_seconds, got.profile) == ("q", 5, "HARDENED")


def test_hashes_and_differences(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert audit.file_hashes(spark, str(tmp_path / "a.txt")).first()["sha256"] == hashlib.sha256(b"x").hexdigest()
    flat = lambda o: audit.flatten_json(spark.createDataFrame([(json.dumps(o),)], "json string"))
    got = {r["key"]: r["status"] for r in audit.compare(flat({"a": 1, "b": {"c": 2, "d": 3}, "x": 0}), flat({"a": 1, "b": {"c": 5, "d": 3}, "y": 0}), "key", "value").collect()}
    assert got == {"a": "PASS", "b.c": "MISMATCH", "b.d": "PASS", "x": "MISSING_ACTUAL", "y": "MISSING_EXPECTED"}
    found = {(r["version"], r["kind"], r["n"]) for r in audit.versions(spark.createDataFrame([("v0.6.0 and 0.6 and PSL-2026-01-01, 0.6.0",)], "text string")).collect()}
    assert found == {("0.6.0", "semantic", 2), ("0.6", "document", 1), ("PSL-2026-01-01", "snapshot", 1)}


def test_deep_differences_and_versions(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "list": [1, {"x": 2}], "empty": {}, "text": "t", "none": None}
    got = {r["key"]: r["value"] for r in audit.flatten_json(spark.createDataFrame([(json.dumps(deep),)], "json string")).collect()}
    assert got == {"a.b.c.d.e.f": "1", "list": '[1,{"x":2}]', "empty": "{}", "text": "t", "none": None}
    say = lambda *texts: audit.version_consistency(audit.versions(spark.createDataFrame([(t,) for t in texts], "text string"))).first()
    assert tuple(say("v0.6.0", "0.6")) == (True, True, True)
    assert tuple(say("0.6.0 0.6.1", "0.7")) == (False, False, False)


def test_conformance_checks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "sub" / "b.txt").write_text("y")
    files = audit.manifest(audit.file_hashes(spark, f"{tmp_path}/**/*.txt").union(audit.file_hashes(spark, f"{tmp_path}/*.txt")).distinct(), str(tmp_path))
    registered = spark.createDataFrame([("a.txt", hashlib.sha256(b"x").hexdigest()), ("sub/b.txt", "0"), ("gone.txt", "1")], "file string, sha256 string")
    assert {r["check"]: r["status"] for r in audit.check_hashes(registered, files).collect()} == {"hash:a.txt": "PASS", "hash:sub/b.txt": "FAIL", "hash:gone.txt": "FAIL"}
    assert {r["check"]: r["status"] for r in audit.check_presence(registered.select("file"), files, "file").collect()} == {"present:a.txt": "PASS", "present:sub/b.txt": "PASS", "present:gone.txt": "FAIL"}
    registry = spark.createDataFrame([('{"protocol_version": "0.6.0"}',)], "json string")
    assert {r["check"]: r["status"] for r in audit.check_fields(registry, ["protocol_version", "source_files"]).collect()} == {"field:protocol_version": "PASS", "field:source_files": "FAIL"}
    pairs = lambda *rows: spark.createDataFrame(rows, "name string, version string")
    got = audit.check_versions(pairs(("p", "0.6.0"), ("c", "0.6.0")), pairs(("spec", "0.6"), ("old", "0.5")), pairs(("psl", "PSL-2026-01-01"), ("bad", "2026")))
    assert {r["check"]: r["status"] for r in got.collect()} == {
        "versions:code": "PASS", "versions:document:spec": "PASS", "versions:document:old": "WARN", "versions:snapshot:psl": "PASS", "versions:snapshot:bad": "WARN",
    }
    assert {r["status"]: r["n"] for r in audit.report(got).collect()} == {"PASS": 3, "WARN": 2}
