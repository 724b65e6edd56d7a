import datetime as dt

from pyspark.sql import functions as F

from changelens.operators import claims, contracts, coordination, ledger, telemetry
from changelens.sources import stores

T0 = dt.datetime(2024, 1, 1, 12)


def test_stores_that_are_missing_broken_or_no_array(spark, tmp_path):
    for name, text in {"good": '[{"id": 1}, {"id": 2}]', "broken": '[{"id": 1}, {"id"', "object": '{"id": 1}', "empty": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda name: sorted(r.id for r in stores.read_store(spark, str(tmp_path / f"{name}.json"), "id int").collect())
    assert read("good") == [1, 2] and read("broken") == read("object") == read("empty") == read("missing") == []


def test_resolutions_in_order(spark):
    records = spark.createDataFrame([("a", ["f", "g"], ["x", "y"], "open", None, None), ("b", ["h"], ["x", "z"], "resolved", "block", "ann")], "conflict_id string, files array<string>, agents array<string>, status string, strategy string, resolved_by string")
    asked = spark.createDataFrame([(1, "a", "escalate", "bob", T0), (2, "a", "block", "cy", T0), (3, "b", "block", "cy", T0), (4, "none", "block", "cy", T0)], "request_id long, conflict_id string, strategy string, resolved_by string, at timestamp")
    found = {r.request_id: (r.outcome, r.detail) for r in claims.resolve(asked, records).collect()}
    assert found[1][0] == "resolved" and "escalated" in found[1][1] and "[f, g]" in found[1][1] and "[x, y]" in found[1][1]
    assert found[2] == ("already_resolved", "Conflict already resolved via escalate by bob") and found[3] == ("already_resolved", "Conflict already resolved via block by ann") and found[4] == ("not_found", "No conflict with ID none")
    assert claims.open_conflicts(records, claims.resolve(asked, records)).count() == 0


def test_scope_fold_keeps_order_of_holders_and_revives(spark):
    rows = [
        (1, "r", "A", "claim", ["f"], [], -1, 0), (2, "r", "B", "claim", ["g"], [], -1, 1), (3, "r", "C", "claim", ["g", "f"], [], -1, 2), (4, "r", "A", "renew", [], [], -1, 100),
        (5, "r", "C", "claim", ["f"], [], -1, 130), (6, "r", "C", "claim", ["g"], [], -1, 131), (7, "r", "A", "renew", [], [], -1, 300), (8, "r", "C", "claim", ["f"], [], -1, 301), (9, "s", "C", "claim", ["f"], [], -1, 0),
    ]
    df = spark.createDataFrame([(*r[:7], T0 + dt.timedelta(minutes=r[7])) for r in rows], "op_id long, root string, agent string, op string, files array<string>, deps array<string>, parent long, at timestamp")
    found = {r.op_id: (r.status, r.conflicts) for r in claims.fold_scope_claims(df).collect()}
    assert found[3] == ("rejected", "g:B,f:A") and found[5] == ("rejected", "f:A") and found[6][0] == "locked"
    # A's claim ran out before 300, and nothing had looked since: the renewal brings it back
    assert found[7][0] == "renewed" and found[8] == ("rejected", "f:A") and found[9][0] == "locked"


def test_skips_and_contexts(spark):
    rows = spark.createDataFrame([(1, 3, "HIGH", True, True), (2, 3, "HIGH", True, False), (3, 3, "HIGH", None, True)], "audit_id long, n_findings long, score string, extraction_failed boolean, key_configured boolean")
    assert [(r.n_findings, r.score, r.skipped) for r in contracts.with_skips(rows).orderBy("audit_id").collect()] == [(0, "LOW", True), (3, "HIGH", False), (3, "HIGH", False)]
    schema = "id long, parent_id long, goal string, constraints string, decisions string, agent string, prompt_hash string, scope_summary string, findings_count long, score string, issued_at timestamp"
    made = contracts.whole(spark.createDataFrame([(1, None, "ship", None, None, None, "h1", "2 files", 0, "LOW", T0), (2, 1, None, "no cron", None, "b", "h2", "1 deps", 1, "MEDIUM", T0), (3, 2, "other", None, None, "c", "h3", "", 2, "HIGH", T0)], schema))
    found = {r.id: r for r in made.collect()}
    assert (found[2].goal, found[2].constraints, found[3].goal, found[3].constraints, found[3].decisions) == ("ship", "no cron", "other", "no cron", None)
    assert found[1].links == [] and [(x.contract_id, x.agent, x.score) for x in found[3].links] == [(1, "unknown", "MEDIUM"), (2, "b", "HIGH")]


def test_deltas_and_cutoffs(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    entries = spark.createDataFrame([(1, "Ann", "plan", "a.ts", "LOW", 0, at(0)), (2, "bob", "code", "", "HIGH", 2, at(1)), (3, "cy", "test", "c.ts", "LOW", 0, at(2))], "entry_id long, agent string, task string, file string, score string, findings_count long, at timestamp")
    text = {r.agent: r.text for r in ledger.deltas(entries).collect()}
    assert text["ann"].splitlines()[1] == "1. [bob] code (HIGH, 2 findings, files: none) — 2024-01-01 13:00:00" and "2 new entries" in text["ann"] and text["cy"].startswith("No work recorded since cy")
    asked = spark.createDataFrame([(1, "2024-01-01 12:30:00", "ANN"), (2, "soon", "ann"), (3, None, "ghost"), (4, "2024-01-01 11:00:00", "ann")], "request_id long, since string, agent string")
    found = {r.request_id: r for r in ledger.cutoffs(asked, entries).collect()}
    assert found[1].cutoff == at(0.5) and found[2].cutoff is None and found[2].invalid_since == "soon" and "ghost" in found[3].note and found[4].cutoff == at(0)


def test_gate_report_and_runs(spark):
    changed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "audit_id long, file string")
    records = spark.createDataFrame([("k2", ["a"], ["x", "y"], "open"), ("k1", ["a"], ["x", "z"], "open"), ("k0", ["c"], ["x"], "resolved")], "conflict_id string, files array<string>, agents array<string>, status string")
    held = spark.createDataFrame([("b", "x", "scope", "modify")], "file string, agent string, kind string, op string")
    found = {r.audit_id: r for r in coordination.gate_report(changed, records, held).collect()}
    assert found[1].blocked and "a — conflict k1 between [x, z]" in found[1].text and "b [modify] — x (scope)" in found[1].text and found[2].text.endswith("RESULT: PASS")
    assert coordination.gate_report(changed, records, held, strict=True).where("audit_id = 2 and blocked").count() == 1
    out = [("m", "a", "26/26 passed, 0 failed"), ("m", "b", "7 passed, 3 failed"), ("m", "c", "SKIP: none"), ("n", "a", None)]
    rows = {(r.model, r.suite): r for r in telemetry.suite_results(spark.createDataFrame(out, "model string, suite string, output string")).collect()}
    assert rows["m", "a"].good and not rows["m", "b"].good and rows["m", "b"].total == 10 and rows["m", "c"].skipped and rows["n", "a"].passed is None


def test_payloads_are_typed(spark):
    good = '{"event": "init", "os": "a", "arch": "b", "node": "c", "vendors": 2, "v": "1", "ts": "t"}'
    rows = spark.createDataFrame([(good,), (good.replace('"b"', "7"),), (good.replace("2,", '"2",'),), ("[]",), ("{x",), (None,), (good.replace("init", "exit"),)], "body string")
    assert [(r.os, r.vendors) for r in telemetry.valid_payloads(rows).collect()] == [("a", 2)]


def test_generated_code_compiles(spark, capfd):
    """The headline plans stay within what a compiled stage may have."""
    from changelens.plans.queries import QUERIES

    spark.sparkContext.setLogLevel("WARN")
    try:
        for name in ("x13_surface", "c08_scores", "b00_warnings"):
            QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    out, err = capfd.readouterr()
    assert "ailed to compile" not in out + err and "grows beyond 64 KB" not in out + err


def test_touches_near_the_edges_of_buckets(spark):
    asked = spark.createDataFrame([(1, "f", "a", T0), (2, "f", "b", T0 + dt.timedelta(minutes=59))], "request_id long, file string, agent string, at timestamp")
    touched = spark.createDataFrame([("f", "z", T0 - dt.timedelta(minutes=59)), ("f", "y", T0 - dt.timedelta(minutes=60)), ("f", "b", T0), ("f", "x", T0 + dt.timedelta(minutes=1))], "file string, agent string, at timestamp")
    none = touched.limit(0).select("file", "agent", F.col("at").alias("expires_at"))
    assert {(r.request_id, r.agent) for r in claims.conflicts(asked, none, touched).collect()} == {(1, "z"), (1, "b"), (2, "x")}
