from changelens.operators import compare, diff, impact, scope
from changelens.plans.audit import audit

DIFF = """diff --git a/web/settings.tsx b/web/settings.tsx
--- a/web/settings.tsx
+++ b/web/settings.tsx
+export function LoginForm() {
+  // process.env.IGNORED
--- a/package.json
+++ b/package.json
+    "payments-sdk": "^14.0.0",
+    "version": "1.0.0",
new file mode 100644
--- /dev/null
+++ b/app/checkout/route.ts
+const key = process.env.PAY_KEY
+export async function POST() {
--- a/.env.example
+++ b/.env.example
+PAY_KEY=1
new file mode 100644
--- /dev/null
+++ b/jobs.config.ts
+cron.schedule("0 * * * *", run)
+server.listen(8080)
++++ b/odd
-function gone() { return 2 }
+function back() { return 2 }"""


def run(spark, text, entries):
    lines = diff.split_lines(spark.createDataFrame([(1, text), (2, "no headers\n+import os"), (3, ""), (4, None)], "audit_id long, diff string"))
    long = spark.createDataFrame(entries, "audit_id long, field string, entry string, pos int")
    return audit(lines, compare.scope_rows(long))


def test_surface_findings_and_scores(spark):
    a = run(spark, DIFF, [(1, "features", "login form on the settings page", 0), (1, "files", "web/settings.tsx", 0), (1, "files", "", 1)])
    actual = {r.audit_id: r for r in a.actual.collect()}
    one = actual[1]
    assert one.file == ["web/settings.tsx", "package.json", "app/checkout/route.ts", ".env.example", "jobs.config.ts"]
    assert one.symbol == ["LoginForm"] and one.dep == ["payments-sdk"] and one.env == ["PAY_KEY"]
    assert one.endpoint == ["/checkout"] and one.listener == ["listen(:8080)"] and one.cron == ['cron.schedule("0 * * * *", run)']
    assert actual[2]["import"] == ["os"] and actual[2].file == []
    found = [(r.kind, r.evidence) for r in a.findings.where("audit_id = 1").orderBy("ord").collect()]
    assert [k for k, _ in found] == ["scope.file", "scope.dep", "scope.env", "scope.endpoint", "scope.cron", "scope.listener"]
    scores = {r.audit_id: (r.n_findings, r.score) for r in a.scores.collect()}
    assert scores[1] == (6, "HIGH") and scores[2] == (0, "LOW")


def test_impact(spark):
    rows = {r.pattern: r.files for r in run(spark, DIFF, []).warnings.where("audit_id = 1").collect()}
    assert rows["route-no-test"] == ["app/checkout/route.ts"] and "deps-no-lockfile" in rows and "new-file-not-imported" in rows


def test_group_rules(spark):
    a = run(spark, "+++ b/a.py\n+cron.schedule(x)\n+server.listen(90)", [(1, "behavioral", "nightly tidy", 0)])
    assert a.findings.where("audit_id = 1").count() == 1  # the job is covered by a word, the listener is not
    b = run(spark, "+++ b/a.py\n+server.listen(90)", [(1, "features", "export news", 0)])
    assert b.findings.where("audit_id = 1").count() == 0  # "port" stands in export


def test_prompt_scope(spark):
    p = spark.createDataFrame([(1, "Add /api/ping to src/app.py and use stripe nightly. Set API_KEY_X"), (2, None), (3, "")], "audit_id long, prompt string")
    rows = {r.audit_id: r for r in scope.extract(p).collect()}
    assert rows[1].endpoints == ["/api/ping"] and rows[1].files == ["src/app.py"] and "stripe" in rows[1].deps and rows[1].env == ["API_KEY_X"] and rows[1].behavioral == ["nightly (scheduled task)"]
    assert rows[2].files == [] and rows[3].features == []


def test_chunks(spark):
    text = "One two. " * 200 + "\n\n" + "x" * 1500
    rows = scope.chunks(spark.createDataFrame([(1, text), (2, "short")], "audit_id long, prompt string")).orderBy("audit_id", "chunk").collect()
    assert all(len(r.text) <= 600 for r in rows) and [r.text for r in rows if r.audit_id == 2] == ["short"]
    # the last sentence of the long paragraph has no white space after its mark, and the pattern loses it
    assert "".join(r.text for r in rows if r.audit_id == 1).replace(" ", "") == ("One two. " * 199 + "x" * 1500).replace(" ", "")


def test_empty(spark):
    lines = spark.createDataFrame([], "audit_id long, line_no int, raw string")
    a = audit(lines, compare.scope_rows(spark.createDataFrame([], "audit_id long, field string, entry string, pos int")))
    assert a.findings.count() == 0 and a.scores.count() == 0 and a.warnings.count() == 0
    assert impact.warnings(diff.file_stats(diff.scan(lines))).columns == ["audit_id", "ord", "pattern", "message", "files", "suggestion"]
