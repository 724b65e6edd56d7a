import random

from pyspark.sql import functions as F

from changelens.functions import text as T


def truth(spark, rows, expression):
    df = spark.createDataFrame(rows, "a string, b string")
    return [r.t for r in df.repartition(1).select(expression(F.col("a"), F.col("b")).alias("t"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]


def test_fuzzy(spark):
    cases = [("validate", "input validation", True), ("LoginForm", "login form", True), ("Logging", "login", False), ("STRIPE_SECRET_KEY", "STRIPE_PUBLIC_KEY", False), ("generateReport", "report page", True), ("ky", "sky", True), ("", "x", False), ("!!", "!!", False)]
    assert truth(spark, [c[:2] for c in cases], T.fuzzy) == [c[2] for c in cases]


def test_endpoints(spark):
    cases = [("/api/users/bulk", "/api/users", False), ("/api/users", "/api/user", True), ("/api/users/[id]", "/api/users", False), ("/", "/", False), ("/api/a/:id", "GET /api/a/{x}", True)]
    found = truth(spark, [c[:2] for c in cases], lambda a, b: F.exists(T.endpoint_candidates(b), lambda c: T.endpoint_matches(T.norm_endpoint(a), c)))
    assert found == [c[2] for c in cases]


def test_symbols_and_typos(spark):
    assert truth(spark, [("loginform", "lognformsetingspage"), ("producthealth", "listproductsendpoint"), ("auth", "auto")], T.symbol_in_norm) == [True, False, False]
    assert truth(spark, [("setings", "settings"), ("form", "from"), ("abc", "abd"), ("requirments", "requirements")], T.typo) == [True, False, False, True]


def test_alignment_closed_forms(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for _ in range(1500)]
    exact = [T.osa_distance(a, b) for a, b in rows]
    assert truth(spark, rows, T.osa_one) == [x <= 1 for x in exact]
    assert truth(spark, rows, T.osa_two) == [x <= 2 for x in exact]
    assert truth(spark, rows, lambda a, b: T.osa(a, b)) == exact


def test_paths(spark):
    cases = [("src/a/b.ts", "src/a", True), ("src/a/b.ts", "src/a.ts", False), ("a/settings.ts", "the setings page", True), ("x/y.ts", "y.ts", True), ("src/nav.ts", "logout button in navbar", False), ("src/navbar.ts", "button in navbar", True)]
    assert truth(spark, [c[:2] for c in cases], lambda a, b: T.member_path(a, F.array(b))) == [c[2] for c in cases]
