import datetime as dt

from changelens.operators import claims
from changelens.streaming import streams

T0 = dt.datetime(2024, 1, 1)
EVENTS = [(1, "r", "f", "A", "claim", 0), (2, "r", "f", "B", "claim", 60), (3, "r", "f", "A", "claim", 90), (4, "r", "f", "B", "claim", 211), (5, "r", "f", "A", "release", 212), (6, "r", "f", "B", "extend", 213), (7, "r", "g", "A", "extend", 1)]
EXPECTED = {1: "claimed", 2: "conflict", 3: "claimed", 4: "claimed", 5: "none", 6: "extended", 7: "not_found"}


def events(spark):
    return spark.createDataFrame([(i, r, f, a, o, T0 + dt.timedelta(minutes=m)) for i, r, f, a, o, m in EVENTS], "op_id long, root string, file string, agent string, op string, at timestamp")


def test_file_fold(spark):
    assert {r.op_id: r.outcome for r in claims.fold_file_claims(events(spark)).collect()} == EXPECTED


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(src)
    q = streams.file_claims(spark.readStream.schema(events(spark).schema).parquet(src)).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.op_id: r.outcome for r in spark.table("folded").collect()} == EXPECTED


def test_scope_fold(spark):
    rows = [
        (1, "r", "A", "claim", ["f"], ["d"], -1, 0), (2, "r", "B", "claim", ["f", "g"], [], -1, 10), (3, "r", "B", "claim", ["g"], [], -1, 20), (4, "r", "C", "claim", ["f"], ["x"], 1, 30),
        (5, "r", "C", "claim", ["f"], ["d"], 1, 31), (6, "r", "A", "complete", [], [], -1, 40), (7, "r", "D", "renew", [], [], -1, 41),
    ]
    df = spark.createDataFrame([(*r[:7], T0 + dt.timedelta(minutes=r[7])) for r in rows], "op_id long, root string, agent string, op string, files array<string>, deps array<string>, parent long, at timestamp")
    found = {r.op_id: (r.status, r.conflicts) for r in claims.fold_scope_claims(df).collect()}
    assert found == {1: ("locked", ""), 2: ("rejected", "f:A"), 3: ("locked", ""), 4: ("rejected", ""), 5: ("locked", ""), 6: ("completed", ""), 7: ("none", "")}


def test_validate(spark):
    rows = spark.createDataFrame([('{"files": {"create": ["a"], "modify": "x"}, "dependencies": [1]}',), ("[]",), ("{}",)], "scope string")
    assert [r.errors for r in claims.validate(rows).collect()] == [["scope.files.modify must be an array", "scope.dependencies must contain only strings"], ["scope must be an object"], []]
