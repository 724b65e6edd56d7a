import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    prose = lambda n, s: " ".join(random.Random(s).choice(words) for _ in range(n))
    rows = [(i, prose(60, i) + (" vile rotten scoundrel " + prose(9, 5000 + i) if i % 5 == 0 else ""), "en", "s", 1) for i in range(300)]
    copy, item = rows[1][1], prose(14, 99_999)
    rows += [(1000, copy, "en", "s", 1), (1001, prose(40, 7777) + " " + item, "en", "s", 1), (1002, None, None, None, None), (1003, "a1\nb1\nc1\nd1", "en", "s", 1), (1004, "x1\na1\nb1\nc1", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{d}/{name.replace(' ', '-')}"
        stage(spark, now, d).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    gone = {i for i, *_ in rows} - set(seen["toxicity"])
    assert len([i for i in gone if i % 5 == 0 and i < 300]) >= 54 and len([i for i in gone if i % 5]) <= 3
    assert seen["line dedup"][1004] == "x1" and seen["line dedup"][1003] == "a1\nb1\nc1\nd1"
    assert 1000 not in seen["near-duplicates"] and 1 in seen["near-duplicates"]
    assert item not in seen["decontamination"][1001] and seen["decontamination"][1002] is None
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, d)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(seen["decontamination"])
    assert pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_stages_with_columns_of_any_name(spark, tmp_path):
    names = ["score", "text_", "__text", "lines_in", "lines_removed", "tie", "__tie", "t1", "t2", "spans", "maybe", "h", "word", "bits", "own", "other", "kept", "n", "id", "component_id"]
    docs = spark.createDataFrame([(1, "a\nb\nc\nd e f g"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (None, "l3 and more"), (None, None), (3, ""), (3, "l3 and more")], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    d = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "l3")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    seen = {}
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, d)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r[n] == f"own {n}" for r in rows for n in names)
            seen.setdefault(name, sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows))
    assert len(seen["toxicity"]) == len(seen["line dedup"]) == len(seen["decontamination"]) == 7
    assert seen["near-duplicates"].count((False, 2, "x\na\nb\nc")) == 1 and (False, 2, "x") in seen["line dedup"]
    assert (False, 3, " and more") in seen["decontamination"] and (True, 0, " and more") in seen["decontamination"]
