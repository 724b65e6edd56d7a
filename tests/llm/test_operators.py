import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import brown, decontaminate, embeddings, graph, lines, minhash, packing, passages, secrets, token_files, toxicity

P = pytest.importorskip("public_tokenizers")
rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG, PASSAGE = prose(4000, 1), prose(60, 2)
EDITED = " ".join(w if i % 60 else "edited" for i, w in enumerate(prose(300, 4).split()))
ROWS = [
    (1, prose(300, 4)), (2, prose(300, 4)), (3, EDITED), (4, None), (5, ""), (6, "   "), (7, "two words"), (8, "two words"), (9, LONG), (10, prose(200, 5) + " " + PASSAGE), (11, prose(150, 6) + " " + PASSAGE + " " + prose(50, 7)),
    (12, "l1\nl2\nl3\nl4"), (13, "x\nl1\nl2\nl3\ny"), (14, "l1\nl2"), (14, "l1\nl2"), (None, prose(80, 8)), (15, "q\nq\nq\nq\nq"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("kept", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in graph.components(links).collect()}
    assert all(found[i] == 1 for i in range(2, 61)) and found[200] == 100 and 100 not in found


def test_near_duplicates_in_a_crowded_region(spark):
    # 1500 texts that are 0.75 alike, and 150 pairs of 0.82 among them
    base = prose(400, 60).split()

    def variant(seed, text, n):
        r, out = random.Random(seed), list(text)
        for i in r.sample(range(len(out)), n):
            out[i] = f"w{seed}x{i}"
        return out

    texts = [variant(1000 + i, base, 12) for i in range(1500)]
    pairs = [(i, 2000 + i) for i in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(j, " ".join(variant(9000 + j, texts[i], 8))) for i, j in pairs]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, x in rows for w in [x.split()]}
    want = {(a, b) for a in range(1500) for b in (2000 + a,) if a < 150 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=5))
    met = sum(found[a].component_id == found[b].component_id for a, b in want)
    assert len(want) > 100 and met >= 0.95 * len(want)
    assert sum(found[i].component_id != i for i in range(1500)) <= 20 * len(want)


def test_components_in_few_steps(spark, monkeypatch):
    # a long chain, dealt at random: few links end in one task, more in stars; later links only move roots
    from changelens.llm import store

    r, made, write = random.Random(76), [], store.written
    nodes = r.sample(range(10_000), 900)
    links = list(zip(nodes[:599], nodes[1:600], strict=True)) + list(zip(nodes[600:899], nodes[601:900], strict=True))
    r.shuffle(links)
    table = spark.createDataFrame(links, "a long, b long").repartition(6)
    more = spark.createDataFrame([(nodes[5], nodes[700]), (nodes[3], nodes[9]), (20_000, 20_001)], "a long, b long")
    want = {n: min(nodes) for n in nodes} | {20_001: 20_000}
    monkeypatch.setattr(store, "written", lambda df, name: made.append(name) or write(df, name))
    for one in (graph.ONE, 0):
        monkeypatch.setattr(graph, "ONE", one)
        made.clear()
        root = graph.components(table)
        assert one == 0 or len(made) <= 2, made
        got = {x.node: x.root for x in graph.joined(root, more, store.Scratch()).collect()}
        assert got == {n: t for n, t in want.items() if n != t}


def test_near_duplicates_of_one_text(spark):
    # 3000 texts that are 0.85 like one text and 0.72 like each other, so links lead to that one only
    base = prose(200, 70).split()

    def variant(seed, at):
        return " ".join(f"v{seed}x{i}" if i in at else w for i, w in enumerate(base))

    r = random.Random(71)
    rows = [(0, "own " * 8), (3500, " ".join(base))] + [(1 + i, variant(i, set(r.sample(range(4, 196), 4)))) for i in range(3000)]
    found = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=4))
    assert found[0].component_id == 0
    assert sum(found[1 + i].component_id == found[3500].component_id for i in range(3000)) >= 0.99 * 3000


def test_near_duplicates_in_blocks(spark, monkeypatch):
    # the same components whatever the blocks that a bucket is dealt in
    r = random.Random(72)
    base = prose(100, 73).split()
    texts = [set(r.sample(range(100), 4)) for _ in range(120)]
    rows = [[f"b{i}x{k}" if k in at else w for k, w in enumerate(base)] for i, at in enumerate(texts)]
    rows += [[w if k != 50 else f"c{i}" for k, w in enumerate(t)] for i, t in enumerate(rows)]
    sets, sizes = minhash.sets(*minhash.tk.buffers(minhash.pa.array([" ".join(t) for t in rows])), 4)
    sets = np.split(sets, np.cumsum(sizes)[:-1])
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    want = list(range(len(rows)))
    for a, b in links:
        want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    signs = minhash.signatures(np.concatenate(sets), sizes)
    low, tops = signs.astype(np.uint8), minhash.heads(signs)
    monkeypatch.setattr(minhash, "_AGREE", 0)
    for room in (1 << 20, 2000):
        monkeypatch.setattr(minhash, "_ROOM", room)
        n = len(rows)
        table = minhash.pa.RecordBatch.from_pydict({"tree": np.zeros(n, np.int32), "key": [b"k"] * n, "doc_id": np.arange(n), "root": np.arange(n), "n": sizes, "low": [x.tobytes() for x in low], "heads": [x.tobytes() for x in tops]})
        units = list(minhash._units(iter([table.slice(0, 50), table.slice(50)])))
        assert (len({(b["i"][0].as_py(), b["j"][0].as_py()) for b in units}) > 1) == (room == 2000)
        got = list(range(n))
        for unit in units:
            full = unit.append_column("shingles", minhash.pa.array([sets[i].tobytes() for i in unit["doc_id"].to_pylist()]))
            for found in minhash._joining(80)(iter([full])):
                for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
                    assert (max(a, b), min(a, b)) in links
                    got = [min(got[a], got[b]) if x in (got[a], got[b]) else x for x in got]
        assert got == want and len(set(want)) < n


def test_near_duplicates_write_few_rows(spark, monkeypatch):
    # texts that are about 0.72 alike and hardly link: rows of every table stay in proportion to the texts
    base, made = prose(200, 74).split(), {}
    r = random.Random(75)
    texts = [set(r.sample(range(200), 4)) for _ in range(1000)]
    rows = [(i, " ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base))) for i, at in enumerate(texts)]
    write = minhash.store.Scratch.written

    def counted(self, df, name):
        out = write(self, df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash.store.Scratch, "written", counted)
    assert minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).count() == 1000
    # 16 orders, each with three pairs, and the ids of both ends of a full window
    assert max(made.values()) <= 16 * 5 * 1000, made


def test_sieve(spark):
    from changelens.llm import store

    keys = spark.range(0, 5000).select(F.col("id").alias("k"))
    rows = store.sifted(spark.range(0, 50_000).select(F.col("id").alias("word"), F.lit(1).alias("h")), store.sieve(keys), F.col("word"))
    assert rows.columns == ["word", "h", "maybe"] and rows.where("maybe and word < 5000").count() == 5000 and rows.where("maybe").count() < 5200


def test_near_duplicates(docs, empty):
    found = by_id(minhash.near_duplicates(docs, k=5))
    assert found[1].component_id == found[2].component_id == found[3].component_id == 1 and not found[2].kept and found[1].kept
    assert found[8].component_id == 7 and found[7].n_shingles == 1 and found[4].n_shingles == found[6].n_shingles == 0 and found[5].kept
    kept = [r.doc_id for r in minhash.dedup(docs).collect()]
    assert sorted(x for x in kept if x) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15] and kept.count(None) == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = token_files.encoded_digest(docs, path, 2).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    want = sorted(((d, x) for d, x in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    assert [r.n_tokens for r in rows] == [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in want]
    assert token_files.encoded_digest(empty, path, 2).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), 0, with_ids=True).collect()
    own = {}
    for r in sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.start):
        own.setdefault(9, []).extend(r.ids)
    from tokenizers import Tokenizer

    assert own[9] == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids + [0]
    assert sum(r.length for r in rows if r.doc_id in (4, 5)) == 2
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), 0).count() == 0


def test_lines(docs, empty):
    found = by_id(lines.dedup_lines(docs))
    assert found[12].text == "l1\nl2\nl3\nl4" and found[13].text == "x\ny" and found[13].lines_removed == 3 and found[14].text == "l1\nl2" and found[4].text is None and found[15].text == "q" and found[13].n_tokens == "clash"
    assert lines.dedup_lines(docs).count() == len(ROWS) and lines.dedup_lines(empty).count() == 0


def test_passages(docs, empty):
    rows = passages.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in rows}
    assert {(2, 1), (3, 1), (11, 10)} <= pairs and {d for p in pairs for d in p} <= {1, 2, 3, 10, 11}
    hit = next(r for r in rows if (r.doc_id, r.first_doc_id) == (11, 10))
    assert (hit.start, hit.n_words, hit.first_start, hit.matched) == (150, 60, 200, 60)
    assert passages.repeated_passages(empty).count() == 0


def test_passages_whose_parts_stand_elsewhere(spark):
    # 100 and 101 share 200 words; pieces of at most 31 words of them stand in 14 earlier documents; 3 and 4 share 60, whose halves stand in 1 and 2
    shared, joint = prose(200, 70).split(), prose(60, 71).split()
    rows = [(10 + i, prose(40, 700 + i) + " " + " ".join(shared[i * 14 : i * 14 + 31]) + " " + prose(40, 800 + i)) for i in range(14)]
    rows += [(100, prose(50, 72) + " " + " ".join(shared)), (101, prose(60, 73) + " " + " ".join(shared) + " " + prose(9, 74))]
    rows += [(1, prose(30, 75) + " " + " ".join(joint[:30])), (2, " ".join(joint[30:]) + " " + prose(30, 76)), (3, prose(10, 77) + " " + " ".join(joint)), (4, " ".join(joint) + " " + prose(70, 78))]
    # equal ids with different texts
    rows += [(200, prose(90, 79)), (200, prose(50, 80) + " " + PASSAGE), (201, PASSAGE + " " + prose(50, 81)), (201, prose(90, 82)), (201, prose(90, 82))]
    found = {(r.doc_id, r.first_doc_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole, half = found[101, 100], found[4, 3]
    assert (whole.start, whole.n_words, whole.matched) == (60, 200, 200) and (half.start, half.n_words, half.first_start) == (0, 60, 10) and found[201, 200].n_words == 60


def test_brown(docs, empty):
    import math
    import re
    import zlib
    from collections import Counter

    found = by_id(brown.score(docs, head=50, classes=8))
    token = lambda x: re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower()) + ["\n"]
    train = [token(x) for d, x in ROWS if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(t for x in train for t in x)
    n, v = sum(c.values()), len(c)
    for d, x in ROWS:
        want = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in token(x))
        assert abs(found[d].base_score - want) < 1e-6 * max(1, abs(want)) and found[d].train_tokens == n and found[d].n_tokens == len(token(x)) and found[d].n_known == sum(c[t] > 0 for t in token(x))
    assert brown.score(empty).count() == 0


def test_brown_beats_the_base_on_held_out_text(spark):
    # words of two kinds that alternate; most are beyond the head
    r = random.Random(12)
    kinds = [[f"{k}{i}" for i in range(300)] for k in "ab"]
    rows = [(i, " ".join(r.choice(kinds[k % 2]) for k in range(60))) for i in range(900)]
    found = [x for x in brown.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), head=250, classes=4).collect() if x.held_out]
    base, score = (sum(getattr(x, n) for x in found) / sum(x.n_tokens for x in found) for n in ("base_score", "score"))
    assert score > base + 0.15  # a factor of 2 a word would be 0.30


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "l3"), (None, "zzz"), (3, "l3")], "item_id long, text string")
    found = by_id(decontaminate.report(docs, items))
    assert found[10].n_hit == 60 and found[10].n_items == 1 and found[12].n_hit == 1 and not found[9].contaminated and found[4].n_words == 0
    cut = by_id(decontaminate.decontaminate(docs, items))
    assert cut[10].text == prose(200, 5) + " " and cut[12].text == "l1\nl2\n\nl4" and cut[4].text is None and cut[9].text == LONG
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0 and decontaminate.report(empty, items).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, prose(30, 4000 + i)) for i in range(40)] + [(100, PASSAGE), (101, " ".join(PASSAGE.split()[:14])), (3, "l3")], "item_id long, text string")
    one, cut = by_id(decontaminate.report(docs, items)), by_id(decontaminate.decontaminate(docs, items))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    many, cut_many = by_id(decontaminate.report(docs, items)), by_id(decontaminate.decontaminate(docs, items))
    assert one == many and cut == cut_many and one[10].n_items == 2 and one[10].spans == [(200, 260)] and one[12].n_hit == 1


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [0.0, 1.0], 1), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.1], 1), (11, [None, 1.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [], 1)]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert found[1] == (3, 1, True) and found[2] == (3, 1, False) and found[10] == (3, 1, False) and found[4] == (0, 4, True)
    assert all(found[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 11, 12, 13)) and found[None][0] == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 24))
    x = np.concatenate([r.normal(size=(1500, 24)), centres.repeat(50, 0) + r.normal(size=(2000, 24)) * r.uniform(0.05, 0.4, (2000, 1))])
    x[:4] = [[1e39] + [0] * 23, [1e39, 1e38] + [0] * 22, [1e-200] + [0] * 23, [1e300] + [0] * 23]
    label = r.choice(3, len(x), p=[0.9, 0.06, 0.04])
    label[:4] = 0
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1))[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero((u @ u.T >= 0.93) & (label[:, None] == label[None])), strict=True) if i != j}
    n = np.bincount([i for i, _ in want], minlength=len(x))
    df = spark.createDataFrame([(i, row.tolist(), int(c)) for i, (row, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(5)
    found = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    got = np.array([found[i].n_links for i in range(len(x))])
    assert len(want) > 10_000 and (got <= n).all() and got.sum() >= 0.999 * n.sum()
    assert found[1].component_id == 0 and found[2].n_links >= 2 and found[3].component_id == 0
    assert {(i, j) for i, j in want if found[i].component_id != found[j].component_id} == set()


def test_secrets(spark, empty):
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f"{prose(20, i)} token = \"{h}\" {prose(5, i)}") for i, h in enumerate(hexes)] + [(100 + i, prose(30, 500 + i) + " " + " ".join(prose(2, 7000 + 9 * i + k).replace(" ", "-") for k in range(9))) for i in range(200)] + [(600, None)]
    # findings that no base pattern knows: short passwords and long keys
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows += [(1000 + i, f"{prose(9, 600 + i)} pass: {value(12)} {prose(9, 700 + i)}") for i in range(100)] + [(2000 + i, f"{prose(9, 800 + i)} key={value(40)}\n{prose(9, 900 + i)}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = secrets.fit(docs.where("doc_id < 1000"))
    found = by_id(secrets.scan(docs, net))
    assert all(found[i].n_assign == 1 and found[i].n_hex == 1 for i in range(60)) and found[600].spans == ""
    assert sum(found[1000 + i].n_cnn > 0 for i in range(100)) >= 90 and sum(found[2000 + i].n_cnn > 0 for i in range(100)) >= 95
    # words that the network was not trained on
    plain = spark.createDataFrame([(i, prose(300, 30_000 + i)) for i in range(50)], "doc_id long, text string")
    assert sum(x.n_cnn for x in secrets.scan(plain, net).collect()) <= 50 * 300 * 0.002
    assert secrets.scan(empty, secrets.fit(docs)).count() == 0


def test_toxicity(spark, docs, empty):
    rows = [(i, prose(80, i) + (" vile rotten scoundrel " + prose(20, 900 + i) if i % 4 == 0 else "")) for i in range(1000, 1600)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(table, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    found = toxicity.score(table, model).withColumn("held", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")).where("held").collect()
    right = sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0) for r in found)
    assert len(found) > 100 and right >= 0.97 * len(found)
    assert toxicity.score(docs, model).count() == len(ROWS) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and toxicity.score(docs, none).where("score > 0").count() == 0


def test_toxicity_weaker_markers(spark):
    # one word marks half of the toxic texts, 160 others a tenth of the rest each: all of them have to count
    weak = sorted({"z" + "".join(random.Random(i).choices("klmnopqrstuvw", k=6)) for i in range(160)})
    rows, r = [], random.Random(5)
    for i in range(1600):
        toxic = i % 2 == 0
        marks = (["scoundrel"] if i % 4 == 0 else r.sample(weak, 16)) if toxic else []
        rows.append((i, " ".join(prose(30, 5000 + i).split() + marks + prose(10, 9000 + i).split()), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert len(model.toxic) > 128 * toxicity.CODE
    found = [(r.doc_id, r.score) for r in toxicity.score(table, model).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()]
    weakest = [s for d, s in found if d % 4 == 2]
    assert len(weakest) > 50 and sum(s >= toxicity.THRESHOLD for s in weakest) >= 0.97 * len(weakest)
    assert sum(s >= toxicity.THRESHOLD for d, s in found if d % 2) <= 0.03 * sum(d % 2 for d, _ in found)


def test_toxicity_large_dictionary():
    import numpy as np

    from changelens.llm import textkernel as tk

    stem = tk.mix(np.arange(100_000, dtype=np.uint64))
    made = toxicity.compressor(toxicity.codes(stem))
    some = np.random.default_rng(1).permutation(stem)[:2000]
    assert sum(len(made.compress(toxicity.codes(x))) < 12 * 16 for x in some.reshape(-1, 20)) >= 98


def test_secrets_candidates_and_recall(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from changelens.llm import textkernel as tk

    text = "k abcdefgh 1234567 12345678 " + "a/" * 40 + "Zq8LmT3vXw9K" + "/b" * 40
    data, offsets = tk.buffers(pa.array([text]))
    a, b, first, last = secrets.candidates(data, offsets)
    runs = {(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)}
    assert [text[x:y] for x, y in sorted(runs)][:2] == ["abcdefgh", "12345678"] and len(runs) == 3
    covered = np.zeros(len(text), bool)
    for x, y in zip(a, b, strict=True):
        covered[x:y] = True
    assert covered.sum() == sum(y - x for x, y in runs) and (b - a).max() <= secrets.SPAN
    # scores near a half: the threshold goes where the recall is, however low
    monkeypatch.setattr(secrets, "curve", lambda x, y: np.array([0.01, 0.0]))
    r = random.Random(4)
    noisy = [(i, f"{prose(20, i)} token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40)) if i % 2 else prose(1, i) * 3}\" {prose(5, i)}") for i in range(200)]
    noisy += [(500 + i, prose(20, 400 + i).replace(" ", "-")) for i in range(60)]
    net = secrets.fit(spark.createDataFrame(noisy, "doc_id long, text string"))
    assert net.threshold < 0.9
    x = np.random.default_rng(2).integers(0, 16, (300, secrets.WIDTH))
    assert np.allclose(net.logit(x), net.layers(x)[2] @ net.out + net.out_bias, atol=1e-3)
