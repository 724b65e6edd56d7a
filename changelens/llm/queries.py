"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import ship
from . import brown, decontaminate, embeddings, lines, minhash, packing, passages, secrets, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded_digest(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end=2)


def op3_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_in", "lines_removed")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end=0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.selectExpr("doc_id", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false) as held_out", "score", f"cast(score >= {toxicity.THRESHOLD} as int) as predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_token_files, op3_embedding_duplicates, op4_line_dedup, op5_repeated_passages, op6_brown_scores, op7_decontamination, op8_secrets, op9_packing, op10_toxicity)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from d left join n on n.doc_id = d.doc_id join c on c.a = d.doc_id
"""

_VECTORS = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings),
f as (select *, sqrt(list_sum(list_transform(x, lambda z: z * z))) as norm from v where label is not null and x is not null and len(list_filter(x, lambda z: z is null or not isfinite(z))) = 0),
u as (select * from f where norm > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by 1),
k as (select a, count(*) as n from l group by 1)
select vec_id, coalesce(k.n, 0) as n_links, c.component_id, vec_id = c.component_id as kept from embeddings left join k on k.a = vec_id join c on c.a = vec_id
"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_LEAKS = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
p as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as g from b where len(w) > 0),
z as (select distinct n from p),
t as (select doc_id, z.n as n, unnest(range(1, len(w) - z.n + 2)) as i, w from d, z where len(w) >= z.n),
o as (select doc_id, item_id, t.i, t.n from t join p on p.n = t.n and p.g = array_to_string(t.w[t.i:t.i + t.n - 1], ' ')),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from o) group by 1),
m as (select doc_id, count(*) as n_items, sha256(string_agg(id, ',' order by id)) as items_sha256 from (select distinct doc_id, item_id::varchar as id from o) group by 1)
select d.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on h.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_near_duplicates": _NEAR,
    "op3_embedding_duplicates": _VECTORS,
    "op7_decontamination": _LEAKS,
    "op4_line_dedup": """
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
w as (select doc_id, text, unnest(range(len(lines) - 2)) as pos, lines from d where len(lines) >= 3),
p as (select doc_id, text, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] as passage from w),
r as (select doc_id, text, pos, row_number() over (partition by passage order by doc_id, pos) as k from p),
gone as (select distinct doc_id, text, pos + j.j as line from r, (select unnest(range(3)) as j) j where k > 1),
kept as (select d.doc_id, d.text, l.i as line, d.lines[l.i + 1] as s from d, lateral (select unnest(range(len(d.lines))) as i) l)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(len(d.lines), 0) as lines_in, coalesce(g.n, 0) as lines_removed
from d
left join (select kept.doc_id, kept.text as own, string_agg(kept.s, chr(10) order by kept.line) as text from kept
  left join gone on kept.doc_id = gone.doc_id and kept.text = gone.text and kept.line = gone.line where gone.line is null group by 1, 2) k on d.doc_id = k.doc_id and d.text = k.own
left join (select doc_id, text, count(*) as n from gone group by 1, 2) g on d.doc_id = g.doc_id and d.text = g.text
"""
}
