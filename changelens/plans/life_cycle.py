"""Registered queries for sources, contracts as a whole, scope claims, conflicts, check-ins and the gate's report, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..functions import fixed as X
from ..operators import claims, compare, contracts, coordination, diff, ledger, scope, telemetry
from ..sources import stores
from . import corpus
from .corpus import view
from .queries import _AS_OF, _CODE_OF, _FINDINGS, _HELD, _L, _P, _actual, _findings, _held, _lit, _moment, _scan, _scope, _scope_events, query


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    corpus.ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _list(name: str) -> F.Column:
    return F.filter(F.split(name, ","), lambda x: x != "")


def _sql_list(name: str) -> str:
    return f"list_filter(string_split({name}, ','), lambda x: x <> '')"


# --- S: sources and sinks ---------------------------------------------------------


@query("s01_read_diffs", "select n_nationkey::varchar as audit_id, '+++ b/' || n_name || chr(10) || '+x = ' || n_regionkey || chr(10) as diff from nation")
def _(spark, d):
    path = tables.new_path(spark, "diffs")
    text = F.concat(F.lit("+++ b/"), "n_name", F.lit("\n+x = "), F.col("n_regionkey").cast("string"))
    _read(spark, d, "nation").select(F.col("n_nationkey").alias("audit_id"), text.alias("value")).write.partitionBy("audit_id").text(path)
    return stores.read_diffs(spark, path, r"/audit_id=([^/]+)/").select("audit_id", "diff")


_SOURCES = "s as (select o_orderkey as audit_id, 1 as rank, 'staged' as label, case when o_orderkey % 2 = 0 then '+a' || chr(10) || '-b' || chr(10) || ' c' else ' ' || chr(10) end as diff from orders union all select o_orderkey, 2, 'unstaged', case when o_orderkey % 3 = 0 then '+' || o_custkey else '' end from orders union all select o_orderkey, 3, 'last commit', 'index' || chr(10) || '-gone' from orders)"


@query("s02_diff_sources", f"with {_SOURCES}, k as (select * from s where trim(replace(diff, chr(10), ' ')) <> '') select audit_id, rank, label, len(list_filter(string_split(diff, chr(10)), lambda l: l[1] in ('+', '-'))) as changed_lines, rank = min(rank) over (partition by audit_id) as chosen from k")
def _(spark, d):
    o = _read(spark, d, "orders")
    key = F.col("o_orderkey")
    made = [("staged", F.when(key % 2 == 0, "+a\n-b\n c").otherwise(" \n")), ("unstaged", F.when(key % 3 == 0, F.concat(F.lit("+"), F.col("o_custkey").cast("string"))).otherwise("")), ("last commit", F.lit("index\n-gone"))]
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("label"), x.alias("diff")) for i, (n, x) in enumerate(made, 1)])
    return stores.diff_sources(o.select(key.alias("audit_id"), F.explode(rows).alias("s")).select("audit_id", "s.*"))


@query("s03_prompt_sources", "select o_orderkey as audit_id, case when o_orderkey % 4 = 0 then 'file ' || o_custkey when o_orderkey % 4 = 1 then 'flag' else 'stored ' || o_orderpriority end as prompt from orders")
def _(spark, d):
    o, key = _read(spark, d, "orders"), F.col("o_orderkey")
    file = F.when(key % 4 == 0, F.concat(F.lit("file "), F.col("o_custkey").cast("string"))).when(key % 4 == 1, "\t")
    flag = F.when(key % 4 < 2, "flag").otherwise("")
    return o.select(key.alias("audit_id"), stores.prompt_of(F.nullif(F.trim(F.regexp_replace(file, r"\s+", " ")), F.lit("")), flag, F.concat(F.lit("stored "), "o_orderpriority")).alias("prompt"))


@query("s05_scope_argument", "select o_orderkey as audit_id, o_orderkey % 5 < 3 as valid, case when o_orderkey % 5 < 2 then 'a' || o_custkey || '.ts|b' else '' end as files, case when o_orderkey % 5 = 1 then 'zod' else '' end as deps, '' as env from orders")
def _(spark, d):
    o, key = _read(spark, d, "orders"), F.col("o_orderkey")
    files = F.concat(F.lit('{"files_allowed": ["a'), F.col("o_custkey").cast("string"), F.lit('.ts", "b"]'))
    arg = F.when(key % 5 == 0, F.concat(F.lit("  "), files, F.lit("}"))).when(key % 5 == 1, F.concat(files, F.lit(', "deps_allowed": ["zod"]}'))).when(key % 5 == 2, "{}").when(key % 5 == 3, "{broken").otherwise("[1]")
    rows = stores.scope_argument(o.select(key.alias("audit_id"), arg.alias("scope")))
    return rows.select("audit_id", "valid", *[F.array_join(f, "|").alias(f) for f in ("files", "deps", "env")])


@query("s06_json_store", "select r_regionkey as id, r_name as name from region union all select n_nationkey, n_name from nation")
def _(spark, d):
    path = tables.new_path(spark, "store")
    both = _read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).union(_read(spark, d, "nation").select("n_nationkey", "n_name"))
    both.agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value")).write.text(path)
    return stores.read_store(spark, path, "id int, name string").union(stores.read_store(spark, path + "-none", "id int, name string"))


@query("s07_append_store", "select o_orderstatus as status, count(*) as n from orders group by 1")
def _(spark, d):
    path, o = tables.new_path(spark, "log"), _read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"))
    stores.append_store(o.where("status = 'F'"), path)
    stores.append_store(o.where("status != 'F'"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query("s09_json_output", f"with {_FINDINGS}, a as (select distinct audit_id from lines), n as (select audit_id, count(*) as n from found group by 1) select audit_id, '{{\"audit_id\":' || audit_id || ',\"n_findings\":' || coalesce(n, 0) || '}}' as json from a left join n using (audit_id)")
def _(spark, d):
    actual = _actual(spark, d)
    return stores.to_json(compare.scores(compare.findings(actual, _scope(spark, d)), actual).select("audit_id", "n_findings"))


@query("s11_real_files", f"with {_FINDINGS}, p as (select f.audit_id, f.ord, arg_min(s.file, s.line_no) as at_file from found f join scan s on s.audit_id = f.audit_id and s.side = '+' and contains(s.code, f.evidence) group by 1, 2) select f.audit_id, f.ord, case when kind = 'scope.file' then evidence else coalesce(at_file, {_CODE_OF}) end as real_file from found f left join p using (audit_id, ord)")
def _(spark, d):
    return stores.real_files(_findings(spark, d), diff.added_lines(_scan(spark, d))).select("audit_id", "ord", "real_file")


# --- L, K: replies and contracts ----------------------------------------------------


@query("l06_stored_replies", f"with {_P} select audit_id, case when audit_id % 3 = 0 then 'x' || audit_id || '.ts|y.ts' end as told, audit_id % 3 <> 0 as fell_back from p")
def _(spark, d):
    prompts = view(spark, d, "prompts")
    one = F.concat(F.lit('```json\n{"files_allowed": ["x'), F.col("audit_id").cast("string"), F.lit('.ts"]}\n```'))
    two = F.concat(F.lit('{"scope": {"files_allowed": ["y.ts", "x'), F.col("audit_id").cast("string"), F.lit('.ts"]}}'))
    sections = F.array(F.struct(F.lit(1).alias("section"), one.alias("reply")), F.struct(F.lit(2).alias("section"), two.alias("reply")))
    good = prompts.where("audit_id % 3 = 0").select("audit_id", F.explode(sections).alias("s")).select("audit_id", "s.*")
    bad = prompts.where("audit_id % 3 = 1").select("audit_id", F.lit(1).alias("section"), F.lit("no JSON here").alias("reply"))
    found = scope.with_replies(prompts, good.union(bad))
    return found.select("audit_id", F.when(~F.col("fell_back"), F.array_join("files", "|")).alias("told"), "fell_back")


@query("k03_skipped", "select event_id as audit_id, case when event_id % 3 = 0 and event_id % 2 = 0 then 0 else user_id end::bigint as n_findings, case when event_id % 6 = 0 then 'LOW' else 'HIGH' end as score, event_id % 6 = 0 as skipped from events")
def _(spark, d):
    rows = _read(spark, d, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("n_findings"), F.lit("HIGH").alias("score"), (F.col("event_id") % 3 == 0).alias("extraction_failed"), (F.col("event_id") % 2 == 0).alias("key_configured"))
    return contracts.with_skips(rows).select("audit_id", F.col("n_findings").cast("long").alias("n_findings"), "score", "skipped")


_WHOLE = f"""with recursive c as ({corpus.CONTRACTS}),
a as (select *, case when id % 5 = 0 then 'goal ' || id end as goal, case when id % 7 = 0 then 'not ' || id end as constraints, case when parent_id is null then 'agree' end as decisions, case when id % 4 <> 0 then 'agent' || (id % 9) end as agent, case when id % 3 = 0 then 'HIGH' else 'LOW' end as score from c),
r as (select id, goal, constraints, decisions, '' as links, agent, issued_at from a where parent_id is null
 union all select a.id, coalesce(a.goal, r.goal), coalesce(a.constraints, r.constraints), coalesce(a.decisions, r.decisions), r.links || case when r.links = '' then '' else '|' end || r.id || ' ' || coalesce(r.agent, 'unknown') || ' [prompt_hash:h' || r.id || '] ' || (r.id % 3) || ' files ' || (r.id % 6) || ' ' || a.score || ' ' || strftime(r.issued_at, '%Y-%m-%d'), a.agent, a.issued_at from a join r on a.parent_id = r.id)"""


@query("k05_whole_contracts", f"{_WHOLE} select id, goal, constraints, decisions, links from r")
def _(spark, d):
    c, key = view(spark, d, "contracts"), F.col("id")
    text = lambda lead, k: F.concat(F.lit(lead), (key if k is None else key % k).cast("string"))
    rows = c.select("id", "parent_id", F.when(key % 5 == 0, text("goal ", None)).alias("goal"), F.when(key % 7 == 0, text("not ", None)).alias("constraints"), F.when(F.col("parent_id").isNull(), "agree").alias("decisions"), F.when(key % 4 != 0, text("agent", 9)).alias("agent"), text("h", None).alias("prompt_hash"), F.concat((key % 3).cast("string"), F.lit(" files")).alias("scope_summary"), (key % 6).alias("findings_count"), F.when(key % 3 == 0, "HIGH").otherwise("LOW").alias("score"), "issued_at")
    link = lambda x: F.concat_ws(" ", x["contract_id"].cast("string"), x["agent"], x["task"], x["scope_summary"], x["findings_count"].cast("string"), x["score"], F.date_format(x["at"], "yyyy-MM-dd"))
    return contracts.whole(rows).select("id", "goal", "constraints", "decisions", F.array_join(F.transform("links", link), "|").alias("links"))


@query("k06_scope_summaries", f"with e as ({corpus.ENTRIES}), n as (select audit_id, field, count(*) as n from e group by 1, 2) select audit_id, string_agg(n || ' ' || field, ', ' order by case field when 'files' then 1 when 'features' then 2 when 'endpoints' then 3 when 'deps' then 4 when 'env' then 5 else 6 end) as summary from n group by 1")
def _(spark, d):
    return contracts.summarize_scope(_scope(spark, d))


# --- G, U: ledger and times -----------------------------------------------------------


@query("g01_clipped", f"select doc_id as entry_id, case when length(text) > {ledger.TASK_CHARS} then substr(text, 1, {ledger.TASK_CHARS}) || '...' else text end as task from documents")
def _(spark, d):
    return _read(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), ledger.clipped(F.col("text")).alias("task"))


_ASKED = "q as (select c_custkey as request_id, case c_custkey % 4 when 0 then '2024-01-15 00:00:00' when 1 then 'last week' when 2 then '' end as since, case when c_custkey % 5 = 0 then 'ghost' || c_custkey when c_custkey % 5 < 3 then 'AGENT' || (c_custkey % 40) else '' end as agent from customer)"


@query("g09_cutoffs", f"with {_L}, {_ASKED}, s as (select lower(agent) as a, max(happened) as last_seen from l group by 1) select request_id, strftime(case when since = 'last week' then null else greatest(try_cast(nullif(since, '') as timestamp), last_seen) end, '%Y-%m-%d %H:%M:%S.%f') as cutoff, case when coalesce(since, '') <> 'last week' and agent <> '' and last_seen is null then 'no prior work recorded by \"' || agent || '\" — showing everything' end as note, case when since = 'last week' then since end as invalid_since from q left join s on lower(q.agent) = s.a")
def _(spark, d):
    key = F.col("c_custkey")
    since = F.when(key % 4 == 0, "2024-01-15 00:00:00").when(key % 4 == 1, "last week").when(key % 4 == 2, "")
    agent = F.when(key % 5 == 0, F.concat(F.lit("ghost"), key.cast("string"))).when(key % 5 < 3, F.concat(F.lit("AGENT"), (key % 40).cast("string"))).otherwise("")
    rows = ledger.cutoffs(_read(spark, d, "customer").select(key.alias("request_id"), since.alias("since"), agent.alias("agent")), view(spark, d, "ledger"))
    return rows.select("request_id", _moment("cutoff").alias("cutoff"), "note", "invalid_since")


_LINE = "'. [' || other || '] ' || task || ' (' || score || ', ' || findings_count || ' findings, files: ' || file || ') — ' || strftime(happened, '%Y-%m-%d %H:%M:%S')"


@query("g11_deltas", f"with {_L}, s as (select lower(agent) as agent, max(happened) as last_seen from l group by 1), r as (select s.agent, s.last_seen, l.agent as other, task, score, findings_count, file, happened, entry_id, row_number() over (partition by s.agent order by happened, entry_id) as rank from s join l on l.happened > s.last_seen), b as (select agent, count(*) as n, string_agg(rank || {_LINE}, chr(10) order by rank) as body from r group by 1) select agent, coalesce(n, 0) as n, case when n is null then 'No work recorded ' else 'Work ' end || 'since ' || agent || ' last checked in (' || strftime(last_seen, '%Y-%m-%d %H:%M:%S') || ')' || case when n is null then '.' when n = 1 then ' — 1 new entry:' || chr(10) || body else ' — ' || n || ' new entries:' || chr(10) || body end as text from s left join b using (agent)")
def _(spark, d):
    return ledger.deltas(view(spark, d, "ledger"))


@query("u02_expired_times", "select event_id, case when event_id % 3 = 0 then true when event_id % 3 = 1 then ts < timestamp '2024-01-10' else false end as expired from events")
def _(spark, d):
    key = F.col("event_id") % 3
    text = F.when(key == 0, "soon").when(key == 1, F.col("ts").cast("string")).otherwise("2030-01-01T00:00:00")
    return _read(spark, d, "events").select("event_id", claims.is_expired(text, F.lit("2024-01-10").cast("timestamp")).alias("expired"))


@query("u03_after_cutoff", "select event_id, case when event_id % 4 = 0 then false else ts > timestamp '2024-01-10' - interval 36 hours end as recent from events")
def _(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "never").otherwise(F.col("ts").cast("string"))
    return _read(spark, d, "events").select("event_id", claims.is_after(text, F.lit("2024-01-10").cast("timestamp"), 36 * 3600).alias("recent"))


# --- Z: scope claims --------------------------------------------------------------------

_C = f"c as ({corpus.CLAIMS})"
_CLAIMS_AT = "1998-06-01 00:00:00"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "claims")
    return c.select("claim_id", "agent", "task", "status", "expires_at", *[_list(old).alias(new) for old, new in (("creates", "create"), ("modifies", "modify"), ("deletes", "delete"), ("deps", "dependencies"), ("env_vars", "env_vars"), ("routes", "api_routes"))])


@query("z01_validated", "select o_orderkey as claim_id, case o_orderkey % 5 when 0 then '' when 1 then 'scope.files.modify must be an array' when 2 then 'scope.dependencies must contain only strings' when 3 then 'scope must be an object' else 'scope.files must be an object' end as errors from orders")
def _(spark, d):
    key = F.col("o_orderkey") % 5
    text = F.when(key == 0, '{"files": {"create": ["a"]}, "env_vars": []}').when(key == 1, '{"files": {"create": ["a"], "modify": "x"}}').when(key == 2, '{"dependencies": [1, "b"]}').when(key == 3, "[]").otherwise('{"files": 3}')
    rows = claims.validate(_read(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), text.alias("scope")))
    return rows.select("claim_id", F.array_join("errors", "; ").alias("errors"))


@query("z02_purged", f"with {_C} select claim_id, status from c where status = 'completed' or expires_at >= timestamp '{_CLAIMS_AT}'")
def _(spark, d):
    return claims.purged(_claims(spark, d), F.lit(_CLAIMS_AT).cast("timestamp")).select("claim_id", "status")


@query("z03_claimed_files", f"with {_C} select claim_id, agent, unnest({_sql_list('creates')}) as file, 'create' as op from c where status in ('locked', 'proposed') union all select claim_id, agent, unnest({_sql_list('modifies')}), 'modify' from c where status in ('locked', 'proposed') union all select claim_id, agent, unnest({_sql_list('deletes')}), 'delete' from c where status in ('locked', 'proposed')")
def _(spark, d):
    return claims.claimed_files(_claims(spark, d))


@query("z06_active_scopes", f"with {_C} select claim_id, agent, status from c where status in ('locked', 'proposed') and expires_at >= timestamp '{_CLAIMS_AT}'")
def _(spark, d):
    return claims.active_scopes(_claims(spark, d), F.lit(_CLAIMS_AT).cast("timestamp")).select("claim_id", "agent", "status")


@query("z07_completed", f"with {_C} select claim_id, agent, task, array_to_string(list_concat(list_concat({_sql_list('creates')}, {_sql_list('modifies')}), {_sql_list('deletes')}), ',') as files, 0::bigint as findings_count, 'LOW' as score from c where claim_id % 3 = 1")
def _(spark, d):
    own = _claims(spark, d)
    return claims.completed(own, own.where("claim_id % 3 = 1"), F.lit(_CLAIMS_AT)).select("claim_id", "agent", "task", F.array_join("files_touched", ",").alias("files"), "findings_count", "score")


@query("z08_scopes_of_claims", f"with {_C} select claim_id, array_to_string(list_concat(list_concat({_sql_list('creates')}, {_sql_list('modifies')}), {_sql_list('deletes')}), ',') as files, routes as endpoints, deps, env_vars as env, '' as features from c")
def _(spark, d):
    return scope.of_claims(_claims(spark, d)).select("claim_id", *[F.array_join(f, ",").alias(f) for f in ("files", "endpoints", "deps", "env", "features")])


_STATE = "struct(id bigint, agent varchar, files varchar[], dep varchar, until timestamp)[]"
_Z_FOLD = f"""with recursive e as ({corpus.CLAIM_EVENTS}),
v as (select op_id, root, agent, happened, case when op = 'release' then 'complete' when op = 'extend' and op_id % 2 = 0 then 'renew' else 'claim' end as op, [file, 'src/x' || (op_id % 9)] as files, 'd' || (op_id % 4) as dep, case when op_id % 11 = 0 then op_id - 1 else -1 end as parent from e),
n as (select *, row_number() over (partition by root order by happened, op_id) as k from v),
h as (select 0 as k, root, [] :: {_STATE} as st, null::bigint as op_id, null::varchar as status, null::varchar as conflicts, null::varchar as reason from (select distinct root from n)
 union all select k, root, case when op = 'renew' then list_transform(st, lambda c: case when c.agent = own then {{'id': c.id, 'agent': c.agent, 'files': c.files, 'dep': c.dep, 'until': now + interval 2 hours}} else c end)
   when op = 'complete' then list_filter(live, lambda c: c.agent <> own) when status = 'locked' then list_append(live, {{'id': op_id, 'agent': own, 'files': files, 'dep': dep, 'until': now + interval 2 hours}}) else live end, op_id, status, conflicts, reason from (
  select *, case when op = 'renew' then case when len(list_filter(st, lambda c: c.agent = own)) > 0 then 'renewed' else 'none' end when op = 'complete' then case when len(list_filter(live, lambda c: c.agent = own)) > 0 then 'completed' else 'none' end when taken <> '' or beyond or deeper then 'rejected' else 'locked' end as status,
   case when op = 'claim' then taken else '' end as conflicts, case when op <> 'claim' then '' when taken <> '' then 'conflict' when beyond then 'files beyond parent' when deeper then 'deps beyond parent' else '' end as reason from (
   select *, array_to_string(list_transform(list_filter(files, lambda f: len(list_filter(others, lambda c: list_contains(c.files, f))) > 0), lambda f: f || ':' || list_filter(others, lambda c: list_contains(c.files, f))[1].agent), ',') as taken,
    par is not null and len(list_filter(files, lambda f: not list_contains(par.files, f))) > 0 as beyond, par is not null and dep <> par.dep as deeper from (
    select *, list_filter(live, lambda c: c.agent <> own and (par is null or c.agent <> par.agent)) as others from (
     select *, list_filter(live, lambda c: c.id = parent)[1] as par from (
      select n.k, h.root, h.st, n.op_id, n.op, n.agent as own, n.happened as now, n.files, n.dep, n.parent, list_filter(h.st, lambda c: c.until >= n.happened) as live from h join n on n.root = h.root and n.k = h.k + 1))))))"""


@query("z04_scope_claims", f"{_Z_FOLD} select op_id, h.root, n.agent, status, conflicts, reason from h join n using (op_id) where h.k > 0")
def _(spark, d):
    return claims.fold_scope_claims(_scope_events(spark, d))


# --- R: conflicts -------------------------------------------------------------------------


@query("r01_conflict_records", f"{_Z_FOLD}, r as (select op_id, h.root, n.agent, conflicts, string_split(conflicts, ',') as p from h join n using (op_id) where h.k > 0 and conflicts <> '') select substr(sha256(root || '|' || op_id || '|' || conflicts), 1, 32) as conflict_id, op_id, agent, array_to_string(list_transform(p, lambda x: split_part(x, ':', 1)), ',') as files, agent || ',' || split_part(p[1], ':', 2) || case when len(p) > 1 and split_part(p[2], ':', 2) <> split_part(p[1], ':', 2) then ',' || split_part(p[2], ':', 2) else '' end as agents, 'open' as status from r")
def _(spark, d):
    rows = claims.conflict_records(claims.fold_scope_claims(_scope_events(spark, d)))
    return rows.select("conflict_id", "op_id", "agent", F.array_join("files", ",").alias("files"), F.array_join("agents", ",").alias("agents"), "status")


_RECORDS = f"r as ({corpus.CONFLICTS})"
_REQUESTS = "q as (select o_orderkey as request_id, 'c' || (o_custkey * 3 % 2000) as conflict_id, case when o_orderkey % 2 = 0 then 'block' else 'escalate' end as strategy, 'lead' || (o_custkey % 3) as resolved_by, o_orderdate as moment from orders)"
_RESOLVED = f"{_RECORDS}, {_REQUESTS}, j as (select q.*, r.files, r.agents, r.status, r.strategy as by_strategy, r.resolved_by as by_whom, r.conflict_id is not null as known, row_number() over w as k, first_value(q.strategy) over w as first_strategy, first_value(q.resolved_by) over w as first_by from q left join r using (conflict_id) window w as (partition by q.conflict_id order by moment, request_id)), o as (select *, case when not known then 'not_found' when status = 'resolved' or k > 1 then 'already_resolved' else 'resolved' end as outcome from j)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "conflicts").withColumn("files", _list("files")).withColumn("agents", _list("agents"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("c"), (F.col("o_custkey") * 3 % 2000).cast("string")).alias("conflict_id"), F.when(F.col("o_orderkey") % 2 == 0, "block").otherwise("escalate").alias("strategy"), F.concat(F.lit("lead"), (F.col("o_custkey") % 3).cast("string")).alias("resolved_by"), F.col("o_orderdate").alias("at"))
    return claims.resolve(asked, _records(spark, d))


@query("r02_resolved", f"with {_RESOLVED} select request_id, conflict_id, outcome, case outcome when 'not_found' then 'No conflict with ID ' || conflict_id when 'already_resolved' then 'Conflict already resolved via ' || case when status = 'resolved' then by_strategy else first_strategy end || ' by ' || case when status = 'resolved' then by_whom else first_by end else case when strategy = 'escalate' then printf({_lit(X.ESCALATE_DETAIL)}, replace(files, ',', ', '), replace(agents, ',', ', ')) else printf({_lit(X.BLOCK_DETAIL)}, replace(files, ',', ', '), replace(agents, ',', ', ')) end end as detail from o")
def _(spark, d):
    return _resolved(spark, d)


@query("r03_open_conflicts", f"with {_RESOLVED} select conflict_id, files, agents from r where status = 'open' and conflict_id not in (select conflict_id from o where outcome = 'resolved')")
def _(spark, d):
    return claims.open_conflicts(_records(spark, d), _resolved(spark, d)).select("conflict_id", F.array_join("files", ",").alias("files"), F.array_join("agents", ",").alias("agents"))


# --- I, V, Q: check-ins, collisions, gate ---------------------------------------------------

_SCOPES = f"{_C}, sf as (select claim_id, agent, task, unnest({_sql_list('creates')}) as file, 'create' as op, 1 as rank from c where status in ('locked', 'proposed') and expires_at >= timestamp '2001-07-01' union all select claim_id, agent, task, unnest({_sql_list('modifies')}), 'modify', 2 from c where status in ('locked', 'proposed') and expires_at >= timestamp '2001-07-01' union all select claim_id, agent, task, unnest({_sql_list('deletes')}), 'delete', 3 from c where status in ('locked', 'proposed') and expires_at >= timestamp '2001-07-01')"


def _scope_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the scope claims that are active, with their tasks."""
    own = claims.active_scopes(_claims(spark, d), F.lit("2001-07-01").cast("timestamp"))
    return claims.claimed_files(own).join(own.select("claim_id", "task"), "claim_id")


def _file_claims(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d).withColumn("task", F.concat(F.lit("on "), "root"))


_HELD_SCOPES = _HELD + f", {_SCOPES}"


@query("i02_active_claims", f"{_HELD_SCOPES}, u as (select distinct agent, file from held union select agent, file from sf) select agent, string_agg(file, ',' order by file) as files from u group by 1")
def _(spark, d):
    return coordination.active_claims(_held(spark, d), _scope_files(spark, d)).select("agent", F.array_join("files", ",").alias("files"))


@query("i03_renewed", f"{_HELD} select 'agent' || s_suppkey as agent, root, file, strftime(timestamp '{_AS_OF}' + to_minutes((s_suppkey % 200)::int) + interval 2 hours, '%Y-%m-%d %H:%M:%S') as expires_at from supplier join held on held.agent = 'agent' || s_suppkey where expires_at >= timestamp '{_AS_OF}' + to_minutes((s_suppkey % 200)::int)")
def _(spark, d):
    s = _read(spark, d, "supplier")
    checked = s.select(F.concat(F.lit("agent"), F.col("s_suppkey").cast("string")).alias("agent"), F.timestamp_add("MINUTE", (F.col("s_suppkey") % 200).cast("int"), F.lit(_AS_OF).cast("timestamp")).alias("at"))
    own = _held(spark, d).withColumn("file", F.concat("root", F.lit(" "), "file"))
    rows = coordination.renewed(checked, own)
    return rows.select("agent", F.split_part("file", F.lit(" "), F.lit(1)).alias("root"), F.split_part("file", F.lit(" "), F.lit(2)).alias("file"), F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query("i05_my_conflicts", f"with {_RECORDS} select conflict_id from r where status = 'open' and (lower(split_part(agents, ',', 1)) = 'agent3' or lower(split_part(agents, ',', 2)) = 'agent3')")
def _(spark, d):
    return coordination.involving(_records(spark, d).where("status = 'open'").withColumn("holders", F.col("agents")).withColumn("agent", F.col("agents")[0]), "AGENT3").select("conflict_id")


@query("i06_check_in_reports", f"""{_HELD}, a as (select distinct agent from e), mine as (select agent, count(*) as n, string_agg(root || '/' || file, ', ' order by root || '/' || file) as names from held group by 1),
entry as (select agent, string_agg('    ' || root || '/' || file || ' — on ' || root, chr(10) order by root || '/' || file) as own from held group by 1), act as (select string_agg('  ' || agent || ':' || chr(10) || own, chr(10) order by agent) as active from entry),
{_RECORDS}, inv as (select conflict_id, files, agents, lower(split_part(agents, ',', 1)) as who from r where status = 'open' union select conflict_id, files, agents, lower(split_part(agents, ',', 2)) from r where status = 'open'), about as (select who, count(*) as n, string_agg('  ' || conflict_id || ' — files [' || replace(files, ',', ', ') || '] between [' || replace(agents, ',', ', ') || '] (open)', chr(10) order by conflict_id) as about from inv group by 1)
select a.agent, 'Checked in as ' || a.agent || ' at {_AS_OF}.' || chr(10) || case when ltrim(a.agent, 'agent')::int % 2 = 0 then '(first check-in — your claims renewed and prior work shown below.)' || chr(10) else '' end || case when mine.n is null then 'Your claims renewed: none (you have no active claims).' else 'Your claims renewed: ' || mine.n || case when mine.n = 1 then ' file claim (' else ' file claims (' end || names || ').' end || chr(10) || chr(10) || 'Active across all agents:' || chr(10) || active || chr(10) || chr(10) || 'delta of ' || a.agent || chr(10) || chr(10) || case when about.n is null then 'Conflicts involving you: none.' else 'Conflicts involving you (' || about.n || case when about.n = 1 then ' conflict):' else ' conflicts):' end || chr(10) || about end as text
from a cross join act left join mine using (agent) left join about on about.who = lower(a.agent)""")
def _(spark, d):
    as_of = F.lit(_AS_OF).cast("timestamp")
    agents = view(spark, d, "claim_events").select("agent").distinct()
    number = F.substring("agent", 6, 9).cast("int")
    checked = agents.select("agent", as_of.alias("at"), F.when(number % 2 == 1, as_of).alias("previous"))
    own = _file_claims(spark, d).withColumn("file", F.concat("root", F.lit("/"), "file"))
    entries = coordination.claim_entries(own, _scope_files(spark, d).limit(0))
    text = agents.select("agent", F.concat(F.lit("delta of "), "agent").alias("text"))
    return coordination.check_in_text(checked, coordination.renewed(checked, own), entries, text, _records(spark, d).where("status = 'open'"))


_ASKED_FILES = "q as (select distinct 'agent' || (event_id % 12) as agent, 'src/m' || (event_id % 23) || '.ts' as file from events)"


def _asked_files(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    return _read(spark, d, "events").select(F.concat(F.lit("agent"), (key % 12).cast("string")).alias("agent"), F.concat(F.lit("src/m"), (key % 23).cast("string"), F.lit(".ts")).alias("file")).distinct()


_INTENTS = f"{_HELD_SCOPES}, {_ASKED_FILES}, best as (select agent, file, min(rank) as rank from (select agent, file, rank from sf union all select agent, file, 4 from held) group by 1, 2), it as (select q.agent, q.file, case when rank is null then 'none' when rank = 4 then 'file' else 'scope' end as source, case rank when 1 then 'create' when 2 then 'modify' when 3 then 'delete' end as op from q left join best using (agent, file))"


@query("v01_intents", f"{_INTENTS} select agent, file, source, op from it")
def _(spark, d):
    return coordination.intents(_asked_files(spark, d), _scope_files(spark, d), _held(spark, d))


@query("v03_collisions", f"{_INTENTS} select file, count(*) filter (source <> 'none') as contesting, split_part(split_part(file, 'm', 2), '.', 1)::bigint % 7 as n_symbols, count(*) filter (source <> 'none') >= 2 and split_part(split_part(file, 'm', 2), '.', 1)::int % 7 >= 4 as split from it group by 1")
def _(spark, d):
    asked = _asked_files(spark, d)
    n = F.regexp_extract("file", r"m(\d+)\.", 1).cast("int") % 7
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("():")))).otherwise(F.array().cast("array<string>"))
    texts = asked.select("file").distinct().select("file", F.array_join(F.concat(F.array(F.lit("import os")), lines), "\n").alias("text"))
    found = coordination.intents(asked, _scope_files(spark, d), _held(spark, d))
    return coordination.collisions(found, diff.symbols_of_files(texts)).select("file", "contesting", "n_symbols", "split")


@query("q01_holders", f"{_HELD_SCOPES} select distinct file, agent, 'file' as kind, 'claim' as op from held union select file, agent, 'scope', op from sf")
def _(spark, d):
    return coordination.holders(_held(spark, d), _scope_files(spark, d)).distinct()


@query("q03_gate_reports", f"""{_HELD_SCOPES}, {_RECORDS}, {_L}, ch as (select distinct entry_id % 500 as audit_id, file from l union select distinct entry_id % 500, 'lib/' || (entry_id % 7) || '.ts' from l), hd as (select distinct file, agent, 'file' as kind, 'claim' as op from held union select file, agent, 'scope', op from sf),
oc as (select file, min(conflict_id) as conflict_id, arg_min(agents, conflict_id) as agents from (select conflict_id, agents, unnest(string_split(files, ',')) as file from r where status = 'open') group by 1), hl as (select file, count(*) as n, string_agg('  ' || file || ' [' || op || '] — ' || agent || ' (' || kind || ')', chr(10) order by agent, kind, op) as t from hd group by 1),
g as (select audit_id, count(*) as n, count(conflict_id) as nb, string_agg('  ' || file || ' — conflict ' || conflict_id || ' between [' || replace(agents, ',', ', ') || ']', chr(10) order by file) filter (conflict_id is not null) as tb, count(*) filter (hl.n is null) as nu, string_agg('  ' || file, chr(10) order by file) filter (hl.n is null) as tu, sum(hl.n) as nh, string_agg(hl.t, chr(10) order by file) filter (hl.n is not null) as th from ch left join oc using (file) left join hl using (file) group by 1)
select audit_id, nb > 0 as blocked, 'Coordination check — ' || n || ' file(s) in the diff.' || case when nb > 0 then chr(10) || chr(10) || 'Blocked — ' || nb || ' file(s) with an open (unresolved) conflict:' || chr(10) || tb || chr(10) || '  Resolve the conflict (resolve_claim) before merging.' else '' end || case when nu > 0 then chr(10) || chr(10) || 'Unclaimed — advisory (no active claim): ' || nu || ' file(s):' || chr(10) || tu else '' end || case when nh > 0 then chr(10) || chr(10) || 'Actively claimed: ' || nh || ' file(s):' || chr(10) || th else '' end || chr(10) || chr(10) || case when nb > 0 then 'RESULT: BLOCKED' else 'RESULT: PASS' end as text from g""")
def _(spark, d):
    entries = view(spark, d, "ledger")
    key = F.col("entry_id")
    changed = entries.select((key % 500).alias("audit_id"), "file").union(entries.select(key % 500, F.concat(F.lit("lib/"), (key % 7).cast("string"), F.lit(".ts")))).distinct()
    return coordination.gate_report(changed, _records(spark, d), coordination.holders(_held(spark, d), _scope_files(spark, d)).distinct())


# --- T, W, M: telemetry and test runs ---------------------------------------------------------


@query("t02_sanitised", "select event_id, case when event_id % 3 = 0 then 'unknown' else 'model-' || user_id end as model, case when event_id % 5 < 2 then 0 else value end::double as n from events")
def _(spark, d):
    key = F.col("event_id")
    model = F.when(key % 3 == 0, F.concat(F.lit("bad name "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("model-"), F.col("user_id").cast("string")))
    n = F.when(key % 5 == 0, F.lit(float("nan"))).when(key % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return _read(spark, d, "events").select("event_id", telemetry.model_name(model).alias("model"), telemetry.finite(n).cast("double").alias("n"))


@query("t03_change_rate", "select round(avg(case when event_id % 4 = 0 then 1.0 else 0.0 end), 6) as rate from events where event_id % 3 <> 0")
def _(spark, d):
    runs = _read(spark, d, "events").select((F.col("event_id") % 3 != 0).alias("reconcile_ran"), (F.col("event_id") % 4 == 0).alias("reconcile_changed"))
    return telemetry.change_rate(runs).select(F.round("rate", 6).alias("rate"))


@query("w01_valid_payloads", "select event_type as os, 'x64' as arch, 'v20' as node_version, (event_id % 4)::int as vendors, '1.' || (event_id % 3) as version, ts::varchar as client_ts from events where event_id % 5 > 2")
def _(spark, d):
    key = F.col("event_id")
    good = F.to_json(F.struct(F.lit("init").alias("event"), F.col("event_type").alias("os"), F.lit("x64").alias("arch"), F.lit("v20").alias("node"), (key % 4).alias("vendors"), F.concat(F.lit("1."), (key % 3).cast("string")).alias("v"), F.col("ts").cast("string").alias("ts")))
    body = F.when(key % 5 == 0, "{broken").when(key % 5 == 1, F.regexp_replace(good, '"init"', '"other"')).when(key % 5 == 2, F.regexp_replace(good, '"arch":"x64"', '"arch":7')).otherwise(good)
    return telemetry.valid_payloads(_read(spark, d, "events").select(body.alias("body")))


_RUNS = "u as (select event_id, 'm' || (user_id % 7) as model, 's' || (event_id % 90) as suite, case event_id % 4 when 0 then 'x' || chr(10) || (event_id % 26) || '/26 passed, 0 failed' when 1 then 'FAIL suite — case ' || event_id || chr(10) || (event_id % 17) || ' passed, 3 failed' when 2 then 'SKIP: no key' else '20/20 assertions passed' end as output from events)"
_PARSED = f"{_RUNS}, t as (select *, nullif(regexp_extract(output, {_lit(X.RUN_OVER)}, 1), '')::int as a, nullif(regexp_extract(output, {_lit(X.RUN_OVER)}, 2), '')::int as b, nullif(regexp_extract(output, {_lit(X.RUN_COUNTS)}, 1), '')::int as p, nullif(regexp_extract(output, {_lit(X.RUN_COUNTS)}, 2), '')::int as f from u), s as (select event_id, model, suite, coalesce(a, p) as passed, coalesce(b, p + f) as total, event_id % 4 = 2 as skipped, case when event_id % 4 = 1 then 'case ' || event_id else '' end as fails, coalesce(coalesce(a, p) / coalesce(b, p + f) >= 0.8, false) as good from t)"


def _suites(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    text = lambda k: (key % k).cast("string")
    out = F.when(key % 4 == 0, F.concat(F.lit("x\n"), text(26), F.lit("/26 passed, 0 failed"))).when(key % 4 == 1, F.concat(F.lit("FAIL suite — case "), key.cast("string"), F.lit("\n"), text(17), F.lit(" passed, 3 failed"))).when(key % 4 == 2, "SKIP: no key").otherwise("20/20 assertions passed")
    return telemetry.suite_results(_read(spark, d, "events").select(F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"), F.concat(F.lit("s"), text(90)).alias("suite"), out.alias("output")))


@query("m01_suite_results", f"with {_PARSED} select model, suite, passed, total, skipped, fails, good from s")
def _(spark, d):
    return _suites(spark, d).select("model", "suite", "passed", "total", "skipped", F.array_join("fails", "|").alias("fails"), "good")


@query("m01_pass_matrix", f"with {_PARSED} select model, count(*) as suites, coalesce(sum(passed), 0)::bigint as passed, coalesce(sum(total), 0)::bigint as total, bool_and(good) as all_good from s where not skipped group by 1")
def _(spark, d):
    return telemetry.pass_matrix(_suites(spark, d))
