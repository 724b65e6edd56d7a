"""Registered queries for the operators on changes, scopes, contracts, ledgers, claims and telemetry, each with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import claims, compare, contracts, coordination, diff, impact, ledger, scope, telemetry
from ..sources import stores
from . import corpus
from .corpus import view

AS_OF = "2024-01-30 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL building blocks ----------------------------------------------------


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "(" + ", ".join(map(_lit, values)) + ")"


def _rx(col: str, p: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {_lit(p)}, {g}), '')"


def _first(col: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(_rx(col, p) for p in patterns) + ")"


def _is(col: str, p: str) -> str:
    return f"regexp_matches({col}, {_lit(p)})"


def _norm(a: str) -> str:
    return f"regexp_replace(lower({a}), '[^a-z0-9]', '', 'g')"


def _shares(a: str, b: str, k: str) -> str:
    return f"len(list_filter(range(1, length({a}) - ({k}) + 2), lambda i: contains({b}, substr({a}, i, {k})))) > 0"


def _fuzzy(a: str, b: str) -> str:
    """On normal forms."""
    return f"({a} <> '' and {b} <> '' and (contains({a}, {b}) or contains({b}, {a}) or {_shares(a, b, f'greatest(5, ceil(least(length({a}), length({b})) * 0.6)::int)')}))"


def _ep(s: str) -> str:
    s = f"regexp_replace(lower({s}), '^\\s*(?:get|post|put|delete|patch)\\s+', '')"
    s = f"regexp_replace({s}, '\\{{[^}}]+\\}}|\\[[^\\]]+\\]|:[A-Za-z_][\\w]*', '<param>', 'g')"
    return f"regexp_replace(regexp_replace({s}, '\\?.*$', ''), '/+$', '')"


def _typo(t: str, s: str) -> str:
    short = f"least(length({t}), length({s}))"
    return f"({t} <> '' and {s} <> '' and ({t} = {s} or ({t} not in {_list(X.COMMON_WORDS)} and {short} >= 4 and abs(length({t}) - length({s})) <= 2 and case when {short} >= 7 then {_osa_two(t, s)} else damerau_levenshtein({t}, {s}) <= 1 end)))"


def _osa_two(a: str, b: str) -> str:
    """Whether optimal string alignment is 2 at most.

    The unrestricted distance may also edit between two swapped characters,
    which needs lengths that differ by one; there, a swap and a deletion count
    only if the deleted character does not stand between the swapped ones.
    """
    long, short = (f"case when length({a}) >= length({b}) then {x} else {y} end" for x, y in ((a, b), (b, a)))
    # i: the deleted place; the swapped ones are j and j + 1 of what is left
    less = "substr(l, 1, i - 1) || substr(l, i + 1)"
    swapped = f"substr({less}, 1, j - 1) || substr({less}, j + 1, 1) || substr({less}, j, 1) || substr({less}, j + 2)"
    found = f"len(list_filter(range(1, length(l) + 1), lambda i: len(list_filter(range(1, length(l) - 1), lambda j: i - 1 <> j and ({swapped}) = r)) > 0)) > 0".replace("(l,", f"(({long}),").replace("(l)", f"(({long}))").replace("= r", f"= ({short})")
    return f"(levenshtein({a}, {b}) <= 2 or (damerau_levenshtein({a}, {b}) <= 2 and (length({a}) = length({b}) or (abs(length({a}) - length({b})) = 1 and {found}))))"


_SCAN = f"""lines as ({corpus.LINES}),
k1 as (select *, {_is('raw', X.NEW_MODE)} as mode, {_is('raw', X.MINUS)} as minus, {_rx('raw', X.MINUS)} as target from lines),
k2 as (select *, mode or (minus and target = '/dev/null') as marker, case when not mode and not minus then {_rx('raw', X.PLUS)} end as header from k1),
k3 as (select *, not mode and not minus and header is null as plain, coalesce(last_value(header ignore nulls) over w, '') as file,
  coalesce(max(case when marker then line_no end) over b > coalesce(max(case when not (mode or minus) then line_no end) over b, -1), false) as fresh from k2
  window w as (partition by audit_id order by line_no rows between unbounded preceding and current row), b as (partition by audit_id order by line_no rows between unbounded preceding and 1 preceding)),
k4 as (select *, max((header is not null and fresh)::int) over (partition by audit_id, file) = 1 as is_new, case when plain and starts_with(raw, '+') and not starts_with(raw, '+++') then '+' when plain and starts_with(raw, '-') and not starts_with(raw, '---') then '-' end as side from k3),
scan as (select audit_id, line_no, raw, header, file, is_new, side, case when side is not null then substr(raw, 2) end as code from k4)"""

_SHAPE = f"case when {_is('code', X.SHAPE)} then regexp_replace(code, {_lit(X.SHAPE)}, '\\1{{SYM}}') end"
_LIVE = f"not {_is('code', X.COMMENT)}"
_ROUTE = lambda p: f"case when starts_with({_rx('code', p)}, '/') or contains(lower({_rx('code', p)}), 'api') then {_rx('code', p)} end"
_GO = _first("code", X.GO_IMPORT)
_PORT = f"nullif(regexp_extract(trim(regexp_extract(code, {_lit(X.LISTEN)}, 2)), '(\\d{{2,5}})', 1), '')"
_PKG, _CARGO = _rx("code", X.PACKAGE_DEP), _rx("code", X.CARGO_DEP)
_EXTRACT = [
    ("file", "nullif(file, '')"),
    ("endpoint", f"case when is_new then '/' || regexp_replace({_rx('file', X.ROUTE_FILE)}, '/+$', '') end"),
    ("import", f"nullif(split_part({_first('code', X.PY_IMPORT)}, '.', 1), '')"),
    ("import", _first("code", X.TS_IMPORT)),
    ("import", f"case when contains({_GO}, '.') then {_GO} end"),
    ("env", f"coalesce(case when {_LIVE} then {_first('code', X.ENV)} end, case when file <> '' and {_is('file', X.DOTENV_FILE)} then {_rx('code', X.DOTENV)} end)"),
    ("endpoint", f"case when {_LIVE} then coalesce({_rx('code', X.EP_DECORATOR)}, {_ROUTE(X.EP_VERB)}, {_ROUTE(X.EP_MOUNT)}, case when starts_with({_rx('code', X.EP_FETCH)}, '/') then {_rx('code', X.EP_FETCH)} end) end"),
    ("cron", f"case when {_LIVE} and {_is('code', X.CRON)} then substr(trim(code), 1, 40) end"),
    (
        "listener",
        f"case when not ({_LIVE}) then null when {_is('code', X.LISTEN)} then case when {_PORT} is not null then 'listen(:' || {_PORT} || ')' when regexp_extract(code, {_lit(X.LISTEN)}, 1) in {_list(X.LISTEN_RECEIVERS)} then 'listen()' end "
        f"when {_is('code', X.SERVER)} then 'server()' when {_rx('code', X.PROCESS_ON)} is not null then 'process.on(''' || {_rx('code', X.PROCESS_ON)} || ''')' when {_rx('code', X.GLOBAL_ON)} is not null then 'addEventListener(''' || {_rx('code', X.GLOBAL_ON)} || ''')' end",
    ),
    ("symbol", f"case when not renamed and {_first('code', X.SYMBOL)} not in {_list(X.HTTP_VERBS)} then {_first('code', X.SYMBOL)} end"),
    ("symbol", f"case when file <> '' then coalesce({_rx('code', X.TERRAFORM)}, {_rx('code', X.DDL)}, case when {_is('file', X.YAML)} then coalesce(case when {_rx('code', X.K8S)} in {_list(X.K8S_KINDS)} then 'k8s:' || {_rx('code', X.K8S)} end, {_rx('code', X.CLOUDFORMATION)}) end) end"),
    (
        "dep",
        f"case when file = '' then null when {_is('file', X.PACKAGE_FILE)} then coalesce(case when {_PKG} not in {_list(X.PACKAGE_KEYS)} then {_PKG} end, {_rx('code', X.PACKAGE_ALIAS)}) when {_is('file', X.PYTHON_FILE)} then {_rx('code', X.PYTHON_DEP)} "
        f"when {_is('file', X.GEM_FILE)} then {_rx('code', X.GEM_DEP)} when {_is('file', X.CARGO_FILE)} then case when {_CARGO} not in {_list(X.CARGO_KEYS)} then {_CARGO} end when {_is('file', X.GOMOD_FILE)} then {_rx('code', X.GOMOD_DEP)} end",
    ),
]
_SURFACE = f"""{_SCAN},
gone as (select distinct audit_id, {_SHAPE} as shape from scan where side = '-'),
added as (select s.*, g.shape is not null as renamed from (select *, {_SHAPE} as shape from scan where side = '+') s left join gone g on g.audit_id = s.audit_id and g.shape = s.shape),
each as ({' union all '.join(f"select audit_id, line_no * 16 + {n} as pos, '{kind}' as kind, {sql} as item from added" for n, (kind, sql) in enumerate(_EXTRACT))}),
surface as (select audit_id, kind, item, min(pos) as first from each where item is not null group by 1, 2, 3)"""


def _moment(at):
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return diff.scan(view(spark, d, "lines"))


def _surface(spark: SparkSession, d: str) -> DataFrame:
    return diff.surface(_scan(spark, d))


def _actual(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "lines")
    return diff.actual(diff.surface(diff.scan(lines)), lines.select("audit_id").distinct())


def _scope(spark: SparkSession, d: str) -> DataFrame:
    return compare.scope_rows(view(spark, d, "entries"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return compare.findings(_actual(spark, d), _scope(spark, d))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda s: s["raw"]), "\n")
    return view(spark, d, "lines").groupBy("audit_id").agg(joined.alias("diff"))


# --- P: diff scan -----------------------------------------------------------


@query("p01_split_lines", f"with lines as ({corpus.LINES}) select audit_id, row_number() over (partition by audit_id order by line_no) - 1 as line_no, raw from lines")
def _(spark, d):
    return diff.split_lines(_changes(spark, d))


@query("p02_current_file", f"with {_SCAN} select audit_id, line_no, file, is_new from scan")
def _(spark, d):
    return _scan(spark, d).select("audit_id", "line_no", "file", "is_new")


@query("p04_added_lines", f"with {_SCAN} select audit_id, line_no, file, code from scan where side = '+'")
def _(spark, d):
    return diff.added_lines(_scan(spark, d)).select("audit_id", "line_no", "file", "code")


@query("p05_deleted_lines", f"with {_SCAN} select audit_id, line_no, code from scan where side = '-'")
def _(spark, d):
    return _scan(spark, d).where("side = '-'").select("audit_id", "line_no", "code")


@query("p07_changed_files", f"with {_SCAN} select distinct audit_id, header as file from scan where header is not null")
def _(spark, d):
    return diff.changed_files(_scan(spark, d))


_STATS = f"""{_SCAN},
heads as (select audit_id, header as file, min(line_no) as ord from scan where header is not null group by 1, 2),
stats as (select s.audit_id, s.file, count(*) as lines_added, string_agg(code, chr(10) order by line_no) || chr(10) as added_code, bool_or(is_new) as is_new, min(h.ord) as ord from scan s join heads h on h.audit_id = s.audit_id and h.file = s.file where side = '+' group by 1, 2)"""


@query("p08_file_stats", f"with {_STATS} select audit_id, file, lines_added, added_code, is_new from stats")
def _(spark, d):
    return diff.file_stats(_scan(spark, d)).select("audit_id", "file", "lines_added", "added_code", "is_new")


@query("p10_renames", f"with {_SCAN}, a as (select *, {_SHAPE} as shape from scan where side = '+'), b as (select distinct audit_id, {_SHAPE} as shape from scan where side = '-') select audit_id, line_no from a join b using (audit_id, shape)")
def _(spark, d):
    return diff.renames(_scan(spark, d))


@query("p11_size_metrics", f"with lines as ({corpus.LINES}) select audit_id, (sum(length(raw)) + count(*) - 1)::bigint as diff_chars, count(*) as diff_lines from lines group by 1")
def _(spark, d):
    return diff.size_metrics(_changes(spark, d))


# --- X: the surface, as a whole and by kind ---------------------------------


@query("x13_surface", f"with {_SURFACE} select audit_id, kind, item, first from surface")
def _(spark, d):
    return _surface(spark, d)


for _name, _kind in {"p06_files": "file", "x01_imports": "import", "x04_env": "env", "x06_endpoints": "endpoint", "x08_cron": "cron", "x09_listeners": "listener", "x10_symbols": "symbol", "x12_dependencies": "dep"}.items():
    query(_name, f"with {_SURFACE} select audit_id, string_agg(item, '|' order by first) as items from surface where kind = '{_kind}' group by 1")(lambda spark, d, k=_kind: _actual(spark, d).where(F.size(k) > 0).select("audit_id", F.array_join(k, "|").alias("items")))

# --- N: predicates on pairs of an item and an entry --------------------------

_ENTRIES = f"entries as ({corpus.ENTRIES})"
_PAIRS = f"{_SURFACE}, {_ENTRIES}, pairs as (select distinct s.audit_id, s.kind, s.item, e.entry from surface s join entries e using (audit_id))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _surface(spark, d).select("audit_id", "kind", "item").join(view(spark, d, "entries").select("audit_id", "entry"), "audit_id").distinct()


@query("n01_norm", f"with {_PAIRS} select distinct item, {_norm('item')} as n from pairs")
def _(spark, d):
    return _pairs(spark, d).select("item", T.norm(F.col("item")).alias("n")).distinct()


@query("n02_shared_substring", f"with {_PAIRS} select distinct item, entry from (select item, entry, {_norm('item')} as a, {_norm('entry')} as b from pairs) where {_shares('a', 'b', '5')}")
def _(spark, d):
    return _pairs(spark, d).where(T.shares(T.norm(F.col("item")), T.norm(F.col("entry")), F.lit(5))).select("item", "entry").distinct()


@query("n03_fuzzy", f"with {_PAIRS} select distinct item, entry from (select item, entry, {_norm('item')} as a, {_norm('entry')} as b from pairs) where {_fuzzy('a', 'b')}")
def _(spark, d):
    return _pairs(spark, d).where(T.fuzzy(F.col("item"), F.col("entry"))).select("item", "entry").distinct()


@query("n04_alignment", f"with {_PAIRS} select item, entry, case when a = b then 0 when damerau_levenshtein(a, b) <= 1 then 1 when {_osa_two('a', 'b')} then 2 else 3 end as distance from (select distinct item, entry, {_norm('item')} as a, {_norm('entry')} as b from pairs)")
def _(spark, d):
    """Distances as far as 2; 3 stands for all beyond."""
    near = _pairs(spark, d).select("item", "entry").distinct().withColumn("a", T.norm(F.col("item"))).withColumn("b", T.norm(F.col("entry")))
    return near.select("item", "entry", F.least(T.osa(F.col("a"), F.col("b")), F.lit(3)).alias("distance"))


@query("n06_typo", f"with {_PAIRS} select distinct item, entry from (select item, entry, {_norm('item')} as a, {_norm('entry')} as b from pairs) where {_typo('b', 'a')}")
def _(spark, d):
    return _pairs(spark, d).where(T.typo(F.col("entry"), F.col("item"))).select("item", "entry").distinct()


_IN = "(a <> '' and b <> '' and (contains(b, a) or (length(a) >= 5 and len(list_filter(flatten(list_transform([length(a) - 1, length(a), length(a) + 1], lambda w: list_transform(range(1, length(b) - w + 2), lambda i: substr(b, i, w)))), lambda s: damerau_levenshtein(a, s) <= 1)) > 0)))"


@query("n07_symbol_in_entry", f"with {_PAIRS} select distinct item, entry from (select item, entry, {_norm('item')} as a, {_norm('entry')} as b from pairs where kind = 'symbol') where {_IN}")
def _(spark, d):
    return _pairs(spark, d).where("kind = 'symbol'").where(T.symbol_in_norm(T.norm(F.col("item")), T.norm(F.col("entry")))).select("item", "entry").distinct()


@query("n08_member_exact", f"with {_PAIRS} select distinct item, entry from (select item, entry, {_norm('item')} as a, {_norm('entry')} as b from pairs) where lower(item) = lower(entry) or {_fuzzy('a', 'b')}")
def _(spark, d):
    return _pairs(spark, d).where(T.member_exact(F.col("item"), F.array("entry"))).select("item", "entry").distinct()


@query("n09_norm_endpoint", f"select url, {_ep('url')} as n from pages")
def _(spark, d):
    corpus.ship(spark)
    return spark.read.parquet(f"{d}/pages.parquet").select("url", T.norm_endpoint(F.col("url")).alias("n"))


_PATH = _rx("entry", "(" + X.EP_PATH + ")")
_CANDIDATES = f"select entry, {_ep('entry')} as c from entries union select entry, {_ep(_PATH)} from entries"


@query("n10_endpoint_candidates", f"with {_ENTRIES} select distinct entry, c as candidate from ({_CANDIDATES}) where c is not null and c <> ''")
def _(spark, d):
    return view(spark, d, "entries").select("entry", F.explode(T.endpoint_candidates(F.col("entry"))).alias("candidate")).distinct()


_EP_MATCH = f"(a <> '' and (a = c or (greatest(length(a), length(c)) / least(length(a), length(c)) <= 1.3 and {_shares('a', 'c', 'floor(least(length(a), length(c)) * 0.8)::int')})))"


@query("n11_endpoint_authorised", f"with {_PAIRS}, cand as ({_CANDIDATES}) select distinct item, entry from (select item, entry, {_ep('item')} as a, c from pairs join cand using (entry) where kind = 'endpoint' and c <> '') where {_EP_MATCH}")
def _(spark, d):
    a = T.norm_endpoint(F.col("item"))
    return _pairs(spark, d).where("kind = 'endpoint'").where(F.exists(T.endpoint_candidates(F.col("entry")), lambda b: T.endpoint_matches(a, b))).select("item", "entry").distinct()


_MEMBER = f"""case when (contains(al, '/') or contains(al, '.')) and contains(i, '/') then i = al or ends_with(i, '/' || al) or ends_with(al, '/' || i) or (not regexp_matches(al, '\\.\\w+$') and starts_with(i, regexp_replace(al, '/+$', '') || '/'))
 else contains(i, al) or contains(al, i) or list_contains(segs, al) or len(list_filter(toks, lambda t: len(list_filter(segs, lambda s: contains(s, t) or {_typo("regexp_replace(t, '[^a-z0-9]', '', 'g')", "regexp_replace(s, '[^a-z0-9]', '', 'g')")})) > 0)) > 0 or {_fuzzy('a', 'b')} end"""
_MEMBER_ROW = f"lower(item) as i, lower(entry) as al, regexp_split_to_array(lower(item), '[/.]') as segs, list_filter(regexp_split_to_array(lower(entry), '[^a-z0-9]+'), lambda t: length(t) >= 4) as toks, {_norm('item')} as a, {_norm('entry')} as b"


@query("n12_member_path", f"with {_PAIRS} select distinct item, entry from (select item, entry, {_MEMBER_ROW} from pairs where kind = 'file') where {_MEMBER}")
def _(spark, d):
    return _pairs(spark, d).where("kind = 'file'").where(T.member_path(F.col("item"), F.array("entry"))).select("item", "entry").distinct()


@query("n13_support_files", f"with {_SURFACE} select distinct item from surface where kind = 'file' and ({' or '.join(_is('item', p) for p in X.SUPPORT_FILES)})")
def _(spark, d):
    return _surface(spark, d).where("kind = 'file'").where(T.support_file(F.col("item"))).select("item").distinct()


# --- C: findings --------------------------------------------------------------

_E = lambda fields: f"e.audit_id = s.audit_id and e.field in {_list(fields)}"
_SAID = "coalesce((select lower(string_agg(entry, ' ' order by field desc, pos)) from entries e where e.audit_id = s.audit_id and field in ('features', 'behavioral')), '')"
_WORDS = lambda words: "(" + " or ".join(f"contains(said, {_lit(w)})" for w in words) + ")"
_FUZZY_IN = lambda fields: f"exists (select 1 from en e where {_E(fields)} and {_fuzzy('s.a', 'e.b')})"
_LEAF = f"exists (select 1 from en e where {_E(['endpoints'])} and length(leaf) >= 3 and (s.a = leaf or (contains(s.a, leaf) and length(leaf) >= length(s.a) * 0.7)))"
_COVER = f"""
member as (select distinct audit_id, item from (select audit_id, item, {_MEMBER_ROW} from (select s.audit_id, s.item, e.entry from s join entries e on {_E(['files', 'features'])} where s.kind = 'file')) where {_MEMBER}),
eps as (select distinct audit_id, c from (select audit_id, {_ep('entry')} as c from entries where field = 'endpoints' union all select audit_id, {_ep(_PATH)} from entries where field = 'endpoints') where c <> ''),
inside as (select distinct audit_id, item from (select s.audit_id, s.item, s.a, e.b from s join en e on {_E(['features', 'behavioral'])} where s.kind = 'symbol') where {_IN}),
routed as (select distinct audit_id, item from (select s.audit_id, s.item, s.p as a, eps.c from s join eps using (audit_id) where s.kind = 'endpoint') where {_EP_MATCH}),
cover as (select s.*, case kind
 when 'file' then not exists (select 1 from entries e where {_E(['files'])}) or {' or '.join(_is('s.item', p) for p in X.SUPPORT_FILES)} or exists (select 1 from member m where m.audit_id = s.audit_id and m.item = s.item)
 when 'dep' then exists (select 1 from entries e where {_E(['deps'])} and lower(e.entry) = lower(s.item)) or {_FUZZY_IN(['deps', 'features', 'endpoints', 'env', 'behavioral'])}
 when 'env' then exists (select 1 from entries e where {_E(['env'])} and lower(e.entry) = lower(s.item)) or {_FUZZY_IN(['env'])}
 when 'endpoint' then exists (select 1 from routed n where n.audit_id = s.audit_id and n.item = s.item)
 when 'cron' then {_WORDS(X.CRON_KEYWORDS)} or {_FUZZY_IN(['features', 'behavioral'])}
 when 'listener' then {_WORDS(X.LISTENER_KEYWORDS)} or {_FUZZY_IN(['features', 'behavioral'])}
 when 'symbol' then length(item) < 5 or {_FUZZY_IN(['features', 'behavioral', 'files'])} or exists (select 1 from inside n where n.audit_id = s.audit_id and n.item = s.item) or {_LEAF} end as covered from s)"""
_RANK = "case kind " + " ".join(f"when '{k}' then {r}" for r, k in enumerate(["file", "dep", "env", "endpoint", "cron", "listener", "symbol"])) + " end"
_KIND = "case kind " + " ".join(f"when '{k}' then '{n}'" for k, n in compare._KIND_OF.items()) + " end"
#: The file that stands for a kind where no line has the evidence.
_CODE_OF = "case kind " + " ".join(f"when '{k}' then '{f}'" for k, _, f in X.KINDS if f) + " end"
_SEVERITY = "case kind " + " ".join(f"when '{k}' then '{next(s for n2, s, _ in X.KINDS if n2 == n)}'" for k, n in compare._KIND_OF.items()) + " end"
_FINDINGS = f"""{_SURFACE}, {_ENTRIES},
en as (select audit_id, field, entry, {_norm('entry')} as b, {_norm("regexp_replace(entry, '.*/', '')")} as leaf from entries),
s as (select s.audit_id, kind, item, first, {_norm('item')} as a, {_ep('item')} as p, {_SAID} as said from surface s where kind <> 'import'), {_COVER},
found as (select audit_id, row_number() over (partition by audit_id order by {_RANK}, first) as ord, {_KIND} as kind, {_SEVERITY} as severity, item as evidence
 from (select *, bool_or(covered) over (partition by audit_id, kind) as any_covered from cover) where not case when kind = 'cron' then any_covered else covered end)"""

for _k, (_n, _) in enumerate(compare._KIND_OF.items(), 1):
    query(f"c{_k:02d}_{_n}_findings", f"with {_FINDINGS} select audit_id, evidence from found where kind = '{compare._KIND_OF[_n]}'")(lambda spark, d, k=compare._KIND_OF[_n]: _findings(spark, d).where(F.col("kind") == k).select("audit_id", "evidence"))

_SCORES = f"""{_FINDINGS},
audits as (select distinct audit_id from lines),
kinds as (select audit_id, kind, count(*) as n, min(ord) as ord, max(case severity when 'high' then 3 when 'medium' then 2 else 1 end) as r from found group by 1, 2),
scored as (select a.audit_id, coalesce(sum(n), 0)::bigint as n_findings, case max(r) when 3 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as score, string_agg(n || ' ' || kind, ', ' order by ord) as parts from audits a left join kinds k using (audit_id) group by 1)"""


@query("c08_scores", f"with {_SCORES} select audit_id, n_findings, score from scored")
def _(spark, d):
    actual = _actual(spark, d)
    return compare.scores(compare.findings(actual, _scope(spark, d)), actual).select("audit_id", "n_findings", "score")


@query("c09_summaries", f"with {_SCORES} select audit_id, case when n_findings = 0 then 'Diff adds 0 unauthorized thing(s). ' else 'Diff adds ' || n_findings || ' unauthorized thing(s): ' || parts || '. ' end || 'scope_creep_score=' || score as summary from scored")
def _(spark, d):
    actual = _actual(spark, d)
    return compare.scores(compare.findings(actual, _scope(spark, d)), actual).select("audit_id", "summary")


@query("c10_findings", f"with {_FINDINGS} select audit_id, ord, kind, severity, evidence from found")
def _(spark, d):
    return _findings(spark, d).select("audit_id", "ord", "kind", "severity", "evidence")


# --- S: sources and sinks ------------------------------------------------------


@query("s02_diff_sizes", f"with lines as ({corpus.LINES}) select audit_id, count(*) filter (raw[1] in ('+', '-')) as changed_lines from lines group by 1")
def _(spark, d):
    return stores.diff_sizes(_changes(spark, d))


@query("s04_prompt_precedence", "select o_orderkey as audit_id, case when o_orderkey % 3 = 0 then 'file ' || o_orderkey when o_orderpriority <> '' and o_orderkey % 3 = 1 then o_orderpriority else 'default' end as prompt from orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    file = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("file "), F.col("o_orderkey").cast("string"))).otherwise(F.lit(" "))
    title = F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("audit_id"), stores.prompt_of(file, title, F.lit("default")).alias("prompt"))


@query("s08_scope_cache", f"with p as ({corpus.PROMPTS}), k as (select audit_id, substr(sha256('prov|m' || audit_id % 3 || '|' || prompt), 1, 32) as h from p), c as (select h, max_by('scope of ' || audit_id, audit_id) as cached_scope from k where audit_id % 2 = 0 and audit_id % 8 <> 4 group by 1) select audit_id, h as prompt_hash, cached_scope from k left join c using (h)")
def _(spark, d):
    rows = view(spark, d, "prompts").select("audit_id", "prompt", F.lit("prov").alias("provider"), F.concat(F.lit("m"), (F.col("audit_id") % 3).cast("string")).alias("model"))
    cache = rows.where("audit_id % 2 = 0").select(stores.cache_key(F.col("provider"), F.col("model"), F.col("prompt")).alias("prompt_hash"), F.concat(F.lit("scope of "), F.col("audit_id").cast("string")).alias("scope"), F.col("audit_id").alias("cached_at"), F.lit(False).alias("skipped"), (F.col("audit_id") % 8 == 4).alias("deterministic"))
    cache = stores.cacheable(cache)
    return stores.with_cache(rows, cache).select("audit_id", "prompt_hash", "cached_scope")


@query("s13_gate", f"with {_SCORES} select audit_id, score, case when score = 'HIGH' then 1 else 0 end as exit_code, score in ('HIGH', 'MEDIUM') as gate_failed from scored")
def _(spark, d):
    actual = _actual(spark, d)
    return stores.gate(compare.scores(compare.findings(actual, _scope(spark, d)), actual), "high, medium")


_DETAIL = "case kind " + " ".join(f"when '{k}' then {_lit(lead)} || evidence || {_lit(end)}" for k, (lead, end) in X.DETAILS.items()) + " end"


@query("s10_report", f"with {_FINDINGS}, r as (select *, row_number() over w as k, count(*) over (partition by audit_id, severity) as n from found window w as (partition by audit_id, severity order by ord)) select audit_id, severity, n, string_agg(kind || ': ' || {_DETAIL}, chr(10) order by ord) filter (where severity <> 'low' or n <= 5 or k <= 3) as shown from r group by 1, 2, 3")
def _(spark, d):
    return stores.report(_findings(spark, d)).select("audit_id", "severity", "n", "shown")


# --- B: impact rules -------------------------------------------------------------

_FLAGS = ", ".join(f"{_is('file', '(?i)' + p)} as f_{c}" for c, p in X.FILE_CLASSES.items())
_READ = "list_distinct(flatten([" + ", ".join(f"regexp_extract_all(added_code, {_lit(p)}, 1)" for p in X.ENV_ALL) + "]))"
_N = lambda c: f"count(*) filter ({c})"
_FILES = lambda c, x="file": f"coalesce(string_agg({x}, '|' order by ord) filter ({c}), '')"
_PLURAL = lambda c, w: f"{c} || case when {c} > 1 then ' {w}s' else ' {w}' end"
_IMPACT = f"""{_STATS},
cl as (select *, {_FLAGS}, {_is('added_code', X.SECRET)} as secret, {_is('added_code', X.DEBT)} as debt, {_is('added_code', X.PACKAGE_LINE)} as dep_line, regexp_replace(split_part(file, '/', -1), '\\.(ts|js|tsx|jsx|py|go|rs)$', '') as base from stats),
cs as (select *, f_code and not f_test and not f_config as src from cl),
rd as (select audit_id, list_distinct(flatten(list(case when src then {_READ} else [] end))) as r, list_distinct(flatten(list(case when f_env_file then regexp_extract_all(added_code, {_lit('(?m)' + X.DOTENV)}, 1) else [] end))) as df, flatten(list(regexp_extract_all(added_code, {_lit(X.IMPORTED)}, 1))) as imp, count(*) as nf from cs group by 1),
cf as (select cs.*, rd.*, list_filter(r, lambda v: not list_contains(df, v)) as missing from cs join rd using (audit_id) where nf >= 2),
g as (select audit_id, any_value(len(df)) as n_df, any_value(len(r)) as n_r, any_value(len(missing)) as n_missing, {', '.join(f"{_N('f_' + c)} as n_{c}" for c in X.FILE_CLASSES)}, {_N('src')} as n_src, {', '.join(f"{_FILES('f_' + c)} as x_{c}" for c in X.FILE_CLASSES)}, {_FILES('src')} as x_src,
 {_N('f_route and is_new')} as n_nr, {_FILES('f_route and is_new')} as x_nr, {_N('lines_added >= 200')} as n_big, {_FILES('lines_added >= 200', "file || ' (+' || lines_added || ')'")} as x_big, {_N('src and secret')} as n_secret, {_FILES('src and secret')} as x_secret, {_N('debt')} as n_debt, {_FILES('debt')} as x_debt, {_N('f_package and dep_line')} as n_dl,
 {_N('is_new and src and len(list_filter(imp, lambda q: contains(q, base))) = 0')} as n_or, {_FILES('is_new and src and len(list_filter(imp, lambda q: contains(q, base))) = 0')} as x_or, {_N('f_route and lines_added >= 5')} as n_w, {_FILES('f_route and lines_added >= 5')} as x_w, {_FILES('src and len(list_filter(missing, lambda v: contains(added_code, v))) > 0')} as x_name
 from cf group by 1),
fired as ({' union all '.join(f"select audit_id, {r} as rank, '{p}' as pattern, {files} as files from g where {test}" for r, (p, test, files) in enumerate([
    ("schema-no-migration", "n_schema > 0 and n_migration = 0", "x_schema"), ("env-not-in-dotenv", "n_missing > 0 and n_env_file > 0", "concat_ws('|', nullif(x_name, ''), nullif(x_env_file, ''))"), ("env-defined-not-used", "n_env_file > 0 and n_df > 0 and n_r = 0 and n_src > 0", "x_env_file"),
    ("route-no-test", "n_test = 0 and n_nr > 0", "x_nr"), ("many-changes-no-tests", "n_src >= 3 and n_test = 0", "x_src"), ("exports-no-types", "false", "''"), ("infra-only", "n_docker + n_ci > 0 and n_src = 0", "concat_ws('|', nullif(x_docker, ''), nullif(x_ci, ''))"), ("config-sprawl", "n_config >= 3", "x_config"),
    ("schema-migration-pair", "n_schema > 0 and n_migration > 0", "x_schema || '|' || x_migration"), ("deps-no-lockfile", "n_package > 0 and n_lock = 0 and n_dl > 0", "x_package"), ("styles-no-component", "n_style > 0 and n_component = 0 and n_src = 0", "x_style"), ("auth-middleware-changed", "n_middleware > 0", "x_middleware"),
    ("large-file", "n_big > 0", "x_big"), ("hardcoded-secret", "n_secret > 0", "x_secret"), ("tech-debt-added", "n_debt >= 2", "x_debt"), ("new-file-not-imported", "n_or > 0", "x_or"), ("api-no-docs", "n_docs = 0 and n_w > 0", "x_w")], 1))}),
warned as (select * from (select *, row_number() over (partition by audit_id order by rank) as ord from fired) where ord <= {X.WARNINGS_KEPT})"""


def _warnings(spark: SparkSession, d: str) -> DataFrame:
    return impact.warnings(diff.file_stats(_scan(spark, d)))


@query("b00_warnings", f"with {_IMPACT} select audit_id, ord, pattern, files from warned")
def _(spark, d):
    return _warnings(spark, d).select("audit_id", "ord", "pattern", F.array_join("files", "|").alias("files"))


for _k, (_p, _, _) in enumerate(X.RULES, 1):
    query(f"b{_k:02d}_{_p.replace('-', '_')}", f"with {_IMPACT} select audit_id, files from warned where pattern = '{_p}'")(lambda spark, d, p=_p: _warnings(spark, d).where(F.col("pattern") == p).select("audit_id", F.array_join("files", "|").alias("files")))


# --- D, L: scopes from prompts ---------------------------------------------------

_P = f"p as ({corpus.PROMPTS})"
_ALL = lambda p, g=1: f"regexp_extract_all(prompt, {_lit(p)}, {g})"
_UNIQUE = lambda x: f"list_filter({x}, lambda z, i: list_position({x}, z) = i)"


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return scope.extract(view(spark, d, "prompts"))


_D = {
    "endpoints": f"list_filter(list_transform({_ALL(X.PROMPT_ENDPOINT)}, lambda e: trim(e)), lambda e: length(e) > 1 and not regexp_matches(e, '^/[a-z]$'))",
    "env": f"list_filter({_ALL(X.PROMPT_ENV)}, lambda v: length(v) >= 4)",
    "deps": f"list_concat(list_filter(list_transform({_ALL(X.PROMPT_DEP)}, lambda e: lower(e)), lambda e: length(e) >= 2 and e not in {_list(X.PROMPT_NOT_DEPS)}), list_filter(regexp_split_to_array(lower(prompt), '[^a-z0-9@._/-]+'), lambda w: w in {_list(X.KNOWN_PACKAGES)}))",
}
for _name, _field in {"d02_endpoints": "endpoints", "d04_env": "env", "d05_dependencies": "deps"}.items():
    query(_name, f"with {_P}, l as (select audit_id, {_D[_field]} as v from p) select audit_id, array_to_string({_UNIQUE('v')}, '|') as items from l")(lambda spark, d, f=_field: _extracted(spark, d).select("audit_id", F.array_join(f, "|").alias("items")))


@query("d01_files", f"with {_P}, l as (select audit_id, list_concat({_ALL(X.PROMPT_FILE_EXT, 0)}, {_ALL(X.PROMPT_FILE_DIR, 0)}) as v, {_D['endpoints']} as e from p) select audit_id, array_to_string(list_filter({_UNIQUE('v')}, lambda f: not list_contains(e, f) and not list_contains(e, '/' || f)), '|') as items from l")
def _(spark, d):
    return _extracted(spark, d).select("audit_id", F.array_join("files", "|").alias("items"))


@query("d06_scheduled", f"with {_P} select audit_id, len({_ALL(X.PROMPT_CRON)}) as n from p")
def _(spark, d):
    return _extracted(spark, d).select("audit_id", F.size(F.filter("behavioral", lambda b: F.endswith(b, F.lit(" (scheduled task)")))).cast("long").alias("n"))


@query("d07_behavioral", f"with {_P}, l as (select audit_id, {_ALL(X.PROMPT_CRON)} as c, list_transform({_ALL(X.PROMPT_BEHAVIOR)}, lambda v: lower(v)) as b from p) select audit_id, array_to_string(list_concat(list_transform(c, lambda v: v || ' (scheduled task)'), {_UNIQUE('b')}), '|') as items from l")
def _(spark, d):
    return _extracted(spark, d).select("audit_id", F.array_join("behavioral", "|").alias("items"))


_REST = "prompt"
for _pat, _by in ((X.PROMPT_FILE_EXT, ""), (X.PROMPT_FILE_DIR, ""), (X.PROMPT_ENDPOINT, " "), (X.PROMPT_ENV, ""), (X.PROMPT_DEP, ""), (X.PROMPT_CRON, ""), (X.PROMPT_BEHAVIOR, "")):
    _REST = f"regexp_replace({_REST}, {_lit(_pat)}, '{_by}', 'g')"
_CLEAN = f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, {_lit(X.PHRASE_LEAD)}, ''), {_lit(X.PHRASE_TAIL)}, ''), {_lit(X.PHRASE_PAIRS)}, ' ', 'g'), '\\s*/\\s*', ' ', 'g'), '\\s+', ' ', 'g')))"


@query(
    "d09_features",
    f"with {_P}, r as (select audit_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace({_REST}, '\\s+', ' ', 'g')), '[.;,\\n]+'), lambda c: trim(c)), lambda c: length(c) > 3) as cl from p), "
    f"k as (select audit_id, list_filter(list_transform(cl, lambda c: {_CLEAN}), lambda c: length(c) >= 4 and len(regexp_split_to_array(c, '\\s+')) <= 8 and c not in {_list(X.PHRASE_NOTHING)}) as kept from r), "
    f"m as (select audit_id, list_filter(list_transform(kept, lambda c: array_to_string(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: length(w) > 1 and w not in {_list(X.PHRASE_STOP)}), ' ')), lambda c: c <> '') as v from k) select audit_id, array_to_string({_UNIQUE('v')}, '|') as items from m",
)
def _(spark, d):
    return _extracted(spark, d).select("audit_id", F.array_join("features", "|").alias("items"))


_TRIMMED = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(
    "l01_chunks",
    f"with recursive d as (select doc_id as audit_id, {_TRIMMED('text')} as t from documents), g as (select audit_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: {_TRIMMED('p')}), lambda p: p <> '')) as p, generate_subscripts(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: {_TRIMMED('p')}), lambda p: p <> ''), 1) as i from d where length(t) > 600), "
    f"s as (select audit_id, i, unnest(case when length(p) <= 600 then [p] when len(regexp_extract_all(p, {_lit(X.SENTENCES)})) = 0 then [p] else list_filter(list_transform(regexp_extract_all(p, {_lit(X.SENTENCES)}), lambda x: {_TRIMMED('x')}), lambda x: x <> '') end) as s, generate_subscripts(case when length(p) <= 600 then [p] when len(regexp_extract_all(p, {_lit(X.SENTENCES)})) = 0 then [p] else list_filter(list_transform(regexp_extract_all(p, {_lit(X.SENTENCES)}), lambda x: {_TRIMMED('x')}), lambda x: x <> '') end, 1) as j from g), "
    "h as (select audit_id, i, j, unnest(range(0, (length(s) - 1) // 600 + 1)) as k, s from s), "
    "n as (select audit_id, substr(s, k * 600 + 1, 600) as s, row_number() over (partition by audit_id order by i, j, k) as r from h), "
    "f as (select audit_id, r, 0 as chunk, s as now, null::varchar as done from n where r = 1 union all select n.audit_id, n.r, f.chunk + (not fits)::int, case when fits then f.now || ' ' || n.s else n.s end, case when not fits then f.now end from (select f.*, length(f.now) + length(m.s) + 1 <= 600 as fits from f join n m on m.audit_id = f.audit_id and m.r = f.r + 1) f join n on n.audit_id = f.audit_id and n.r = f.r + 1), "
    "z as (select audit_id, chunk, arg_max(now, r) as text from f group by 1, 2) select audit_id, chunk, text from z union all select audit_id, 0, t from d where t is null or audit_id not in (select audit_id from z)",
)
def _(spark, d):
    corpus.ship(spark)
    return scope.chunks(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("audit_id"), F.col("text").alias("prompt")))


@query("l03_merged", f"with {_ENTRIES}, n as (select *, {_norm('entry')} as n from entries), f as (select * from (select *, row_number() over (partition by audit_id, field, n order by pos) as k from n where n <> '') where k = 1) select audit_id, field, entry from f a where not exists (select 1 from f b where a.audit_id = b.audit_id and a.field = b.field and contains(b.n, a.n) and length(b.n) > length(a.n))")
def _(spark, d):
    return scope.merged(view(spark, d, "entries")).select("audit_id", "field", "entry")


@query("l04_scope_difference", f"with {_ENTRIES}, n as (select audit_id, field, entry, pos, {_norm('entry')} as n from entries), a as (select * from n where pos <= 3), b as (select * from n where pos >= 2) select distinct audit_id, field, entry, 'added' as change from b where not exists (select 1 from a where a.audit_id = b.audit_id and a.field = b.field and a.n = b.n) union select distinct audit_id, field, entry, 'removed' from a where not exists (select 1 from b where a.audit_id = b.audit_id and a.field = b.field and a.n = b.n)")
def _(spark, d):
    e = view(spark, d, "entries")
    return scope.difference(e.where("pos <= 3"), e.where("pos >= 2"))


@query("l05_parsed_replies", "select o_orderkey as audit_id, 'a' || o_custkey || '.ts|b' as files, case when o_orderkey % 2 = 0 then 'zod' else '' end as deps from orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    inner = F.concat(F.lit('{"files_allowed": ["a'), F.col("o_custkey").cast("string"), F.lit('.ts", "b", ""]'), F.when(F.col("o_orderkey") % 2 == 0, F.lit(', "deps_allowed": ["zod"]')).otherwise(F.lit("")), F.lit("}"))
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"scope": '), inner, F.lit("}"))).otherwise(inner)
    rows = o.select(F.col("o_orderkey").alias("audit_id"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply"))
    return scope.parse_json(rows).select("audit_id", F.array_join("scope.files_allowed", "|").alias("files"), F.array_join("scope.deps_allowed", "|").alias("deps"))


# --- K: contracts ------------------------------------------------------------------


@query("k04_contract_ids", "select o_orderkey as id, substr(sha256('p' || o_orderkey || o_orderpriority || '1.0'), 1, 32) as contract_id, substr(sha256('p' || o_orderkey), 1, 16) as prompt_hash from orders")
def _(spark, d):
    prompt = F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), contracts.contract_id(prompt, F.col("o_orderpriority"), F.lit(None).cast("string")).alias("contract_id"), contracts.prompt_hash(prompt).alias("prompt_hash"))


@query("k05_chains", f"with recursive c as ({corpus.CONTRACTS}), r as (select id, 0 as depth, '' as chain from c where parent_id is null union all select c.id, r.depth + 1, r.chain || case when r.chain = '' then '' else '>' end || c.parent_id from c join r on c.parent_id = r.id) select id, depth, chain from r")
def _(spark, d):
    return contracts.chains(view(spark, d, "contracts")).select("id", "depth", F.array_join(F.transform("chain", lambda c: c.cast("string")), ">").alias("chain"))


_ITEMS = f"c as ({corpus.CONTRACTS}), i as (select distinct o_orderkey as id, case when l_partkey % 2 = 0 then 'deps' else 'files' end as field, 'Part-' || (l_partkey % 50) as item from orders join lineitem on l_orderkey = o_orderkey)"
_BEYOND = f"{_ITEMS}, ch as (select i.*, c.parent_id from i join c using (id)), b as (select id, parent_id, field, item from ch where parent_id is not null and not exists (select 1 from i p where p.id = ch.parent_id and p.field = ch.field and {_norm('p.item')} = {_norm('ch.item')}))"


def _contract_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_partkey") % 2 == 0, "deps").otherwise("files").alias("field"), F.concat(F.lit("Part-"), (F.col("l_partkey") % 50).cast("string")).alias("item"))
    known = view(spark, d, "contracts").select("id", "parent_id")
    parent = parts.join(known.select("id"), "id", "left_semi").distinct()
    return parent.join(known, "id"), parent


@query("k08_expansions", f"with {_BEYOND} select id, field, item, not exists (select 1 from i p where p.id = b.parent_id) as advisory from b")
def _(spark, d):
    return contracts.expansions(*_contract_items(spark, d)).select("id", "field", "item", "advisory")


@query("k09_narrowing", f"with {_BEYOND}, k as (select distinct id, parent_id from ch where parent_id is not null), n as (select id, count(*) as n from b group by 1) select k.id, coalesce(n, 0) as expansions, n is null as narrow, not exists (select 1 from i p where p.id = k.parent_id) as advisory from k left join n using (id)")
def _(spark, d):
    return contracts.narrowing(*_contract_items(spark, d)).select("id", "expansions", "narrow", "advisory")


@query("k07_expired", f"select o_orderkey as id, 'contract.expired' as kind, 'high' as severity, printf({_lit(X.EXPIRED_DETAIL)}, substr(o_custkey::varchar, 1, 8), strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) as detail, 'expired ' || round((epoch(timestamp '1998-01-01') - epoch(o_orderdate)) / 60)::bigint || 'min ago' as evidence, 'HIGH' as score from orders where o_orderdate < timestamp '1998-01-01'")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"), F.col("o_orderdate").alias("parent_expires_at"))
    return contracts.expired(rows, F.lit("1998-01-01").cast("timestamp"))


@query("k09_expansion_findings", f"with {_BEYOND} select id, 'contract.expansion' as kind, 'high' as severity, printf({_lit(X.EXPANSION_DETAIL)}, item, field) as detail, field || '+=' || item as evidence, 'HIGH' as score from b where exists (select 1 from i p where p.id = b.parent_id)")
def _(spark, d):
    return contracts.expansion_findings(contracts.expansions(*_contract_items(spark, d)))


@query("k01_scope_source", "select o_orderkey as audit_id, case when o_custkey % 3 = 0 then 'claim' when o_orderkey % 2 = 0 then 'override' else 'extraction' end as source, case when o_custkey % 3 = 0 then 'dsl' else 'inferred' end as mode, case when o_custkey % 3 = 0 then 1.0 else 0.85 end::double as confidence, o_custkey % 6 = 3 as claim_warning from orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    audits = o.select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("claim_id"), (F.col("o_orderkey") % 2 == 0).alias("has_override"))
    known = o.select(F.col("o_custkey").alias("claim_id")).distinct().where("claim_id % 3 = 0").select("claim_id", F.when(F.col("claim_id") % 6 == 0, "locked").otherwise("completed").alias("status"))
    return contracts.scope_source(audits, known)


@query("k10_handoff", f"with l as ({corpus.LEDGER}) select entry_id, case when score = 'HIGH' then 'deny' when entry_id % 5 = 0 then 'flag' else 'allow' end as decision from l")
def _(spark, d):
    return contracts.handoff(view(spark, d, "ledger").withColumn("advisory_ok", F.col("entry_id") % 5 != 0)).select("entry_id", "decision")


# --- G: ledger -----------------------------------------------------------------------

_L = f"l as ({corpus.LEDGER})"


@query("g02_appended", f"with {_L} select entry_id, agent, task from l where contract_id is null union all select min(entry_id), min_by(agent, entry_id), min_by(task, entry_id) from l where contract_id is not null group by contract_id")
def _(spark, d):
    return ledger.appended(view(spark, d, "ledger")).select("entry_id", "agent", "task")


@query("g03_latest", f"with {_L} select entry_id, agent from l order by entry_id desc limit {ledger.CAP}")
def _(spark, d):
    return ledger.latest(view(spark, d, "ledger")).select("entry_id", "agent")


@query("g04_by_file", f"with {_L} select entry_id from l where file = 'm3.ts' or ends_with(file, '/m3.ts')")
def _(spark, d):
    return ledger.by_file(view(spark, d, "ledger"), "m3.ts").select("entry_id")


@query("g05_by_agent", f"with {_L} select entry_id from l where lower(agent) = 'agent7'")
def _(spark, d):
    return ledger.by_agent(view(spark, d, "ledger"), "AGENT7").select("entry_id")


@query("g06_ownership", f"with {_L} select file, count(*) as n, string_agg(agent, '|' order by happened, entry_id) as agents from l group by 1")
def _(spark, d):
    return ledger.ownership(view(spark, d, "ledger")).select("file", "n", F.array_join(F.transform("history", lambda h: h["agent"]), "|").alias("agents"))


@query("g07_last_seen", f"with {_L} select lower(agent) as agent, strftime(max(happened), '%Y-%m-%d %H:%M:%S.%f') as last_seen from l group by 1")
def _(spark, d):
    return ledger.last_seen(view(spark, d, "ledger")).select("agent", _moment("last_seen").alias("last_seen"))


@query("g08_since", f"with {_L} select entry_id from l where happened > timestamp '2024-01-20'")
def _(spark, d):
    return ledger.since(view(spark, d, "ledger"), F.lit("2024-01-20").cast("timestamp")).select("entry_id")


@query("g10_catch_up", f"with {_L}, o as (select agent, max(happened) as own from l group by 1) select agent, (select count(*) from l where l.happened > o.own) as missed from o")
def _(spark, d):
    return ledger.catch_up(view(spark, d, "ledger"))


@query("g11_lines", f"with {_L} select entry_id, '[' || strftime(happened, '%Y-%m-%d %H:%M:%S') || '] ' || agent || ' — ' || task || ' (' || score || ', ' || findings_count || ' findings)' as line from l")
def _(spark, d):
    return ledger.lines(view(spark, d, "ledger"))


# --- F, Z, R, I, Q: claims, conflicts, check-ins, gate ---------------------------------

_FOLD = f"""with recursive e as ({corpus.CLAIM_EVENTS}), n as (select *, row_number() over (partition by root, file order by happened, op_id) as k from e),
h as (select 0 as k, root, file, null::varchar as holder, null::timestamp as until, null::bigint as op_id, null::varchar as outcome, null::varchar as held_by from (select distinct root, file from e)
 union all select n.k, n.root, n.file,
  case when n.op = 'claim' then case when live and h.holder <> n.agent then h.holder else n.agent end when live and h.holder = n.agent then case when n.op = 'release' then null else n.agent end when live then h.holder end,
  case when n.op = 'claim' then case when live and h.holder <> n.agent then h.until else n.happened + interval 2 hours end when live and h.holder = n.agent then case when n.op = 'release' then null else n.happened + interval 2 hours end when live then h.until end, n.op_id,
  case when n.op = 'claim' then case when live and h.holder <> n.agent then 'conflict' else 'claimed' end when n.op = 'release' then case when live and h.holder = n.agent then 'released' else 'none' end else case when live and h.holder = n.agent then 'extended' else 'not_found' end end,
  case when n.op = 'claim' and live and h.holder <> n.agent then h.holder end
 from (select h.*, m.happened as now, h.holder is not null and not (h.until < m.happened) as live from h join n m on m.root = h.root and m.file = h.file and m.k = h.k + 1) h join n on n.root = h.root and n.file = h.file and n.k = h.k + 1)
select op_id, outcome, held_by from h where k > 0"""


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = view(spark, d, "claim_events")
    return claims.fold_file_claims(events), events


@query("f02_file_claims", _FOLD)
def _(spark, d):
    return _folded(spark, d)[0].select("op_id", "outcome", "held_by")


_AS_OF = "2024-01-20 12:00:00"
_HELD = _FOLD.removesuffix("select op_id, outcome, held_by from h where k > 0") + f"""
, x as (select h.*, e.happened, e.agent, row_number() over (partition by h.root, h.file order by e.happened desc, h.op_id desc) as r from h join e using (op_id) where h.k > 0 and outcome in ('claimed', 'extended', 'released') and e.happened <= timestamp '{_AS_OF}'),
held as (select root, file, agent, happened + interval 2 hours as expires_at from x where r = 1 and outcome <> 'released' and happened + interval 2 hours >= timestamp '{_AS_OF}')"""


def _held(spark: SparkSession, d: str) -> DataFrame:
    folded, events = _folded(spark, d)
    as_of = F.lit(_AS_OF).cast("timestamp")
    return claims.active(folded, events.where(F.col("at") <= as_of), as_of)


@query("f01_unexpired_claims", f"{_HELD} select root, file, agent, strftime(expires_at, '%Y-%m-%d %H:%M:%S.%f') as expires_at from held")
def _(spark, d):
    return _held(spark, d).select("root", "file", "agent", _moment("expires_at").alias("expires_at"))


@query("f03_released", f"{_FOLD.removesuffix('select op_id, outcome, held_by from h where k > 0')} select agent, count(*) as released from h join e using (op_id) where outcome = 'released' group by 1")
def _(spark, d):
    return claims.outcomes(_folded(spark, d)[0], "released")


@query("f04_extended", f"{_FOLD.removesuffix('select op_id, outcome, held_by from h where k > 0')} select agent, count(*) filter (outcome = 'extended') as extended, count(*) filter (outcome = 'not_found') as not_found from h join e using (op_id) where outcome in ('extended', 'not_found') group by 1")
def _(spark, d):
    return claims.outcomes(_folded(spark, d)[0], "extended", "not_found")


@query("f06_active_claims", f"{_HELD} select agent, count(*) as n_files, min(round((epoch(date_trunc('second', expires_at)) - epoch(timestamp '{_AS_OF}')) / 60)::bigint) as minutes_left, string_agg(root || '/' || file, ', ' order by root, file) as files from held group by 1")
def _(spark, d):
    return claims.by_agent(_held(spark, d).withColumn("file", F.concat("root", F.lit("/"), "file")), F.lit(_AS_OF).cast("timestamp"))


@query(
    "f05_recent_touches",
    f"with {_L}, c as (select 'src/m' || (p_partkey % 23) || '.ts' as file, 'agent' || (p_partkey % 40) as agent, timestamp '2024-01-01' + to_hours((p_partkey % 700)::int) as expires_at from part) "
    "select distinct r.entry_id as request_id, r.file, t.agent, 'touched' as why from l r join l t on r.file = t.file and r.agent <> t.agent and t.happened > r.happened - interval 1 hour and t.happened <= r.happened union select r.entry_id, r.file, c.agent, 'claimed' from l r join c on c.file = r.file and c.agent <> r.agent and c.expires_at >= r.happened and c.expires_at < r.happened + interval 2 hours",
)
def _(spark, d):
    entries = view(spark, d, "ledger")
    requests = entries.select(F.col("entry_id").alias("request_id"), "file", "agent", "at")
    p = spark.read.parquet(f"{d}/part.parquet")
    held = p.select(F.concat(F.lit("src/m"), (F.col("p_partkey") % 23).cast("string"), F.lit(".ts")).alias("file"), F.concat(F.lit("agent"), (F.col("p_partkey") % 40).cast("string")).alias("agent"), F.timestamp_add("HOUR", (F.col("p_partkey") % 700).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("expires_at"))
    return claims.conflicts(requests, held, entries.select("file", "agent", "task", "at"), claim_hours=2)


@query("u01_expiry", "select event_id, strftime(case event_id % 4 when 0 then ts + interval 30 minutes when 1 then ts + interval 3 hours when 2 then ts + interval 2 days else ts + interval 2 hours end, '%Y-%m-%d %H:%M:%S.%f') as expires from events")
def _(spark, d):
    duration = F.element_at(F.array(F.lit("30m"), F.lit("3h"), F.lit("2d"), F.lit("soon")), (F.col("event_id") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", _moment(claims.expiry(duration, F.col("ts"))).alias("expires"))


def _scope_events(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "claim_events")
    op = F.when(F.col("op") == "release", "complete").when((F.col("op") == "extend") & (F.col("op_id") % 2 == 0), "renew").otherwise("claim")
    files = F.array("file", F.concat(F.lit("src/x"), (F.col("op_id") % 9).cast("string")))
    return e.select("op_id", "root", "agent", op.alias("op"), files.alias("files"), F.array(F.concat(F.lit("d"), (F.col("op_id") % 4).cast("string"))).alias("deps"), F.when(F.col("op_id") % 11 == 0, F.col("op_id") - 1).otherwise(F.lit(-1)).alias("parent"), "at")


@query("i01_check_ins", f"with {_L} select agent, strftime(happened, '%Y-%m-%d %H:%M:%S.%f') as moment, strftime(lag(happened) over (partition by agent order by happened), '%Y-%m-%d %H:%M:%S.%f') as previous from l")
def _(spark, d):
    rows = coordination.check_ins(view(spark, d, "ledger"))
    return rows.select("agent", _moment("at").alias("moment"), _moment("previous").alias("previous"))


@query("i04_check_in_delta", f"with {_L}, c as (select agent, happened, lag(happened) over (partition by agent order by happened) as previous from l) select agent, strftime(happened, '%Y-%m-%d %H:%M:%S.%f') as moment, previous is null as first, case when previous is null then (select count(*) from l where l.happened <= c.happened and lower(l.agent) <> lower(c.agent)) else (select count(*) from l where l.happened <= c.happened and l.happened > c.previous) end as n from c")
def _(spark, d):
    entries = view(spark, d, "ledger")
    found = coordination.delta_counts(coordination.check_ins(entries), entries)
    return found.select("agent", _moment("at").alias("moment"), "first", "n")


@query("q02_gate", f"with {_L}, x as (select distinct entry_id % 500 as audit_id, file from l) select audit_id, count(*) as n_files, count(*) filter (file in ('src/m1.ts', 'src/m2.ts')) as n_blocked, count(*) filter (file not in (select file from l where entry_id % 100 = 7)) as n_unclaimed, count(*) filter (file in (select file from l where entry_id % 100 = 7)) as n_claimed, bool_or(file in ('src/m1.ts', 'src/m2.ts')) or count(*) filter (file not in (select file from l where entry_id % 100 = 7)) > 0 as blocked from x group by 1")
def _(spark, d):
    entries = view(spark, d, "ledger")
    records = spark.sql("select array('src/m1.ts', 'src/m2.ts') as files, 'open' as status")
    return coordination.gate(entries.select((F.col("entry_id") % 500).alias("audit_id"), "file").distinct(), records, entries.where("entry_id % 100 = 7"), strict=True)


@query("v02_symbols", f"select p_partkey as file, 'part' || p_partkey as symbol, 1 as first from part")
def _(spark, d):
    text = F.concat(F.lit("x = 1\ndef part"), F.col("p_partkey").cast("string"), F.lit("(): pass\n"))
    corpus.ship(spark)
    return diff.symbols_of_files(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("file"), text.alias("text")))


# --- T, W: telemetry -------------------------------------------------------------------

_I = f"i as ({corpus.INITS})"


@query("t01_events", f"with {_SCORES} select audit_id, score, n_findings as findings_count, coalesce((select string_agg(kind || '=' || n, ',' order by kind) from kinds k where k.audit_id = scored.audit_id), '') as kinds from scored")
def _(spark, d):
    actual = _actual(spark, d)
    found = compare.findings(actual, _scope(spark, d))
    rows = telemetry.events(found, compare.scores(found, actual))
    return rows.select("audit_id", "score", "findings_count", F.array_join(F.transform(F.map_entries("finding_kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("kinds"))


@query("t02_allowed", "select event_id, case when event_type in ('view', 'click') then event_type else 'unknown' end as kind from events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", telemetry.allowed(F.col("event_type"), ["view", "click"]).alias("kind"))


@query("w02_total", f"with {_I} select count(*) as count from i")
def _(spark, d):
    return telemetry.total(view(spark, d, "inits"))


for _name, _key in {"w03_by_os": "os", "w04_by_version": "version", "w05_by_vendors": "vendors"}.items():
    query(_name, f"with {_I} select {_key}, count(*) as count from i group by 1")(lambda spark, d, k=_key: telemetry.counts(view(spark, d, "inits"), k, by_key=k == "vendors"))


@query("w06_recent", f"with {_I} select event_id, os, version from i order by received_at desc, event_id limit 20")
def _(spark, d):
    return telemetry.recent(view(spark, d, "inits")).select("event_id", "os", "version")


@query("w07_daily", f"with {_I} select strftime(received_at, '%Y-%m-%d') as day, count(*) as count from i group by 1 order by 1 desc limit 30")
def _(spark, d):
    return telemetry.daily(view(spark, d, "inits")).select(F.col("day").cast("string").alias("day"), "count")
