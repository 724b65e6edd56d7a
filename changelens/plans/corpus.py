"""Tables of change sets, scopes, prompts, ledgers and claims, derived from the relational test tables.

Each is one SQL text that any engine with window functions and CTEs evaluates
alike; none of it uses patterns or arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import ship

_K = "cast((l_partkey + l_linenumber) % 50 as int)"
_P = "cast(l_partkey as varchar(20))"
#: Files of a change: most changes mix all kinds, some are all configuration, infrastructure, styles and so on.
_LANG = f"""case cast(l_orderkey % 16 as int)
 when 5 then case cast(l_partkey % 4 as int) when 0 then 'tsconfig.json' when 1 then '.eslintrc.js' when 2 then 'vite.config.ts' else 'jest.config.js' end
 when 6 then case cast(l_partkey % 4 as int) when 0 then 'Dockerfile' when 1 then 'docker-compose.yml' when 2 then '.github/workflows/ci.yml' else 'deploy/stack.yaml' end
 when 7 then case cast(l_partkey % 3 as int) when 0 then 'web/styles/base.css' when 1 then 'web/theme.scss' else 'web/print.less' end
 when 8 then case cast(l_partkey % 5 as int) when 0 then 'prisma/schema.prisma' when 1 then 'app/models/user.py' when 2 then 'src/order.model.ts' when 3 then 'README.md' else 'migrations/' || {_P} || '.sql' end
 when 9 then case cast(l_partkey % 5 as int) when 0 then 'Cargo.toml' when 1 then 'Gemfile' when 2 then 'go.mod' when 3 then 'package-lock.json' else 'package.json' end
 when 10 then case cast(l_partkey % 5 as int) when 0 then 'src/middleware/session.ts' when 1 then 'lib/auth.py' when 2 then 'src/guard.ts' when 3 then 'docs/api.md' else 'web/Card.tsx' end
 when 11 then case cast(l_partkey % 4 as int) when 0 then 'src/a' || {_P} || '.test.ts' when 1 then 'tests/test_x.py' when 2 then 'src/types.d.ts' else 'cmd/main.go' end
 when 12 then case cast(l_partkey % 4 as int) when 0 then 'infra/main.tf' when 1 then 'infra/template.yaml' when 2 then 'web/page.vue' else 'cmd/main.go' end
 else case cast(l_partkey % 7 as int) when 0 then 'src/mod' || cast(l_partkey % 40 as varchar(20)) || '.ts' when 1 then 'app/api/r' || cast(l_partkey % 30 as varchar(20)) || '/route.ts' when 2 then 'package.json' when 3 then 'lib/job' || cast(l_partkey % 25 as varchar(20)) || '.py' when 4 then '.env.example' when 5 then 'deploy/k' || cast(l_partkey % 9 as varchar(20)) || '.yaml' else 'requirements.txt' end end"""
_CODE = f"""case {_K}
 when 0 then '+const v = process.env.KEY_' || {_P} || ';'
 when 1 then '+KEY_' || {_P} || '=1'
 when 2 then '+import Thing' || {_P} || ' from "pkg' || cast(l_partkey % 50 as varchar(20)) || '"'
 when 3 then '+app.get("/api/v' || {_P} || '/items", h)'
 when 4 then '+cron.schedule("0 * * * *", job' || {_P} || ')'
 when 5 then '+server.listen(' || cast(3000 + l_partkey % 5000 as varchar(20)) || ')'
 when 6 then '+export function handler' || {_P} || '() {{'
 when 7 then '+  "dep' || {_P} || '": "^1.2.3",'
 when 8 then '+// TODO process.env.HIDDEN_' || {_P}
 when 9 then '-function old' || {_P} || '() {{ return 1 }}'
 when 10 then '+function fresh' || {_P} || '() {{ return 1 }}'
 when 11 then '+class Part' || {_P} || ':'
 when 12 then '+lib' || {_P} || '==2.0'
 when 13 then '+kind: Deployment'
 when 14 then '+os.environ["TOKEN_' || {_P} || '"]'
 when 15 then '+process.on("exit' || cast(l_partkey % 5 as varchar(20)) || '", f)'
 when 16 then '+import module' || {_P} || '.sub'
 when 17 then '+CREATE TABLE billing.t' || {_P} || ' (id int)'
 when 18 then '+const fn' || {_P} || ' = (a) => a'
 when 19 then '+const obj' || {_P} || ' = {{}}'
 when 20 then '+bus.listen("topic' || {_P} || '")'
 when 21 then '+fetch("/p' || {_P} || '?q=1")'
 when 22 then '+setInterval(tick, ' || {_P} || ')'
 when 23 then '+const x = require("left' || cast(l_partkey % 60 as varchar(20)) || '")'
 when 24 then '+  "alias": "npm:real' || {_P} || '@1",'
 when 25 then '+password = "abcdefgh' || {_P} || '"'
 when 26 then '+export const LIMIT' || {_P} || ' = 5'
 when 28 then '+  "example.com/mod' || {_P} || '"'
 when 29 then '+  tool "example.org/kit' || {_P} || '/v2"'
 when 30 then '+resource "store_bucket' || {_P} || '" "main"'
 when 31 then '+  Type: AWS::Queue::Q' || {_P}
 when 32 then '+gem "jewel' || {_P} || '"'
 when 33 then '+crate' || {_P} || ' = "1.0"'
 when 34 then '+  example.com/go' || {_P} || ' v1.2.3'
 when 35 then '+cfg = os.getenv("CFG_' || {_P} || '")'
 when 36 then '+const u = import.meta.env.VITE_' || {_P}
 when 37 then '+Deno.env.get("DENO_' || {_P} || '")'
 when 38 then '+const b = Bun.env.BUN_' || {_P}
 when 39 then '+v := os.Getenv("GO_' || {_P} || '")'
 when 40 then '+process.env["SET_' || {_P} || '"]'
 when 41 then '+os.environ.get("OPT_' || {_P} || '")'
 when 42 then '+@app.post("/deco/' || {_P} || '")'
 when 43 then '+app.use("/mount' || {_P} || '", r)'
 when 44 then '+model Item' || {_P} || ' {{'
 when 45 then '+func Run' || {_P} || '() {{'
 when 46 then '+  "dependencies": {{'
 when 47 then '+const s = new WebSocket(url)'
 when 48 then '+window.addEventListener("resize' || cast(l_partkey % 9 as varchar(20)) || '", f)'
 when 49 then '+// FIXME later ' || {_P}
 else ' context ' || {_P} end"""

_N = """n as (select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as rn from lineitem)"""

#: Lines of a change besides its number: condition, place in the group of four, text.
_SLOTS = [
    ("rn = 1 or l_partkey % 3 = 0", 0, f"case when l_partkey % 5 = 0 then 'new file mode 100644' when l_partkey % 5 = 1 then 'index ' || {_P} else ' keep' end"),
    ("rn = 1 or l_partkey % 3 = 0", 1, f"case when l_partkey % 4 = 0 then '--- /dev/null' else '--- a/' || {_LANG} end"),
    ("rn > 1 and l_partkey % 3 = 0 or rn = 1 and l_partkey % 11 <> 0", 2, f"'+++ b/' || {_LANG}"),
    ("true", 3, _CODE),
]
#: Changes of one supplier with hundreds of lines in a file, and a few in another.
_BIG = "select -l_suppkey as audit_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as rn, l_partkey from lineitem where l_suppkey % 10 = 3"
_BIG_LINE = f"case when rn = 1 then '+++ b/lib/tidy.py' when rn = 2 then '+import base' when rn = 3 then 'new file mode 100644' when rn = 4 then '--- /dev/null' when rn = 5 then '+++ b/src/big' || cast(-audit_id as varchar(20)) || '.ts' else '+  total += ' || {_P} end"

#: (audit_id, line_no, raw): three slots per line item, two for headers.
LINES = " union all ".join(f"select l_orderkey as audit_id, rn * 4 + {k} as line_no, {raw} as raw from ({_N[len('n as (') : -1]}) n{k} where {where}" for where, k, raw in _SLOTS) + f" union all select audit_id, rn as line_no, {_BIG_LINE} as raw from ({_BIG}) big"
#: The same in one pass over the numbered lines, for Spark.
_LINES_ONCE = f"select audit_id, s.line_no, s.raw from (select l_orderkey as audit_id, explode(array_compact(array({', '.join(f'case when {where} then named_struct({chr(39)}line_no{chr(39)}, rn * 4 + {k}, {chr(39)}raw{chr(39)}, {raw}) end' for where, k, raw in _SLOTS)}))) as s from ({_N[len('n as (') : -1]}) n) union all select audit_id, rn as line_no, {_BIG_LINE} as raw from ({_BIG}) big"

#: (audit_id, field, entry, pos): what a change may add; some entries are near misses.
ENTRIES = f"""select l_orderkey as audit_id, case {_K} when 0 then 'env' when 14 then 'env' when 3 then 'endpoints' when 21 then 'endpoints' when 6 then 'features' when 18 then 'features' when 7 then 'deps' when 12 then 'deps' when 4 then 'behavioral' when 2 then 'files' else 'features' end as field,
 case {_K} when 0 then 'KEY_' || {_P} when 14 then 'token ' || {_P} when 3 then 'GET /api/v' || {_P} || '/item' when 21 then '/p' || {_P} || '/' when 6 then 'a handlr' || {_P} || ' page' when 18 then 'fn ' || {_P} when 7 then 'Dep' || {_P} when 12 then 'lib-' || {_P}
 when 4 then case when l_partkey % 2 = 0 then 'nightly run' else 'tidy up' end when 2 then case cast(l_partkey % 5 as int) when 0 then 'src' when 1 then 'src/mod' || cast(l_partkey % 40 as varchar(20)) || '.ts' when 2 then 'the deploy folder' when 3 then 'requirments' else 'lib/' end else 'part ' || {_P} end as entry, rn as pos
from ({_N[len("n as (") : -1]}) m where l_partkey % 3 = 0 or {_K} in (2, 4)"""

#: (audit_id, prompt)
PROMPTS = """select o_orderkey as audit_id, case cast(o_orderkey % 8 as int)
 when 0 then 'Add a login form to src/pages/login' || cast(o_custkey as varchar(20)) || '.tsx and use stripe. Set STRIPE_KEY_' || cast(o_custkey % 9 as varchar(20)) || ' please'
 when 1 then 'Create endpoint /api/users/' || 'list and cache results, then send email nightly'
 when 2 then 'please fix the header component; install lodash and redis'
 when 3 then 'Update app/models/order' || cast(o_custkey as varchar(20)) || ' with a retry queue'
 when 4 then 'refactor the settings page, migrate data. Use @scope/pkg for dates'
 when 5 then 'can you build a weekly report for the dashboard /reports/:id'
 when 6 then 'Remove old code'
 else 'write docs/guide' || cast(o_custkey % 5 as varchar(20)) || '.md about MAX_RETRY_COUNT and zod validation' end as prompt from orders"""

#: (entry_id, agent, task, file, score, findings_count, at, contract_id)
LEDGER = """select event_id as entry_id, 'agent' || cast(user_id % 40 as varchar(20)) as agent, event_type || ' task' as task, 'src/m' || cast(event_id % 20 as varchar(20)) || '.ts' as file,
 case when value > 80 then 'HIGH' when value > 35 then 'MEDIUM' else 'LOW' end as score, cast(floor(value) as bigint) as findings_count, ts as happened, case when event_id % 10 < 7 then 'c' || cast(event_id % 3000 as varchar(20)) end as contract_id from events"""

#: (op_id, root, file, agent, op, at): claims on files, releases, extensions
CLAIM_EVENTS = """select event_id as op_id, 'root' || cast(user_id % 5 as varchar(20)) as root, 'src/m' || cast((event_id * 7 + user_id) % 23 as varchar(20)) || '.ts' as file, 'agent' || cast(user_id % 12 as varchar(20)) as agent,
 case event_type when 'purchase' then 'release' when 'click' then 'extend' else 'claim' end as op, ts as happened from events"""

#: (id, parent_id, root_seq, item): contracts of a customer's orders, the parent the one before
CONTRACTS = """select o_orderkey as id, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as parent_id, o_custkey as owner, o_orderdate as issued_at from orders"""

#: (claim_id, agent, task, creates, modifies, deletes, deps, env_vars, routes, status, expires_at): scope claims; lists are comma-joined
CLAIMS = """select o_orderkey as claim_id, 'agent' || cast(o_custkey % 12 as varchar(20)) as agent, 'task ' || o_orderpriority as task,
 case when o_orderkey % 3 = 0 then 'src/n' || cast(o_custkey % 20 as varchar(20)) || '.ts,src/m' || cast(o_custkey % 23 as varchar(20)) || '.ts' else '' end as creates, 'src/m' || cast((o_orderkey + 1) % 23 as varchar(20)) || '.ts' as modifies, case when o_orderkey % 7 = 0 then 'old/x' || cast(o_orderkey % 5 as varchar(20)) || '.ts' else '' end as deletes,
 'lib' || cast(o_custkey % 9 as varchar(20)) as deps, case when o_orderkey % 2 = 0 then 'KEY_' || cast(o_custkey % 4 as varchar(20)) else '' end as env_vars, case when o_orderkey % 5 = 0 then '/api/a,/api/b' else '' end as routes,
 case cast(o_orderkey % 4 as int) when 0 then 'locked' when 1 then 'proposed' when 2 then 'completed' else 'rejected' end as status, o_orderdate as expires_at from orders"""

#: (conflict_id, files, agents, status, strategy, resolved_by); lists are comma-joined
CONFLICTS = """select 'c' || cast(event_id as varchar(20)) as conflict_id, 'src/m' || cast(event_id % 23 as varchar(20)) || '.ts,src/n' || cast(event_id % 20 as varchar(20)) || '.ts' as files, 'agent' || cast(user_id % 12 as varchar(20)) || ',Agent' || cast((user_id + 1) % 12 as varchar(20)) as agents,
 case when event_id % 3 = 0 then 'resolved' else 'open' end as status, case when event_id % 3 = 0 then 'block' end as strategy, case when event_id % 3 = 0 then 'lead' end as resolved_by from events"""

#: (os, version, vendors, received_at)
INITS = """select c_mktsegment as os, n_name as version, cast(event_id % 4 as int) as vendors, ts as received_at, event_id from events join customer on user_id = c_custkey join nation on c_nationkey = n_nationkey"""

_TABLES = {"lines": (LINES, ["lineitem"]), "entries": (ENTRIES, ["lineitem"]), "prompts": (PROMPTS, ["orders"]), "ledger": (LEDGER, ["events"]), "claim_events": (CLAIM_EVENTS, ["events"]), "contracts": (CONTRACTS, ["orders"]), "claims": (CLAIMS, ["orders"]), "conflicts": (CONFLICTS, ["events"]), "inits": (INITS, ["events", "customer", "nation"])}
#: Folders of derived tables that prepare() wrote, by the folder of the tables they are derived from.
_PREPARED: dict[str, str] = {}


def prepare(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the derived tables to folder; view() of sf_dir reads them from there."""
    _PREPARED.pop(sf_dir, None)
    for name in _TABLES:
        view(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    _PREPARED[sf_dir] = folder


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables over the Parquet tables in sf_dir."""
    ship(spark)
    if sf_dir in _PREPARED:
        made = spark.read.parquet(f"{_PREPARED[sf_dir]}/{name}.parquet")
    else:
        sql, tables = _TABLES[name]
        sql = (_LINES_ONCE if name == "lines" else sql).replace("{", "{{").replace("}", "}}")
        for t in tables:
            for lead in ("from", "join"):
                sql = sql.replace(f"{lead} {t}", f"{lead} {{{t}}}")
        made = spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
        if "happened" in made.columns:  # a reserved word in some dialects
            made = made.withColumnRenamed("happened", "at")
    # the exchange that every later window, aggregate and join on audit_id uses; it also keeps the long expressions of the corpus out of the operators' stages
    return made.repartition("audit_id") if name in ("lines", "entries", "prompts") else made


def sql(name: str) -> str:
    return _TABLES[name][0]
