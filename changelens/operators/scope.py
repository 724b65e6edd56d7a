"""Authorised scope from prompts without a model, and the set operations on scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from .compare import FIELDS

SCOPE_JSON = "struct<files_allowed: array<string>, features_allowed: array<string>, endpoints_allowed: array<string>, deps_allowed: array<string>, env_allowed: array<string>, behavioral_changes_allowed: array<string>>"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _in(words: list[str], w: Column) -> Column:
    return w.isin(words)


def phrases(text: Column) -> Column:
    """What is left of a prompt, as phrases without filler."""
    clauses = F.filter(F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), "[.;,\n]+"), F.trim), lambda c: F.length(c) > 3)

    def clean(c: Column) -> Column:
        c = F.regexp_replace(F.regexp_replace(c, X.PHRASE_LEAD, ""), X.PHRASE_TAIL, "")
        c = F.regexp_replace(F.regexp_replace(c, X.PHRASE_PAIRS, " "), r"\s*/\s*", " ")
        return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    kept = F.filter(F.transform(clauses, clean), lambda c: (F.length(c) >= 4) & (F.size(F.split(c, r"\s+")) <= 8) & ~_in(X.PHRASE_NOTHING, c))
    meaning = F.transform(kept, lambda c: F.array_join(F.filter(F.split(c, r"\s+"), lambda w: (F.length(w) > 1) & ~_in(X.PHRASE_STOP, w)), " "))
    return F.array_distinct(F.filter(meaning, lambda c: c != ""))


def extract(prompts: DataFrame) -> DataFrame:
    """(audit_id, files, features, endpoints, deps, env, behavioral) of (audit_id, prompt); null prompts have empty arrays."""
    p = F.coalesce("prompt", F.lit(""))
    endpoints = F.array_distinct(F.filter(F.transform(_all(p, X.PROMPT_ENDPOINT), F.trim), lambda e: (F.length(e) > 1) & ~e.rlike("^/[a-z]$")))
    rows = prompts.select("audit_id", p.alias("p"), endpoints.alias("endpoints"))
    files = F.array_distinct(F.concat(_all(F.col("p"), X.PROMPT_FILE_EXT, 0), _all(F.col("p"), X.PROMPT_FILE_DIR, 0)))
    files = F.filter(files, lambda f: ~F.array_contains("endpoints", f) & ~F.array_contains("endpoints", F.concat(F.lit("/"), f)))
    env = F.array_distinct(F.filter(_all(F.col("p"), X.PROMPT_ENV), lambda v: F.length(v) >= 4))
    signalled = F.filter(F.transform(_all(F.col("p"), X.PROMPT_DEP), F.lower), lambda d: (F.length(d) >= 2) & ~_in(X.PROMPT_NOT_DEPS, d))
    known = F.filter(F.split(F.lower("p"), "[^a-z0-9@._/-]+"), lambda w: _in(X.KNOWN_PACKAGES, w))
    scheduled = F.transform(_all(F.col("p"), X.PROMPT_CRON), lambda c: F.concat(c, F.lit(" (scheduled task)")))
    signals = F.array_distinct(F.transform(_all(F.col("p"), X.PROMPT_BEHAVIOR), F.lower))
    behavioral = F.aggregate(signals, scheduled, lambda have, b: F.when(F.exists(have, lambda h: F.contains(h, b)), have).otherwise(F.array_append(have, b)))
    rest = F.col("p")
    for pattern, by in ((X.PROMPT_FILE_EXT, ""), (X.PROMPT_FILE_DIR, ""), (X.PROMPT_ENDPOINT, " "), (X.PROMPT_ENV, ""), (X.PROMPT_DEP, ""), (X.PROMPT_CRON, ""), (X.PROMPT_BEHAVIOR, "")):
        rest = F.regexp_replace(rest, pattern, by)
    return rows.select("audit_id", files.alias("files"), phrases(rest).alias("features"), "endpoints", F.array_distinct(F.concat(signalled, known)).alias("deps"), env.alias("env"), behavioral.alias("behavioral"))


def entries(scopes: DataFrame) -> DataFrame:
    """(audit_id, field, entry, pos) of rows of arrays."""
    found = F.concat(*[_entries(f) for f in FIELDS])
    return scopes.select("audit_id", F.explode(found).alias("e")).select("audit_id", "e.field", "e.entry", "e.pos")


def _entries(field: str) -> Column:
    return F.transform(field, lambda e, i: F.struct(F.lit(field).alias("field"), e.alias("entry"), i.alias("pos")))


def merged(long: DataFrame) -> DataFrame:
    """Entries of all sections of an audit, (audit_id, field, entry, pos): the first of each normal form, without those that another entry of the field contains."""
    by = Window.partitionBy("audit_id", "field", "n").orderBy("pos")
    first = long.withColumn("n", T.norm(F.col("entry"))).where("n != ''").withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")
    sets = first.groupBy("audit_id", "field").agg(F.array_sort(F.collect_list(F.struct("pos", "entry", "n"))).alias("e"))
    keep = F.filter("e", lambda a: ~F.exists("e", lambda b: F.contains(b["n"], a["n"]) & (F.length(b["n"]) > F.length(a["n"]))))
    return sets.select("audit_id", "field", F.explode(keep).alias("x")).select("audit_id", "field", "x.entry", "x.pos")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(audit_id, field, entry, change): entries that b adds to a, and that it removes, by normal form."""
    a, b = (x.select("audit_id", "field", "entry", T.norm(F.col("entry")).alias("n")) for x in (a, b))
    key = ["audit_id", "field", "n"]
    added, removed = b.join(a.select(*key), key, "left_anti").withColumn("change", F.lit("added")), a.join(b.select(*key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select("audit_id", "field", "entry", "change").distinct()


def chunks(prompts: DataFrame, most: int = 600) -> DataFrame:
    """(audit_id, chunk, text): paragraphs, else sentences, else pieces of `most` characters, packed greedily.

    In a paragraph longer than `most`, a last sentence that ends in a mark and
    no white space is lost, as the sentence pattern wants white space after it.
    """
    text = F.trim(F.regexp_replace(F.col("prompt"), r"^\s+|\s+$", ""))
    paragraphs = F.filter(F.transform(F.split("t", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def hard(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, i * most + 1, F.lit(most)))

    def sentences(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit(X.SENTENCES), 0)
        found = F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(p)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
        return F.flatten(F.transform(F.filter(found, lambda s: s != ""), lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(hard(s))))

    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(sentences(p))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(have: Column, s: Column) -> Column:
        fits = F.length(have["now"]) + F.length(s) + 1 <= most
        done = F.when(fits | (have["now"] == ""), have["done"]).otherwise(F.array_append(have["done"], have["now"]))
        return F.struct(done.alias("done"), F.when(fits & (have["now"] != ""), F.concat(have["now"], F.lit(" "), s)).otherwise(s).alias("now"))

    packed = F.aggregate(parts, start, step, lambda h: F.when(h["now"] == "", h["done"]).otherwise(F.array_append(h["done"], h["now"])))
    whole = F.when((F.length("t") <= most) | (F.size("packed") == 0), F.array("t")).otherwise(F.col("packed"))
    return prompts.select("audit_id", text.alias("t")).withColumn("packed", packed).select("audit_id", F.posexplode(whole).alias("chunk", "text"))


def with_replies(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Scopes of prompts (audit_id, prompt) from stored replies (audit_id, section, reply) of a model, with fell_back.

    The sections of a reply that parse are merged in order, entries once each;
    where none does, or there is no reply, the scope is extracted by patterns.
    """
    parsed = parse_json(replies).where("scope is not null")
    names = {"files_allowed": "files", "features_allowed": "features", "endpoints_allowed": "endpoints", "deps_allowed": "deps", "env_allowed": "env", "behavioral_changes_allowed": "behavioral"}
    parts = parsed.groupBy("audit_id").agg(F.array_sort(F.collect_list(F.struct("section", "scope"))).alias("parts"))
    told = parts.select("audit_id", F.struct(*[F.array_distinct(F.flatten(F.transform("parts", _field(k)))).alias(n) for k, n in names.items()]).alias("told"))
    rows = extract(prompts).join(told, "audit_id", "left")
    return rows.select("audit_id", *[F.coalesce(F.col(f"told.{f}"), F.col(f)).alias(f) for f in FIELDS], F.col("told").isNull().alias("fell_back"))


def _field(name: str):
    return lambda s: s["scope"][name]


def parse_json(replies: DataFrame, text: str = "reply") -> DataFrame:
    """replies with a column scope from a JSON reply, fenced or not, wrapped in {"scope": ...} or not; null where there is no object."""
    t = F.regexp_replace(F.regexp_replace(F.col(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    t = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    names = ["files_allowed", "features_allowed", "endpoints_allowed", "deps_allowed", "env_allowed", "behavioral_changes_allowed"]

    def field(name: str) -> Column:
        raw = F.coalesce(F.get_json_object(t, f"$.scope.{name}"), F.get_json_object(t, f"$.{name}"))
        return F.filter(F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")), lambda s: s.isNotNull() & (s != "")).alias(name)

    valid = F.get_json_object(t, "$").isNotNull()
    return replies.withColumn("scope", F.when(valid, F.struct(*[field(n) for n in names])))


def of_claims(claims: DataFrame) -> DataFrame:
    """Scopes of declared claims: columns create, modify, delete, dependencies, env_vars, api_routes become the six fields."""
    none = F.array().cast("array<string>")
    c = lambda n: F.coalesce(n, none)
    return claims.select("claim_id", F.concat(c("create"), c("modify"), c("delete")).alias("files"), none.alias("features"), c("api_routes").alias("endpoints"), c("dependencies").alias("deps"), c("env_vars").alias("env"), none.alias("behavioral"))
