"""Expressions on text: normal forms, match predicates, and extractors of one line of code.

Everything here builds Columns from Columns, so all of it stays in the JVM; the
one exception is `osa`, an Arrow function for distances above 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from . import fixed as X


def first_match(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, which is never empty; null if none does."""
    return F.coalesce(*[F.get(F.regexp_extract_all(text, F.lit(p), 1), F.lit(0)) for p in patterns])


def gated(found: Column, gate: Column) -> Column:
    """found where a cheap test holds, which it does wherever found is not null."""
    return F.when(gate, found)


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(s: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def has(a: Column, b: Column) -> Column:
    return F.contains(a, b)


def shares(a: Column, b: Column, k: Column) -> Column:
    """Whether some substring of k characters of a occurs in b: the longest common substring is k or more."""
    starts = F.when(F.length(a) >= k, F.sequence(F.lit(1), F.length(a) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: has(b, F.substring(a, i, k)))


def fuzzy_norm(a: Column, b: Column) -> Column:
    """fuzzy() on normal forms."""
    k = F.greatest(F.lit(5), F.ceil(F.least(F.length(a), F.length(b)) * F.lit(0.6)).cast("int"))
    return (a != "") & (b != "") & (has(a, b) | has(b, a) | let(k, lambda n: shares(a, b, n)))


def fuzzy(a: Column, b: Column) -> Column:
    """Equal or contained normal forms, or a common substring of 5 characters and 60 % of the shorter."""
    return let(norm(a), lambda x: let(norm(b), lambda y: fuzzy_norm(x, y)))


def osa_one(a: Column, b: Column) -> Column:
    """Whether optimal string alignment is 1 at most: an edit, or one swap of neighbours."""
    n = F.length(a)
    places = F.when((n == F.length(b)) & (n >= 2), F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b

    # a swap is two substitutions, so only pairs at a plain distance of 2 are looked at
    return let(F.levenshtein(a, b, 2), lambda d: d.between(0, 1) | ((d == 2) & F.exists(places, swapped)))


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment; 99 where lengths differ by more than 2."""
    if abs(len(a) - len(b)) > 2 and a and b:
        return 99
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(old[j] + 1, now[j - 1] + 1, old[j - 1] + (x != y))
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            now.append(cost)
        older, old = old, now
    return old[-1]


@pandas_udf(IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def osa_two(a: Column, b: Column) -> Column:
    """Whether optimal string alignment is 2 at most.

    An alignment of two steps is plain edits, or an edit and a swap in either
    order, or two swaps; a swap is a substitution pair for levenshtein, so only
    pairs within 4 edits and 2 characters of length are looked at, on every
    string one swap away.
    """
    n = F.length(a)
    places = F.when((n >= 2) & (F.abs(n - F.length(b)) <= 1), F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def swap(s: Column, i: Column) -> Column:
        return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.lit(1)), F.substring(s, i, F.lit(1)), F.substring(s, i + 2, F.length(s)))

    # a swap of neighbours that are one apart after an insertion between them counts more than 2, as the alignment never edits inside a swap
    def near(i: Column) -> Column:
        left, right = F.substring(a, F.lit(1), i - 1), F.substring(a, i + 2, n)
        pair = F.concat(F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)))
        at = F.sequence(F.greatest(F.lit(1), i - 1), i + 1)
        return F.exists(at, lambda j: (F.substring(b, j, F.lit(2)) == pair) & (F.length(pair) == 2) & ((_within(left, F.substring(b, F.lit(1), j - 1)) + _within(right, F.substring(b, j + 2, F.length(b)))) <= 1))

    return let(F.levenshtein(a, b, 4), lambda d: d.between(0, 2) | ((d > 2) & F.exists(places, near)))


def _within(a: Column, b: Column) -> Column:
    """Alignment of 0 or 1, 9 beyond."""
    return F.when(a == b, F.lit(0)).when(osa_one(a, b), F.lit(1)).otherwise(F.lit(9))


def typo(scope_token: Column, actual_token: Column) -> Column:
    """A scope token that is no common word, one edit from the actual one (two from 7 characters on)."""
    common = F.array(*map(F.lit, X.COMMON_WORDS))

    def close(x: Column, y: Column) -> Column:
        short = F.least(F.length(x), F.length(y))
        far = F.when(short >= 7, osa_two(x, y)).otherwise(osa_one(x, y))
        return (x != "") & (y != "") & ((x == y) | ((short >= 4) & (F.abs(F.length(x) - F.length(y)) <= 2) & far & ~F.array_contains(common, x)))

    return let(norm(scope_token), lambda x: let(norm(actual_token), lambda y: close(x, y)))


def symbol_in_norm(symbol: Column, entry: Column) -> Column:
    """On normal forms: contained, or from 5 characters on within one edit of some substring."""
    n = F.length(symbol)
    sizes = F.array(n - 1, n, n + 1)

    def near(w: Column) -> Column:
        starts = F.when(F.length(entry) >= w, F.sequence(F.lit(1), F.length(entry) - w + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: osa_one(symbol, F.substring(entry, i, w)))

    return (symbol != "") & (entry != "") & (has(entry, symbol) | ((n >= 5) & F.exists(sizes, near)))


def norm_endpoint(s: Column) -> Column:
    s = F.regexp_replace(F.lower(s), X.EP_VERBS, "")
    s = F.regexp_replace(s, X.EP_PARAM, "<param>")
    return F.regexp_replace(F.regexp_replace(s, r"\?.*$", ""), r"/+$", "")


def endpoint_candidates(s: Column) -> Column:
    path = F.regexp_extract(s, "(" + X.EP_PATH + ")", 1)
    return F.array_remove(F.array_distinct(F.array(norm_endpoint(s), norm_endpoint(path))), "")


def endpoint_matches(a: Column, b: Column) -> Column:
    """On normal forms: equal, or of lengths within 1.3 with 80 % of the shorter in common."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (a != "") & ((a == b) | ((high / low <= 1.3) & shares(a, b, F.floor(low * F.lit(0.8)).cast("int"))))


def member_exact(item: Column, allowed: Column) -> Column:
    return F.exists(allowed, lambda a: (F.lower(a) == F.lower(item)) | fuzzy(item, a))


def member_path(item: Column, allowed: Column) -> Column:
    """Whether an allowed entry covers a file: as a path if both look like one, else by words."""
    i = F.lower(item)
    segments = F.split(i, "[/.]")

    def covers(a: Column) -> Column:
        al = F.lower(a)
        both = (has(al, F.lit("/")) | has(al, F.lit("."))) & has(i, F.lit("/"))
        folder = F.concat(F.regexp_replace(al, "/+$", ""), F.lit("/"))
        path = (i == al) | F.endswith(i, F.concat(F.lit("/"), al)) | F.endswith(al, F.concat(F.lit("/"), i)) | (~al.rlike(r"\.\w+$") & F.startswith(i, folder))
        tokens = F.filter(F.split(al, "[^a-z0-9]+"), lambda t: F.length(t) >= 4)
        loose = has(i, al) | has(al, i) | F.array_contains(segments, al) | F.exists(tokens, lambda t: F.exists(segments, lambda s: has(s, t) | typo(t, s))) | fuzzy(item, a)
        return F.when(both, path).otherwise(loose)

    return F.exists(allowed, covers)


def any_match(s: Column, patterns: list[str]) -> Column:
    found = s.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | s.rlike(p)
    return found


def support_file(path: Column) -> Column:
    return any_match(path, X.SUPPORT_FILES)


# --- extractors: the line of code, where needed the file --------------------


def is_comment(code: Column) -> Column:
    return code.rlike(X.COMMENT)


def go_import(code: Column) -> Column:
    found = let(first_match(code, X.GO_IMPORT), lambda f: F.when(has(f, F.lit(".")), f))
    return gated(found, code.rlike(r'"\s*$') & has(code, F.lit(".")))


def python_import(code: Column) -> Column:
    return gated(F.nullif(F.split_part(first_match(code, X.PY_IMPORT), F.lit("."), F.lit(1)), F.lit("")), has(code, F.lit("import")) | has(code, F.lit("from")))


def script_import(code: Column) -> Column:
    return gated(first_match(code, X.TS_IMPORT), has(code, F.lit("import")) | has(code, F.lit("require")))


def env(code: Column) -> Column:
    return gated(first_match(code, X.ENV), has(code, F.lit("env")))


def dotenv(code: Column, file: Column) -> Column:
    return F.when((file != "") & has(code, F.lit("=")) & file.rlike(X.DOTENV_FILE), first_match(code, [X.DOTENV]))


def endpoint(code: Column) -> Column:
    def path(pattern: str, others: bool) -> Column:
        test = lambda s: F.startswith(s, F.lit("/")) | has(F.lower(s), F.lit("api")) if others else F.startswith(s, F.lit("/"))
        return let(first_match(code, [pattern]), lambda s: F.when(test(s), s))

    found = F.coalesce(first_match(code, [X.EP_DECORATOR]), path(X.EP_VERB, True), path(X.EP_MOUNT, True), path(X.EP_FETCH, False))
    return gated(found, has(code, F.lit("(")) & code.rlike(r"(?:get|post|put|delete|patch|route|use|fetch)\("))


def route_of_file(file: Column) -> Column:
    found = first_match(file, [X.ROUTE_FILE])
    return gated(F.concat(F.lit("/"), F.regexp_replace(found, "/+$", "")), has(file, F.lit("/route.")))


def cron(code: Column) -> Column:
    hint = has(code, F.lit("cron")) | has(code, F.lit("Cron")) | has(code, F.lit("sched")) | has(code, F.lit("Sched")) | has(code, F.lit("setInterval"))
    return F.when(hint & code.rlike(X.CRON), F.substring(F.trim(code), 1, 40))


def listener(code: Column) -> Column:
    receiver, argument = F.regexp_extract(code, X.LISTEN, 1), F.trim(F.regexp_extract(code, X.LISTEN, 2))
    port = let(first_match(argument, [r"(\d{2,5})"]), lambda p: F.when(p.isNotNull(), F.concat(F.lit("listen(:"), p, F.lit(")"))).when(receiver.isin(X.LISTEN_RECEIVERS), F.lit("listen()")))

    def event(pattern: str, lead: str) -> Column:
        return F.concat(F.lit(f"{lead}('"), first_match(code, [pattern]), F.lit("')"))

    rest = F.coalesce(F.when(code.rlike(X.SERVER), F.lit("server()")), gated(event(X.PROCESS_ON, "process.on"), has(code, F.lit("process."))), gated(event(X.GLOBAL_ON, "addEventListener"), has(code, F.lit("EventListener"))))
    found = F.when(has(code, F.lit(".listen")) & code.rlike(X.LISTEN), port).otherwise(rest)
    return gated(found, has(code, F.lit("(")) & (has(code, F.lit("isten")) | has(code, F.lit("new")) | has(code, F.lit("process."))))


def symbol(code: Column) -> Column:
    found = let(first_match(code, X.SYMBOL), lambda f: F.when(~f.isin(X.HTTP_VERBS), f))
    return gated(found, code.rlike(r"^\s*(?:async|def|class|export|function|const|let|var|model|func)\s"))


def shape(code: Column) -> Column:
    """A declaration with its name blanked; null for other lines."""
    return F.when(code.rlike(X.SHAPE), F.regexp_replace(code, X.SHAPE, r"$1\{SYM\}"))


def infrastructure(code: Column, file: Column) -> Column:
    kind, cloud = let(first_match(code, [X.K8S]), lambda k: F.when(k.isin(X.K8S_KINDS), F.concat(F.lit("k8s:"), k))), first_match(code, [X.CLOUDFORMATION])
    yaml = F.when(file.rlike(X.YAML), F.coalesce(kind, cloud))
    terraform, ddl = gated(first_match(code, [X.TERRAFORM]), has(code, F.lit("resource"))), gated(first_match(code, [X.DDL]), has(F.lower(code), F.lit("table")))
    return F.when(file != "", F.coalesce(terraform, ddl, gated(yaml, has(code, F.lit(":")))))


def dependency(code: Column, file: Column) -> Column:
    package = let(first_match(code, [X.PACKAGE_DEP]), lambda n: F.when(~n.isin(X.PACKAGE_KEYS), n))
    cargo = let(first_match(code, [X.CARGO_DEP]), lambda n: F.when(~n.isin(X.CARGO_KEYS), n))
    found = (
        F.when(file.rlike(X.PACKAGE_FILE), F.coalesce(package, first_match(code, [X.PACKAGE_ALIAS])))
        .when(file.rlike(X.PYTHON_FILE), first_match(code, [X.PYTHON_DEP]))
        .when(file.rlike(X.GEM_FILE), first_match(code, [X.GEM_DEP]))
        .when(file.rlike(X.CARGO_FILE), cargo)
        .when(file.rlike(X.GOMOD_FILE), first_match(code, [X.GOMOD_DEP]))
    )
    return gated(found, file.rlike(r"(?i)(?:json|txt|gemspec|gemfile|toml|go\.mod)$"))
