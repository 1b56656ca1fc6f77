"""Query registry and the SQL fragments shared by the comparison statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavelane.functions.numeric import ROUND_OFFSET

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the DuckDB statement that must give the same rows."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def fx(expression: str, digits: int = 6) -> str:
    """SQL twin of ``numeric.fix``."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expression}) * {scale} + {ROUND_OFFSET}::DOUBLE) / {scale})"


def hu(expression: str) -> str:
    """SQL twin of ``hashing.hash_uniform`` for one text expression."""
    return f"(('0x' || substr(sha256({expression}),1,13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def hx(expression: str, digits: int) -> str:
    """Leading hex digits of a digest expression as BIGINT."""
    return f"('0x' || substr({expression},1,{digits}))::BIGINT"


def mixed(x: str) -> str:
    """SQL twin of ``bootstrap.mix``."""
    for _ in range(2):
        x = f"((xor(({x}) >> 16, ({x})) * 73244475) % 4294967296)"
    return f"xor(({x}) >> 16, ({x}))"


def with_ctes(*names: str, body: str) -> str:
    """A statement with the named adapters in front, each with what it needs."""
    from wavelane.plans.adapters import SQL

    ordered: list[str] = []

    def add(name: str) -> None:
        for other in SQL:
            if other != name and other not in ordered and f" {other} " in SQL[name].replace("\n", " ") + " ":
                add(other)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    rest = body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[15:]}"
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"


def boot_sql(src: str, keys: list[str], cluster: str, sums: list[str], count: str, seed: int, replicates: int, label: list[str] | None = None) -> str:
    """CTE text (starting at WITH) giving ``ci``: the SQL twin of ``bootstrap.percentile_ci``."""
    from wavelane.functions.bootstrap import POISSON

    k = ", ".join(keys)
    label = keys if label is None else label
    text = " || ':' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in label)
    chain = f"""bst AS (SELECT *, {mixed(hx(f"sha256('{seed}:' || {text})", 8))} AS s1, {hx(f"sha256(coalesce(CAST({cluster} AS VARCHAR), ''))", 8)} AS spot FROM bsrc),
brs AS (SELECT DISTINCT s1, rep, {mixed("((s1 + rep) % 4294967296)")} AS s2 FROM (SELECT DISTINCT s1 FROM bst), range({replicates}) t(rep)),
bx0 AS (SELECT bst.*, rep, (s2 + spot) % 4294967296 AS x FROM bst JOIN brs USING (s1)),
bx1 AS (SELECT * REPLACE ((xor(x >> 16, x) * 73244475) % 4294967296 AS x) FROM bx0),
bx2 AS (SELECT * REPLACE ((xor(x >> 16, x) * 73244475) % 4294967296 AS x) FROM bx1),
bx3 AS (SELECT * REPLACE (xor(x >> 16, x) AS x) FROM bx2),
bdr AS (SELECT *, {" + ".join(f"CAST(x >= {t} AS INT)" for t in POISSON)} AS w FROM bx3)"""
    sums_rep = ", ".join(f"sum(w * coalesce({s}, 0)::DOUBLE) / nullif(sum(w * {count}), 0) AS {s}" for s in sums)
    lo = ", ".join(f"quantile_cont({s}, 0.025) AS {s}_q1, quantile_cont({s}, 0.975) AS {s}_q2" for s in sums)
    mean = ", ".join(f"sum({s})::DOUBLE / sum({count}) AS {s}_mean" for s in sums)
    final = ", ".join(
        f"{s}_mean, CASE WHEN clusters = 1 THEN {s}_mean ELSE {s}_q1 END AS {s}_lo, CASE WHEN clusters = 1 THEN {s}_mean ELSE {s}_q2 END AS {s}_hi"
        for s in sums
    )
    return f"""bsrc AS ({src}),
{chain},
brep AS (SELECT {k}, rep, {sums_rep} FROM bdr GROUP BY {k}, rep),
bq AS (SELECT {k}, {lo} FROM brep GROUP BY {k}),
bpt AS (SELECT {k}, count(*) AS clusters, {mean} FROM bsrc GROUP BY {k}),
ci AS (SELECT {k}, clusters, {final} FROM bpt JOIN bq USING ({k}))"""
