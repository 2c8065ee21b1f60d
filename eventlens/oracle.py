"""SQL fragments for the oracle, generated from the same fixed values as the columns."""

from __future__ import annotations

from eventlens.functions import outcomes as o
from eventlens.functions import taxonomy as t


def lookup(column: str, pairs, default) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs) + f" ELSE {quote(default)} END"


def any_of(text: str, markers) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, m.replace("'", "''")) for m in markers) + ")"


def inferred(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(text, ms)} THEN '{name}'" for name, ms in t.MARKERS) + " END"


def family(kind: str, title: str) -> str:
    """The explicit type unless the title tells of one of higher priority; kinds here are all known ones."""
    found = inferred(f"lower({title})")
    rank = lambda x: f"CASE WHEN {x} IS NULL THEN -1 ELSE {lookup(x, t.PRIORITY.items(), 0)} END"
    return f"CASE WHEN {rank(f'({found})')} > {rank(kind)} THEN ({found}) ELSE {kind} END"


def bucket(kind: str) -> str:
    return f"CASE WHEN {kind} IS NULL THEN 'none' ELSE {lookup(kind, t.BUCKET.items(), 'other')} END"


def synthetic(status: str, title: str) -> str:
    return f"(lower({status}) IN {t.SYNTHETIC_STATUSES} OR {any_of(f'lower({title})', t.SYNTHETIC_TITLES)})"


def exact(status: str, title: str) -> str:
    return f"(lower({status}) IN {t.EXACT_STATUSES} OR NOT {synthetic(status, title)})"


def outcome(kind: str, group: str, title: str, status: str) -> str:
    text = f"lower({title} || ' ' || {status} || ' ')"
    decisive = (*o.CLINICAL_GOOD, *o.CLINICAL_BAD, *o.SAFETY_BAD, *o.DECISION_GOOD, *o.DECISION_BAD, *o.PROGRESS_GOOD, *o.PANEL_GOOD, *o.PANEL_BAD)
    pick = lambda bad, good: f"CASE WHEN {any_of(text, bad)} THEN 0 WHEN {any_of(text, good)} THEN 1"
    return (
        f"CASE WHEN {group} NOT IN ('clinical', 'regulatory') THEN NULL WHEN {any_of(text, o.MIXED)} AND NOT {any_of(text, decisive)} THEN NULL"
        f" WHEN {any_of(text, o.SAFETY_BAD)} THEN 0 WHEN {group} = 'clinical' THEN {pick(o.CLINICAL_BAD, o.CLINICAL_GOOD)} END"
        f" WHEN {kind} = 'adcom' THEN {pick(o.PANEL_BAD, o.PANEL_GOOD)} END"
        f" ELSE {pick(o.DECISION_BAD, o.DECISION_GOOD)} WHEN {kind} = 'regulatory_update' AND {any_of(text, o.PROGRESS_GOOD)} THEN 1 END END"
    )


def greedy(source: str, key: str, order: str, start: str, end: str) -> str:
    """Recursive CTEs ``kept(key columns, rn)`` over ``source``: greedy non-overlap in order."""
    keys = [k.strip() for k in key.split(",")]
    same = " AND ".join(f"o.{k} = k.{k}" for k in keys)
    on = ", ".join(f"k.{k}" for k in keys)
    return f"""ordered AS MATERIALIZED (SELECT *, {start} AS s, {end} AS e, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}),
kept AS (
  SELECT {key}, rn, e FROM ordered WHERE rn = 1
  UNION ALL
  SELECT {', '.join(f'o.{k}' for k in keys)}, o.rn, o.e FROM ordered o JOIN (
    SELECT {on}, min(o.rn) AS rn FROM kept k JOIN ordered o ON {same} AND o.rn > k.rn AND o.s > k.e GROUP BY {on}) k ON {same} AND o.rn = k.rn)"""


def ridge(name: str, source: str, dates: str, features: list[str], target: str, alpha: float) -> str:
    """CTEs ending in ``name`` (d, bias, b0, b1, ...): ridge lines by elimination. ``dates`` has d, ``source`` the training rows of each d (null target: none)."""
    p = len(features)
    x = [f"coalesce({f}, 0.0)" for f in features] + [target]
    pair = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    out = [f"{name}_s AS (SELECT {dates}.d, count({target}) AS n, {', '.join(f'sum({c}) AS s{i}' for i, c in enumerate(x))}, {', '.join(f'sum({x[i]} * {x[j]}) AS p{i}_{j}' for i, j in pair)} FROM {dates} LEFT JOIN {source} ON {source}.d = {dates}.d AND {target} IS NOT NULL GROUP BY 1)"]
    out.append(f"{name}_c AS (SELECT d, n, {', '.join(f's{i} / n AS m{i}' for i in range(p + 1))}, {', '.join(f'p{i}_{j} / n - (s{i} / n) * (s{j} / n) AS c{i}_{j}' for i, j in pair)} FROM {name}_s WHERE n > 0)")
    out.append(f"{name}_d AS (SELECT *, {', '.join(f'CASE WHEN sqrt(greatest(c{i}_{i}, 0.0)) < 1e-12 THEN 1.0 ELSE sqrt(greatest(c{i}_{i}, 0.0)) END AS z{i}' for i in range(p))} FROM {name}_c)")
    gram = [f"n * c{i}_{j} / (z{i} * z{j}) + {alpha if i == j else 0.0} AS a{i}_{j}" for i in range(p) for j in range(i, p)]
    out.append(f"{name}_0 AS (SELECT d, {', '.join(f'm{i}' for i in range(p + 1))}, {', '.join(f'z{i}' for i in range(p))}, {', '.join(gram)}, {', '.join(f'n * c{i}_{p} / z{i} AS r{i}' for i in range(p))} FROM {name}_d)")
    for k in range(p - 1):
        new = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(k + 1, p) for j in range(i, p)] + [f"r{i} - a{k}_{i} * r{k} / a{k}_{k} AS r{i}" for i in range(k + 1, p)]
        out.append(f"{name}_{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{k})")
    last = f"{name}_{p - 1}"
    for k in reversed(range(p)):
        solved = "".join(f" - a{k}_{j} * w{j}" for j in range(k + 1, p))
        out.append(f"{name}_w{k} AS (SELECT *, (r{k}{solved}) / a{k}_{k} AS w{k} FROM {last})")
        last = f"{name}_w{k}"
    line = " - ".join([f"m{p}", *[f"w{i} / z{i} * m{i}" for i in range(p)]])
    out.append(f"{name} AS (SELECT d, {line} AS bias, {', '.join(f'w{i} / z{i} AS b{i}' for i in range(p))} FROM {last})")
    return ", ".join(out)


def isotonic(name: str, source: str, x: str, y: str) -> str:
    """CTEs ending in ``name`` (x, value): the isotonic fit as the largest of the least means over the stretches around a point."""
    return f"""{name}_p AS (SELECT {x} AS x, sum({y})::DOUBLE AS s, count(*) AS n FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1),
    {name}_c AS (SELECT *, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM {name}_p),
    {name}_ab AS (SELECT a.x AS ax, b.x AS bx, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM {name}_c a JOIN {name}_c b ON b.x >= a.x),
    {name} AS (SELECT x, max(m) AS value FROM (SELECT ax, bx AS x, min(m) OVER (PARTITION BY ax ORDER BY bx DESC) AS m FROM {name}_ab) GROUP BY 1)"""
