"""Scalar and aggregate expressions, as Spark SQL text for ``F.expr`` and ``selectExpr``.

Arguments are SQL text too, usually column names. Everything stays inside the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from statistics import NormalDist


# A step of a path: a subscript, a quoted name (in brackets or not), or a plain name.
_STEP = re.compile(
    r"""\[(?P<at>[0-9]+)\]|\[(?:'(?P<one>[^']+)'|"(?P<two>[^"]+)")\]"""
    r"""|(?P<dot>\.?)(?:"(?P<quoted>(?:[^"]|"")+)"|(?P<plain>[^.\[\]"]+))"""
)


def json_steps(path: str) -> list[str | int]:
    """Names and subscripts of a path: ``items[0].x``, ``"a.b".c``, ``['a.b']["c"]``.

    Names stand between dots; in quotes or brackets they may hold dots. A quote inside a quoted name is
    doubled. Subscripts count from 0.
    """
    steps: list[str | int] = []
    at = 0
    while at < len(path):
        step = _STEP.match(path, at)
        if step is None or step["dot"] is not None and bool(step["dot"]) != bool(steps):
            raise ValueError(f"no path of names and subscripts: {path!r}")
        name = step["one"] or step["two"] or (step["quoted"] or "").replace('""', '"') or step["plain"]
        steps.append(int(step["at"]) if step["at"] else name)
        at = step.end()
    if not steps:
        raise ValueError("an empty path")
    return steps


def json_fields(
    metadata: str, paths: Iterable[str], column: str = "_json"
) -> tuple[dict[str, str], dict[str, str]]:
    """Columns that parse the blob, and for each path the text that reads it from them.

    A path leads from the top through names and subscripts, see ``json_steps``; its value is the
    field's text, NULL where the JSON is unreadable or has no such field. One ``from_json`` reads all
    paths of names. Only paths that a struct cannot hold together (names that differ in case alone, or
    a path that leads on through another one's value) are parsed by a further one. If any path has a
    subscript, all are read from one VARIANT instead, as elements of an array may differ in type; a
    blob that repeats a name is unreadable then.
    """
    trees: list[dict] = []
    place: dict[str, int] = {}
    found = {path: json_steps(path) for path in dict.fromkeys(paths)}
    if any(isinstance(step, int) for steps in found.values() for step in steps):
        return {f"{column}0": f"try_parse_json({metadata})"}, {
            path: f"try_variant_get({column}0, {literal(_variant_path(steps))}, 'string')"
            for path, steps in found.items()
        }
    for path, steps in found.items():
        at = next((i for i, tree in enumerate(trees) if _fits(tree, steps)), len(trees))
        if at == len(trees):
            trees.append({})
        node = trees[at]
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = None
        place[path] = at
    parsed = {
        f"{column}{i}": f"from_json({metadata}, {literal(_json_schema(tree))})"
        for i, tree in enumerate(trees)
    }
    read = {
        path: ".".join([f"{column}{i}", *map(quoted, found[path])]) for path, i in place.items()
    }
    return parsed, read


def _variant_path(steps: list[str | int]) -> str:
    """The path as VARIANT functions take it; these have no escapes inside quotes."""
    text = "$"
    for step in steps:
        if isinstance(step, str) and "'" in step and '"' in step:
            raise ValueError(f"a name with both quotes, beside a subscript: {step!r}")
        mark = "" if isinstance(step, int) else '"' if "'" in step else "'"
        text += f"[{mark}{step}{mark}]"
    return text


def _fits(tree: dict, steps: list[str]) -> bool:
    """Whether a path can be added to a tree of fields, in which None ends a path."""
    for i, step in enumerate(steps):
        if step not in tree:
            return step.lower() not in map(str.lower, tree)
        if i == len(steps) - 1 or tree[step] is None:
            return False
        tree = tree[step]
    return False


def _json_schema(tree: dict) -> str:
    return ", ".join(
        f"{quoted(name)} {'STRING' if below is None else f'STRUCT<{_json_schema(below)}>'}"
        for name, below in tree.items()
    )


def quoted(name: str) -> str:
    """A name as SQL text, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string constant as SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_number(value: str) -> str:
    """Number, or NULL where the text is not one.

    Java also reads a type suffix ("12d"), hex digits ("0x1p3"), "NaN" and "Infinity"; none is a
    number here. Spoiling the letters d, f and x takes care of all but "NaN".
    """
    text = f"translate(CAST({value} AS STRING), 'dDfFxX', '______')"
    return f"nanvl(try_cast({text} AS DOUBLE), CAST(NULL AS DOUBLE))"


def whole_number(value: str) -> str:
    return f"try_cast(CAST({value} AS STRING) AS INT)"


def age(unit: str, created_at: str, as_of: str, boundary: bool = False) -> str:
    """Age in ``unit``: complete units, or calendar boundaries crossed.

    A month is complete at the end of a shorter month: January 31 to February 29 is one month.
    ``timestampdiff`` compares days of the month and says 0 there, so the next unit is tried.
    """
    if boundary:
        created_at = f"date_trunc('{unit}', {created_at})"
        as_of = f"date_trunc('{unit}', {as_of})"
    whole = f"timestampdiff({unit}, {created_at}, {as_of})"
    if boundary or unit.upper() not in ("MONTH", "QUARTER", "YEAR"):
        return whole
    return (
        f"CASE WHEN {created_at} <= {as_of} THEN {whole} +"
        f" IF(timestampadd({unit}, {whole} + 1, {created_at}) <= {as_of}, 1, 0)"
        f" ELSE {whole} - IF(timestampadd({unit}, 1 - {whole}, {as_of}) <= {created_at}, 1, 0) END"
    )


def number(value: float | int | None) -> str:
    """A constant, exact to the last digit."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(value, float) and not math.isfinite(value):
        return f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def present(column: str, kind: str) -> str:
    """Condition: there is a value; NaN is none."""
    if kind in ("double", "float"):
        return f"({column} IS NOT NULL AND NOT isnan({column}))"
    return f"{column} IS NOT NULL"


def per_cohort(values: Mapping[int, float | int | None]) -> str:
    """The value of the row's cohort; NULL for a cohort that is not in ``values``."""
    cases = " ".join(f"WHEN {cohort} THEN {number(v)}" for cohort, v in values.items())
    return f"CASE cohort {cases} END" if cases else "CAST(NULL AS DOUBLE)"


def percent(part: str, whole: str) -> str:
    """``100 * part / whole``; 0 when only the denominator is 0, NULL when both are.

    The product comes first: the last digit decides where the result is rounded to a whole number.
    """
    return (
        f"CASE WHEN {whole} = 0 AND {part} > 0 THEN 0D"
        f" ELSE try_divide(100 * {part}, {whole}) END"
    )


def standard_error(sd: str, n: str) -> str:
    return f"try_divide({sd}, sqrt({n}))"


def variance_explained(key: str, mean: str) -> str:
    """Aggregate: 100 r^2 over the rows of a curve; NULL for a flat or one-point curve.

    ``corr`` raises on zero variance, so r is put together from its parts.
    """
    x = f"CASE WHEN {mean} IS NOT NULL THEN CAST({key} AS DOUBLE) END"
    y = f"CAST({mean} AS DOUBLE)"
    return (
        f"100 * pow(try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y})), 2)"
    )


def ks_p_value(d: str, n1: str, n2: str) -> str:
    """Two-sided asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic.

    NULL when a sample is empty. The series only converges away from 0, where p is 1 to more
    than 12 digits.
    """
    en = f"sqrt(try_divide(CAST({n1} AS DOUBLE) * {n2}, {n1} + {n2}))"
    lam = f"({en} + 0.12D + try_divide(0.11D, {en})) * {d}"
    series = (
        "2 * aggregate(sequence(1, 100), 0D, (total, k) -> total +"
        f" CASE WHEN k % 2 = 1 THEN 1D ELSE -1D END * exp(-2D * k * k * ({lam}) * ({lam})))"
    )
    return (
        f"CASE WHEN {lam} < 0.2D THEN 1D"
        f" WHEN {lam} >= 0.2D THEN least(1D, greatest(0D, {series})) END"
    )


# Degrees of freedom up to which the t quantile is solved for exactly.
T_EXACT = 1000


def t_quantile(level: float, freedom: str) -> str:
    """Half width of the central interval that holds ``level`` of Student's t distribution.

    ``freedom`` is a whole number; NULL where it is under 1. With t = sqrt(n) tan(a), the probability
    within t is a finite series in the sine and cosine of a, concave in a, so Newton's steps from 0 rise to
    the solution and never pass it. Above ``T_EXACT`` degrees of freedom, four terms of the expansion
    around the normal quantile have 12 digits.
    """
    n = f"CAST({freedom} AS BIGINT)"
    even = f"({n} % 2 = 0)"
    # Terms after the first, and what leads from each to the next.
    terms = f"CASE WHEN {even} THEN {n} DIV 2 - 1 ELSE ({n} - 3) DIV 2 END"
    ratio = f"CASE WHEN {even} THEN (2D * k - 1) / (2D * k) ELSE 2D * k / (2D * k + 1) END"

    def steps(count: str, name: str) -> str:
        return f"filter(sequence(1L, greatest({count}, 1L)), {name} -> {name} <= {count})"

    series = (
        f"aggregate({steps(terms, 'j')}, named_struct('total', 1D, 'term', 1D),"
        f" (s, k) -> named_struct('total', s.total + s.term * ({ratio}) * pow(cos(a.angle), 2),"
        f" 'term', s.term * ({ratio}) * pow(cos(a.angle), 2))).total"
    )
    within = (
        f"CASE WHEN {even} THEN sin(a.angle) * {series} WHEN {n} = 1 THEN 2 * a.angle / pi()"
        f" ELSE 2 * (a.angle + sin(a.angle) * cos(a.angle) * {series}) / pi() END"
    )
    # Density at the centre, by its product form.
    centre = (
        f"CASE WHEN {even} THEN aggregate({steps(f'({n} DIV 2 - 1)', 'j')}, 0.5D,"
        " (c, k) -> c * (2D * k + 1) / (2D * k))"
        f" ELSE aggregate({steps(f'(({n} - 1) DIV 2)', 'j')}, 1 / pi(),"
        " (c, k) -> c * (2D * k) / (2D * k - 1)) END"
    )
    solved = (
        f"sqrt({n}) * tan(aggregate(sequence(1, 60), named_struct('angle', 0D, 'centre', {centre}),"
        f" (a, i) -> named_struct('angle', a.angle + ({level!r}D - ({within}))"
        f" / (2 * a.centre * pow(cos(a.angle), {n} - 1)), 'centre', a.centre)).angle)"
    )
    z = NormalDist().inv_cdf(0.5 + level / 2)
    # Coefficients of the expansion in 1 / n.
    expansion = (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    near = " + ".join(f"{c!r}D / pow({n}, {i})" for i, c in enumerate(expansion))
    return f"CASE WHEN {n} BETWEEN 1 AND {T_EXACT} THEN {solved} WHEN {n} > {T_EXACT} THEN {near} END"
