"""SQL of the ridge regressions: each round of ``operators.ridge`` as one more table."""

from __future__ import annotations

from collections.abc import Sequence

ROUNDS = 3


def _terms(parts: Sequence[str]) -> str:
    return " + ".join(parts) if parts else "0"


def _solved(name: str, size: int) -> tuple[str, str]:
    """Tables that turn ``{name}_0`` (target, n, l, m<j>, a<i>_<j>, b<i>) into slopes by elimination, and the last one's name."""
    tables = []
    for k in range(size):
        kept = ["target", "n", "l", *(f"m{j}" for j in range(size))]
        for i in range(size):
            cells = [(f"a{i}_{j}", f"a{k}_{j}") for j in range(size)] + [(f"b{i}", f"b{k}")]
            kept += [own if i == k else f"{own} - a{i}_{k} * {pivot} / a{k}_{k} AS {own}" for own, pivot in cells]
        tables.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {', '.join(kept)} FROM {name}_{k})")
    return ",\n".join(tables), f"{name}_{size}"


def ridge(name: str, numbers: Sequence[str], categories: Sequence[str]) -> str:
    """Tables up to ``{name}_scored``: ``{name}_rows`` (target, y, learn, numbers, categories, others) with the prediction ``p``."""
    rows, size, tables = f"{name}_rows", len(numbers), []
    effects: dict[int, str] = {}
    line = ""

    def beside(k: int | None) -> tuple[str, str]:
        others = {o: t for o, t in effects.items() if o != k}
        joins = "".join(f" LEFT JOIN {t} ON {t}.target = r.target AND {t}.level = r.{categories[o]}" for o, t in others.items())
        return joins, _terms([f"coalesce({t}.e, 0)" for t in others.values()])

    def on_line(table: str) -> str:
        return _terms([f"{table}.l", *(f"{table}.s{j} * r.{n}" for j, n in enumerate(numbers))])

    for turn in range(ROUNDS + 1):
        joins, known = beside(None)
        start, line = f"{name}_system{turn}", f"{name}_line{turn}"
        moments = [f"avg(x{j}) AS m{j}" for j in range(size)] + [f"count(*) * covar_pop(x{j}, o) AS b{j}" for j in range(size)]
        for i in range(size):
            for j in range(size):
                ridged = " * (1 + 1.0::DOUBLE / count(*))" if i == j else ""
                moments.append(f"count(*) * covar_pop(x{i}, x{j}){ridged} AS a{i}_{j}")
        shown = ", ".join(f"CAST(r.{n} AS DOUBLE) AS x{j}" for j, n in enumerate(numbers))
        tables.append(
            f"""{start}_0 AS MATERIALIZED (SELECT target, count(*) AS n, avg(o) AS l, {', '.join(moments)}
  FROM (SELECT r.target, r.y - ({known}) AS o, {shown} FROM {rows} r{joins} WHERE r.learn) GROUP BY target)"""
        )
        steps, last = _solved(start, size)
        slopes = [f"b{j} / a{j}_{j}" for j in range(size)]
        through = _terms([f"{s} * m{j}" for j, s in enumerate(slopes)])
        tables += [
            steps,
            f"{line} AS MATERIALIZED (SELECT target, l - ({through}) AS l, {', '.join(f'{s} AS s{j}' for j, s in enumerate(slopes))} FROM {last})",
        ]
        for k, c in enumerate(categories if turn < ROUNDS else ()):
            joins, known = beside(k)
            table = f"{name}_effects{turn}_{k}"
            tables.append(
                f"""{table} AS MATERIALIZED (SELECT target, level, e - avg(e) OVER (PARTITION BY target) AS e FROM (
  SELECT r.target, r.{c} AS level, sum(r.y - ({on_line(line)}) - ({known})) / (count(*) + 1.0::DOUBLE) AS e
  FROM {rows} r JOIN {line} ON {line}.target = r.target{joins} WHERE r.learn GROUP BY 1, 2))"""
            )
            effects[k] = table
    joins, known = beside(None)
    tables.append(
        f"{name}_scored AS MATERIALIZED (SELECT r.*, {on_line(line)} + {known} AS p FROM {rows} r JOIN {line} ON {line}.target = r.target{joins})"
    )
    return ",\n".join(tables)


def mean_effects(name: str, categories: Sequence[str], target: str) -> str:
    """A row a category: the mean size of its levels' effects."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs(e)) AS importance FROM {name}_effects{ROUNDS - 1}_{k} WHERE target = '{target}'"
        for k, c in enumerate(categories)
    )


def slope_sizes(name: str, numbers: Sequence[str], target: str) -> str:
    """A row a number: its slope over one deviation of the rows learned from."""
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, abs(s{j}) * (SELECT stddev_pop({n}) FROM {name}_rows WHERE learn AND target = '{target}') AS importance
FROM {name}_line{ROUNDS} WHERE target = '{target}'"""
        for j, n in enumerate(numbers)
    )
