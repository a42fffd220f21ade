"""SQL that says the same as the registered queries, put together from few parts."""

from __future__ import annotations


def solved(src: str, p: int) -> str:
    """CTEs src, m (moments of each group) and b (m with coefficients b0..bp) over a query that yields g, y, x1..xp. Elimination goes term by term."""
    terms = range(1, p + 1)
    sums = [f"covar_pop(x{i}, x{j}) * count(*) AS s{i}{j}" for i in terms for j in terms]
    sums += [f"covar_pop(x{i}, y) * count(*) AS t{i}" for i in terms] + [f"avg(x{i}) AS m{i}" for i in terms]
    out = [f"src AS ({src})", f"m AS (SELECT g, count(*) AS n, avg(y) AS my, covar_pop(y, y) * count(*) AS cyy, {', '.join(sums)} FROM src GROUP BY g)"]
    cells = [f"a{i}{j}" for i in terms for j in terms] + [f"z{i}" for i in terms]
    out.append("e0 AS (SELECT *, " + ", ".join(f"s{i}{j} AS a{i}{j}" for i in terms for j in terms) + ", " + ", ".join(f"t{i} AS z{i}" for i in terms) + " FROM m)")
    for k in terms:
        new = []
        for i in terms:
            for c in [f"a{i}{j}" for j in terms] + [f"z{i}"]:
                pivot = f"a{k}" + c[2:] if c[0] == "a" else f"z{k}"
                new.append(f"{pivot} / a{k}{k} AS {c}" if i == k else f"{c} - a{i}{k} * {pivot} / a{k}{k} AS {c}")
        out.append(f"e{k} AS (SELECT * REPLACE ({', '.join(new)}) FROM e{k - 1})")
    slopes = ", ".join(f"z{i} AS b{i}" for i in terms)
    base = " - ".join(["my", *[f"z{i} * m{i}" for i in terms]])
    out.append(f"b AS (SELECT * EXCLUDE ({', '.join(cells)}), {slopes}, {base} AS b0 FROM e{p})")
    return ",\n".join(out)


def rounded(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"round(({expr}) * 1e{digits}) / 1e{digits} + 0.0" + (f" AS {name}" if name else "")


def fitted(src: str, p: int, where: str = "") -> str:
    cols = ", ".join(rounded(f"b{i}", 6, f"b{i}") for i in range(p + 1))
    return f"WITH {solved(src, p)}\nSELECT g AS \"group\", n AS rows, {cols} FROM b {where}"


def with_stats(src: str, p: int) -> str:
    """Adds st: b with sse, df, r2 and sd."""
    sse = " - ".join(["cyy", *[f"b{i} * t{i}" for i in range(1, p + 1)]])
    return solved(src, p) + f",\nst AS (SELECT *, {sse} AS sse, n - {p + 1} AS df, 1 - ({sse}) / cyy AS r2, sqrt(({sse}) / (n - {p + 1})) AS sd FROM b)"


def with_sums(src: str, p: int = 1) -> str:
    """Adds sums: power sums for each group and probe (terms from 0, the fitted value last), as one term and a fitted value need them."""
    pred = " + ".join(["b0", *[f"b{i} * x{i}" for i in range(1, p + 1)]])
    probes = " UNION ALL ".join([f"SELECT g, {i - 1} AS probe, x{i} - m{i} AS u, r, sd, n AS rows FROM res" for i in range(1, p + 1)] + [f"SELECT g, {p}, f - my, r, sd, n FROM res"])
    powers = ", ".join([f"sum(u ** {k}) AS su{k}" for k in range(1, 7)] + [f"sum(r * u ** {k}) AS sru{k}" for k in (1, 2, 3)])
    return with_stats(src, p) + f""",
res AS (SELECT src.g, y, {pred} AS f, y - ({pred}) AS r, {', '.join(f'x{i}, m{i}' for i in range(1, p + 1))}, my, sd, n FROM src JOIN st ON src.g = st.g),
sums AS (SELECT g, probe, count(*) AS n, {powers}, sum(r) AS sr1, sum(r * r) AS sr2, sum(r ** 4) AS sr4, sum(r * r * u) AS sw1, sum(r * r * u * u) AS sw2, sum(abs(r)) AS sa1, sum(abs(r) * u) AS sau1 FROM ({probes}) GROUP BY g, probe)"""


def with_probes(src: str, p: int = 1) -> str:
    """Adds t: square_t, cube_t and spread_t of each group and probe."""
    dot = lambda i, j: f"(su{i + j} - su{i} * su{j} / n)"
    rd = lambda k: f"(sru{k} - sr1 * su{k} / n)"
    rr = "(sr2 - sr1 * sr1 / n)"
    sq = f"({rd(2)} - {dot(1, 2)} / {dot(1, 1)} * {rd(1)}) / sqrt(({dot(2, 2)} - {dot(1, 2)} / {dot(1, 1)} * {dot(1, 2)}) * {rr})"
    det = f"({dot(1, 1)} * {dot(2, 2)} - {dot(1, 2)} * {dot(1, 2)})"
    a1 = f"(({dot(1, 3)} * {dot(2, 2)} - {dot(2, 3)} * {dot(1, 2)}) / {det})"
    a2 = f"(({dot(2, 3)} * {dot(1, 1)} - {dot(1, 3)} * {dot(1, 2)}) / {det})"
    cu = f"({rd(3)} - {a1} * {rd(1)} - {a2} * {rd(2)}) / sqrt(({dot(3, 3)} - {a1} * {dot(1, 3)} - {a2} * {dot(2, 3)}) * {rr})"
    wf, wg, ww = "(sw1 - sr2 * su1 / n)", "(sw2 - sr2 * su2 / n)", "(sr4 - sr2 * sr2 / n)"
    explained = f"((({wf}) * {dot(2, 2)} - {wg} * {dot(1, 2)}) * {wf} + ({wg} * {dot(1, 1)} - {wf} * {dot(1, 2)}) * {wg}) / {det}"
    t = lambda c: f"({c}) * sqrt(n - {p} - 2) / sqrt(1 - ({c}) * ({c}))"
    return with_sums(src, p) + f""",
corr AS (SELECT *, {sq} AS ksq, CASE WHEN probe < {p} THEN {cu} ELSE 0 END AS kcu, CASE WHEN probe = {p} THEN greatest(({explained}) / {ww}, 0) ELSE 0 END AS r2s FROM sums),
t AS (SELECT g, probe, n, {t('ksq')} AS square_t, {t('kcu')} AS cube_t, sqrt((r2s / 2) / ((1 - r2s) / (n - 3))) AS spread_t FROM corr)"""
