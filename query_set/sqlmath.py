"""SQL for results SQL has no function for: tail probabilities by Simpson's rule and least
squares by successive orthogonalisation. Only the comparison side uses it."""

from __future__ import annotations


def _simpson(density: str, low: str, high: str, steps: int) -> str:
    """Integral of ``density`` in u from low to high."""
    width = f"(({high}) - ({low})) / {steps}"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(SELECT sum({weight} * {density.replace('@u', f'(({low}) + i * {width})')}) * {width} / 3 "
            f"FROM range({steps} + 1) AS steps(i))")


def t_p(t: str, df: str) -> str:
    """Two-sided p of Student's t."""
    density = (f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) "
               f"* pow(1 + @u * @u / ({df}), -(({df}) + 1) / 2.0)")
    return f"greatest(0, 1 - 2 * {_simpson(density, '0.0', f'least(abs({t}), 60)', 20000)})"


def normal_p(z: str) -> str:
    density = "exp(-@u * @u / 2) / sqrt(2 * pi())"
    return f"greatest(0, 1 - 2 * {_simpson(density, '0.0', f'least(abs({z}), 40)', 20000)})"


def f_p(f: str, df1: str, df2: str) -> str:
    """Upper tail of F as an incomplete beta integral, in the logarithm of its variable."""
    a, b = f"(({df2}) / 2.0)", f"(({df1}) / 2.0)"
    top = f"ln(({df2}) / (({df2}) + ({df1}) * ({f})))"
    density = (f"exp({a} * @u + ({b} - 1) * ln(1 - exp(@u)) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))")
    return _simpson(density, f"{top} - 80 / {a}", top, 40000)


def chi2_p(x: str, df: int) -> str:
    density = f"pow(@u, {df} / 2.0 - 1) * exp(-@u / 2) / (pow(2, {df} / 2.0) * gamma({df} / 2.0))"
    return f"greatest(0, 1 - {_simpson(density, '0.0', f'least({x}, 400)', 40000)})"


def t_95(df: str) -> str:
    """Two-sided 95 % limit by expansion around the normal one; good to 1e-6 from df = 30."""
    z = 1.959963984540054
    terms = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join(f"{c!r} / pow({df}, {i})" for i, c in enumerate(terms)) + ")"


def least_squares(source: str, y: str, columns: dict[str, str], key: str = "NULL",
                  intercept: bool = True) -> tuple[str, list[str]]:
    """Derived tables for a fit of y on the columns (name -> expression) of ``source``.

    Gives ``rows0`` (the complete rows), ``rest`` (key, target, y = residual, a0.. = orthogonal
    columns) and ``fit`` (one row: n, k, r2, s2, b0.. coefficients, v0.. diagonal of the inverse
    cross products, d0.. squared lengths), and the names of the terms in order.
    """
    names = (["Intercept"] if intercept else []) + list(columns)
    exprs = (["1.0"] if intercept else []) + list(columns.values())
    k = len(names)
    a = [f"a{i}" for i in range(k)]
    ctes = [f"rows0 AS MATERIALIZED (SELECT {key} AS key, cast({y} AS double) AS target, cast({y} AS double) AS y, "
            + ", ".join(f"cast({e} AS double) AS {n}" for e, n in zip(exprs, a)) + f" FROM {source} WHERE "
            + " AND ".join(f"({e}) IS NOT NULL" for e in [y, *columns.values()]) + ")"]
    for i in range(k):
        later = range(i + 1, k)
        ctes.append(
            f"s{i} AS MATERIALIZED (SELECT sum(a{i} * a{i}) AS d{i}, sum(a{i} * y) / sum(a{i} * a{i}) AS c{i}"
            + "".join(f", sum(a{i} * a{j}) / sum(a{i} * a{i}) AS u{i}_{j}" for j in later) + f" FROM rows{i})")
        ctes.append(
            f"rows{i + 1} AS MATERIALIZED (SELECT key, target, y - c{i} * a{i} AS y, "
            + ", ".join(f"a{j} - u{i}_{j} * a{i} AS a{j}" if j > i else f"a{j}" for j in range(k))
            + f" FROM rows{i}, s{i})")
    ctes.append(f"rest AS MATERIALIZED (SELECT * FROM rows{k})")
    table = ("(SELECT count(*) AS n, sum(y * y) AS ssr, var_pop(target) * count(*) AS sst FROM rest), "
             + ", ".join(f"s{i}" for i in range(k)))
    select = f"SELECT * FROM {table}"
    for i in reversed(range(k)):
        # Back substitution: coefficient i and row i of the inverse triangle.
        b = f"c{i}" + "".join(f" - u{i}_{j} * b{j}" for j in range(i + 1, k))
        inverse = [
            "-(" + " + ".join([f"u{i}_{j}"] + [f"u{i}_{m} * w{m}_{j}" for m in range(i + 1, j)]) + f") AS w{i}_{j}"
            for j in range(i + 1, k)]
        select = f"SELECT *, {', '.join([f'{b} AS b{i}', *inverse])} FROM ({select})"
    v = [f"1 / d{i}" + "".join(f" + w{i}_{j} * w{i}_{j} / d{j}" for j in range(i + 1, k)) + f" AS v{i}"
         for i in range(k)]
    ctes.append(f"fit AS MATERIALIZED (SELECT *, {k} AS k, 1 - ssr / sst AS r2, ssr / (n - {k}) AS s2, "
                f"{', '.join(v)} FROM ({select}))")
    return ",\n".join(ctes), names


def term_rows(names: list[str], body: str) -> str:
    """One row per term; @i stands for its number and @name for its name."""
    return " UNION ALL ".join(body.replace("@i", str(i)).replace("@name", n.replace("'", "''"))
                              for i, n in enumerate(names))


# Tail of the studentised range for the pairs in ``pairs`` (with q, k, df): Simpson's rule over the
# spread s, the smallest mean z and the distance u to the others.
RANGE_TAIL = """
    gs AS (SELECT i / 32.0 - 1 AS place, CASE WHEN i IN (0, 64) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 96.0 AS ws
           FROM range(65) t(i)),
    gz AS (SELECT i * 0.09 - 9 AS z, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.03 AS wz
           FROM range(201) t(i)),
    gu AS (SELECT i / 200.0 AS u, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 600.0 AS wu
           FROM range(201) t(i)),
    ps AS (SELECT group1, group2, k, df, ws, 10 / sqrt(2.0 * df) AS half, 1 + place * 10 / sqrt(2.0 * df) AS s, q
           FROM pairs, gs WHERE 1 + place * 10 / sqrt(2.0 * df) > 0),
    inner_part AS (SELECT group1, group2, s, z, wz, sum(wu * exp(-pow(z + u * q * s, 2) / 2)) * any_value(q * s)
                          / sqrt(2 * pi()) AS part
                   FROM ps, gz, gu GROUP BY group1, group2, s, z, wz),
    below AS (SELECT group1, group2, s, any_value(k) * sum(wz * exp(-z * z / 2) / sqrt(2 * pi()) * pow(part, k - 1)) AS b
              FROM inner_part JOIN ps USING (group1, group2, s) GROUP BY group1, group2, s),
    tails AS (SELECT group1, group2, sum(ws * half * (1 - b)
                     * exp(ln(2) + df / 2.0 * ln(df / 2.0) - lgamma(df / 2.0) + (df - 1) * ln(s) - df * s * s / 2)) AS p
              FROM below JOIN ps USING (group1, group2, s) GROUP BY group1, group2)"""
