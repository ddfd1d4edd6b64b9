"""SQL fragments for checking results: tail probabilities and linear solves."""

from __future__ import annotations


def simpson(density: str, low: str, high: str, steps: int) -> str:
    """Simpson sum of ``density`` (an expression in u) between two expressions."""
    return f"""(SELECT ({high} - {low}) / {steps} / 3 * sum(
        CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * f)
      FROM (SELECT i, (SELECT {density} FROM (SELECT {low} + ({high} - {low}) * i / {steps} AS u)) AS f
            FROM generate_series(0, {steps}) AS g(i)))"""


# Macros cannot be registered with the checker, so each tail probability is an
# inline expression over columns of the enclosing query.
def normal_p(z: str) -> str:
    """Two-sided normal tail probability of the expression ``z``."""
    bound = f"least(abs({z}), 12.0::DOUBLE)"
    return f"(1 - 2 * {simpson('exp(-u * u / 2) / sqrt(2 * pi())', '0.0::DOUBLE', bound, 1200)})"


def chi2_p1(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom."""
    return normal_p(f"sqrt({x})")


def t_p(t: str, df: str) -> str:
    """Two-sided t tail; the substitution t = sqrt(df) tan(u) keeps the range finite."""
    bound = f"atan(CASE WHEN {df} > 30 THEN least(abs({t}), 40.0::DOUBLE) ELSE abs({t}) END / sqrt({df}))"
    constant = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"(1 - 2 * {constant} * {simpson(f'pow(cos(u), {df} - 1)', '0.0::DOUBLE', bound, 2000)})"


def term_sql(term: str) -> str:
    """Numeric SQL expression of a model term."""
    if ":" in term:
        return " * ".join(f"({term_sql(t)})" for t in term.split(":"))
    if term == "InPhaseTransitionYes":
        return "CASE WHEN InPhaseTransition = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"CAST({term} AS DOUBLE)"


def design(rows: str, outcome: str, terms: list[str]) -> str:
    """Model frame x0 (intercept), x1.., y of complete rows."""
    xs = ", ".join(["1.0::DOUBLE AS x0"] + [f"{term_sql(t)} AS x{i}" for i, t in enumerate(terms, 1)])
    whole = " AND ".join(f"x{i} IS NOT NULL" for i in range(len(terms) + 1))
    return f"SELECT * FROM (SELECT {xs}, CAST({outcome} AS DOUBLE) AS y FROM ({rows})) WHERE {whole} AND y IS NOT NULL"


def solve(wide: str, size: int, rhs: str, prefix: str) -> str:
    """CTEs that solve and invert the symmetric matrix a_i_j (i <= j) of the one-row CTE ``wide``.

    Gauss-Jordan elimination on a long table (i, j, v) with the identity and the
    right-hand side columns ``rhs``_i appended.  CTE <prefix>_inv then holds the
    inverse as (i, j, v) and <prefix>_sol the solution as (i, v).
    """
    cells = " UNION ALL ".join(
        [f"SELECT {i} AS i, {j} AS j, a_{min(i, j)}_{max(i, j)} AS v FROM {wide}" for i in range(size) for j in range(size)]
        + [f"SELECT {i}, {size + j}, {1.0 if i == j else 0.0}::DOUBLE" for i in range(size) for j in range(size)]
        + [f"SELECT {i}, {2 * size}, {rhs}_{i} FROM {wide}" for i in range(size)]
    )
    parts = [f"{prefix}_e0 AS MATERIALIZED ({cells})"]
    for k in range(size):
        e = f"{prefix}_e{k}"
        parts.append(
            f"""{prefix}_e{k + 1} AS MATERIALIZED (SELECT a.i, a.j,
      CASE WHEN a.i = {k} THEN q.v / d.v ELSE a.v - p.v * q.v / d.v END AS v
    FROM {e} a JOIN {e} q ON q.i = {k} AND q.j = a.j JOIN {e} p ON p.j = {k} AND p.i = a.i
         JOIN {e} d ON d.i = {k} AND d.j = {k})"""
        )
    last = f"{prefix}_e{size}"
    parts.append(f"{prefix}_inv AS MATERIALIZED (SELECT i, j - {size} AS j, v FROM {last} WHERE j BETWEEN {size} AND {2 * size - 1})")
    parts.append(f"{prefix}_sol AS MATERIALIZED (SELECT i, v FROM {last} WHERE j = {2 * size})")
    return ",\n".join(parts)


def _products(size: int, weight: str = "") -> str:
    return ", ".join(f"sum({weight}x{i} * x{j}) AS a_{i}_{j}" for i in range(size) for j in range(i, size))


def _labels(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(names)) + ") AS labels(i, term)"


STARS = "CASE WHEN {p} < 0.01 THEN '***' WHEN {p} < 0.05 THEN '**' WHEN {p} < 0.1 THEN '*' ELSE '' END"


def tidy(model: str, p: str) -> str:
    return f"""SELECT '{model}' AS model, term, round(estimate, 5) AS estimate, round(std_error, 5) AS std_error,
      round(statistic, 5) AS statistic, round(p, 6) AS p_value, {STARS.format(p="p")} AS stars
    FROM (SELECT *, {p} AS p FROM (SELECT *, estimate / std_error AS statistic FROM est))"""


def _least_squares(rows: str, outcome: str, terms: list[str]) -> str:
    """CTEs of a least squares fit: sums s, m_inv, m_sol, and residuals taken row by row."""
    size = len(terms) + 1
    fitted = " + ".join(f"b_{i} * x{i}" for i in range(size))
    wide = ", ".join(f"max(v) FILTER (i = {i}) AS b_{i}" for i in range(size))
    return f"""f AS MATERIALIZED ({design(rows, outcome, terms)}),
  s AS MATERIALIZED (SELECT {_products(size)}, {", ".join(f"sum(x{i} * y) AS b_{i}" for i in range(size))}, count(*)::DOUBLE AS n, avg(y) AS ybar FROM f),
  {solve("s", size, "b", "m")}, wide AS (SELECT {wide} FROM m_sol),
  w AS MATERIALIZED (SELECT any_value(n) AS n, sum((y - ({fitted})) * (y - ({fitted}))) AS rss, sum((y - ybar) * (y - ybar)) AS tss
        FROM f, wide, (SELECT n, ybar FROM s))"""


def ols(model: str, rows: str, outcome: str, terms: list[str]) -> str:
    """Coefficient table of a least squares fit."""
    size = len(terms) + 1
    return f"""SELECT * FROM (WITH {_least_squares(rows, outcome, terms)},
  est AS MATERIALIZED (SELECT term, beta.v AS estimate, sqrt(rss / (n - {size}) * d.v) AS std_error, n - {size} AS df
       FROM m_sol beta JOIN {_labels(["(Intercept)", *terms])} USING (i) JOIN m_inv d ON d.i = beta.i AND d.j = beta.i, w)
  {tidy(model, t_p("statistic", "df"))})"""


def ols_fit(model: str, rows: str, outcome: str, terms: list[str]) -> str:
    """n, sigma, R2, adjusted R2, F, log-likelihood, AIC, BIC of a least squares fit."""
    size = len(terms) + 1
    return f"""SELECT * FROM (WITH {_least_squares(rows, outcome, terms)},
  g AS (SELECT *, -n / 2 * (ln(2 * pi()) + ln(rss / n) + 1) AS loglik FROM w)
  SELECT '{model}' AS model, n::BIGINT AS n, round(sqrt(rss / (n - {size})), 6) AS sigma, round(1 - rss / tss, 6) AS r2,
    round(1 - rss / tss * (n - 1) / (n - {size}), 6) AS adj_r2, round((tss - rss) / {size - 1} / (rss / (n - {size})), 6) AS f,
    round(loglik, 4) AS loglik, round(-2 * loglik + 2 * {size + 1}, 4) AS aic, round(-2 * loglik + ln(n) * {size + 1}, 4) AS bic FROM g)"""


NEWTON_ROUNDS = 6


def _newton(rows: str, outcome: str, terms: list[str]) -> str:
    """CTEs pat (patterns) and b0 .. bK (coefficients, one row each)."""
    size = len(terms) + 1
    xs = ", ".join(f"x{i}" for i in range(size))
    parts = [
        f"pat AS MATERIALIZED (SELECT {xs}, count(*)::DOUBLE AS m, sum(y) AS s FROM ({design(rows, outcome, terms)}) GROUP BY ALL)",
        "b0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b_{i}" for i in range(size)) + ")",
    ]
    for k in range(NEWTON_ROUNDS):
        eta = " + ".join(f"b_{i} * x{i}" for i in range(size))
        parts.append(f"p{k} AS (SELECT pat.*, 1 / (1 + exp(-({eta}))) AS mu FROM pat, b{k})")
        scores = ", ".join(f"sum(x{i} * (s - m * mu)) AS g_{i}" for i in range(size))
        parts.append(f"s{k} AS MATERIALIZED (SELECT {_products(size, 'm * mu * (1 - mu) * ')}, {scores} FROM p{k})")
        parts.append(solve(f"s{k}", size, "g", f"n{k}"))
        moved = ", ".join(f"b_{i} + (SELECT v FROM n{k}_sol WHERE i = {i}) AS b_{i}" for i in range(size))
        parts.append(f"b{k + 1} AS MATERIALIZED (SELECT {moved} FROM b{k})")
    return ",\n".join(parts)


def logit(model: str, rows: str, outcome: str, terms: list[str]) -> str:
    """Coefficient table of a logistic fit."""
    last = NEWTON_ROUNDS
    entries = " UNION ALL ".join(f"SELECT {i} AS i, b_{i} AS v FROM b{last}" for i in range(len(terms) + 1))
    return f"""SELECT * FROM (WITH {_newton(rows, outcome, terms)},
  est AS MATERIALIZED (SELECT term, b.v AS estimate, sqrt(d.v) AS std_error FROM ({entries}) b
       JOIN {_labels(["(Intercept)", *terms])} USING (i) JOIN n{last - 1}_inv d ON d.i = b.i AND d.j = b.i)
  {tidy(model, normal_p("statistic"))})"""


def logit_fit(model: str, rows: str, outcome: str, terms: list[str]) -> str:
    """n, log-likelihood, deviance, AIC, BIC of a logistic fit."""
    size = len(terms) + 1
    eta = " + ".join(f"b_{i} * x{i}" for i in range(size))
    return f"""SELECT * FROM (WITH {_newton(rows, outcome, terms)},
  l AS (SELECT sum(s * eta - m * ln(1 + exp(eta))) AS loglik, sum(m) AS n FROM (SELECT pat.*, {eta} AS eta FROM pat, b{NEWTON_ROUNDS}))
  SELECT '{model}' AS model, n::BIGINT AS n, round(loglik, 4) AS loglik, round(-2 * loglik, 4) AS deviance,
    round(-2 * loglik + 2 * {size}, 4) AS aic, round(-2 * loglik + {size} * ln(n), 4) AS bic FROM l)"""


# Rounds of narrowing the variance ratio, and ratios tried per round.
REML_ROUNDS, REML_STEPS = 8, 32


def _solve_by(wide: str, size: int, prefix: str, by: str) -> str:
    """Like ``solve`` for one system per value of ``by``; also <prefix>_det with the log-determinants."""
    cells = " UNION ALL ".join(
        [f"SELECT {by}, {i} AS i, {j} AS j, a_{min(i, j)}_{max(i, j)} AS v FROM {wide}" for i in range(size) for j in range(size)]
        + [f"SELECT {by}, {i}, {size + j}, {1.0 if i == j else 0.0}::DOUBLE FROM {wide}" for i in range(size) for j in range(size)]
        + [f"SELECT {by}, {i}, {2 * size}, b_{i} FROM {wide}" for i in range(size)]
    )
    parts = [f"{prefix}_e0 AS MATERIALIZED ({cells})"]
    for k in range(size):
        e = f"{prefix}_e{k}"
        parts.append(
            f"""{prefix}_e{k + 1} AS MATERIALIZED (SELECT a.{by}, a.i, a.j,
      CASE WHEN a.i = {k} THEN q.v / d.v ELSE a.v - p.v * q.v / d.v END AS v
    FROM {e} a JOIN {e} q ON q.i = {k} AND q.j = a.j AND q.{by} = a.{by} JOIN {e} p ON p.j = {k} AND p.i = a.i AND p.{by} = a.{by}
         JOIN {e} d ON d.i = {k} AND d.j = {k} AND d.{by} = a.{by})"""
        )
    pivots = " UNION ALL ".join(f"SELECT {by}, ln(v) AS v FROM {prefix}_e{k} WHERE i = {k} AND j = {k}" for k in range(size))
    parts.append(f"{prefix}_det AS MATERIALIZED (SELECT {by}, sum(v) AS logdet FROM ({pivots}) GROUP BY {by})")
    return ",\n".join(parts)


def lmm(model: str, rows: str, outcome: str, group: str, terms: list[str]) -> str:
    """Random-intercept REML fit: a grid of variance ratios narrowed around its best value."""
    size = len(terms) + 1
    xs = [f"x{i}" for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    terms_sql = ", ".join(["1.0::DOUBLE AS x0"] + [f"{term_sql(t)} AS x{i}" for i, t in enumerate(terms, 1)])
    shrink = "r / (1 + r * z.n)"
    parts = [
        f"f AS MATERIALIZED (SELECT {group} AS g, {terms_sql}, CAST({outcome} AS DOUBLE) AS y FROM ({rows}))",
        f"tot AS MATERIALIZED (SELECT {_products(size)}, {', '.join(f'sum({x} * y) AS b_{i}' for i, x in enumerate(xs))}, sum(y * y) AS yy, count(*)::DOUBLE AS n FROM f)",
        f"gr AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, {', '.join(f'sum({x}) AS {x}' for x in xs)}, sum(y) AS y FROM f GROUP BY g)",
        f"""z AS MATERIALIZED (SELECT n, count(*)::DOUBLE AS k, {", ".join(f"sum(x{i} * x{j}) AS a_{i}_{j}" for i, j in pairs)},
            {", ".join(f"sum({x} * y) AS b_{i}" for i, x in enumerate(xs))}, sum(y * y) AS yy FROM gr GROUP BY n)""",
        "g0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS r UNION ALL SELECT pow(10, -6 + i / 8.0) FROM generate_series(0, 80) AS q(i))",
    ]
    for k in range(REML_ROUNDS):
        cells = [f"any_value(tot.a_{i}_{j}) - sum({shrink} * z.a_{i}_{j}) AS a_{i}_{j}" for i, j in pairs]
        cells += [f"any_value(tot.b_{i}) - sum({shrink} * z.b_{i}) AS b_{i}" for i in range(size)]
        parts += [
            f"""u{k} AS MATERIALIZED (SELECT r, {", ".join(cells)}, any_value(tot.yy) - sum({shrink} * z.yy) AS yy,
                sum(z.k * ln(1 + r * z.n)) AS spread, any_value(tot.n) AS n FROM g{k}, z, tot GROUP BY r)""",
            _solve_by(f"u{k}", size, f"h{k}", "r"),
            f"""v{k} AS MATERIALIZED (SELECT r, s2, (n - {size}) * (ln(2 * pi() * s2) + 1) + spread + logdet AS reml FROM (
                SELECT u.r, n, spread, (any_value(u.yy) - sum(s.v * q.v)) / (n - {size}) AS s2 FROM u{k} u JOIN h{k}_e{size} s ON s.r = u.r AND s.j = {2 * size}
                JOIN h{k}_e0 q ON q.r = u.r AND q.i = s.i AND q.j = {2 * size} GROUP BY u.r, n, spread) JOIN h{k}_det USING (r))""",
            f"w{k} AS MATERIALIZED (SELECT arg_min(r, reml) AS best FROM v{k})",
            f"""l{k} AS MATERIALIZED (SELECT best, coalesce((SELECT max(r) FROM g{k} WHERE r < best), best) AS lo,
                coalesce((SELECT min(r) FROM g{k} WHERE r > best), best) AS hi FROM w{k})""",
            f"g{k + 1} AS MATERIALIZED (SELECT DISTINCT lo + (hi - lo) * i / {REML_STEPS}.0 AS r FROM l{k}, generate_series(0, {REML_STEPS}) AS q(i))",
        ]
    k = REML_ROUNDS - 1
    return f"""WITH {", ".join(parts)}, o AS (SELECT v{k}.* FROM v{k}, w{k} WHERE r = best),
  est AS (SELECT term, s.v AS estimate, sqrt(s2 * d.v) AS std_error FROM h{k}_e{size} s JOIN {_labels(["(Intercept)", *terms])} USING (i)
      JOIN h{k}_e{size} d ON d.i = s.i AND d.j = s.i + {size} AND d.r = s.r JOIN o ON o.r = s.r WHERE s.j = {2 * size})
  SELECT '{model}' AS model, term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(estimate / std_error, 3) AS statistic,
    round(sqrt(s2), 4) AS sigma, round(sqrt(r * s2), 2) AS group_sd, round(reml, 3) AS reml FROM est, o"""


# Newton rounds of the Laplace fit, steps towards each group's mode, and the
# difference step of the curvature.
LAPLACE_ROUNDS, MODE_ROUNDS, LAPLACE_H = 6, 6, "1e-4::DOUBLE"


def _laplace(points: str, size: int, prefix: str, gradient: bool) -> str:
    """CTE <prefix>_f: Laplace log-likelihood (and gradient) at each row (pt, t_i, sg) of ``points``."""
    fixed = " + ".join(f"t_{i} * x{i}" for i in range(size))
    xs = ", ".join(f"x{i}" for i in range(size))
    parts = [
        f"{prefix}_b AS MATERIALIZED (SELECT pt, g, {xs}, m, s, sg, {fixed} AS fixed FROM pat, {points})",
        f"{prefix}_v0 AS MATERIALIZED (SELECT DISTINCT pt, g, 0.0::DOUBLE AS v FROM {prefix}_b)",
    ]
    for k in range(MODE_ROUNDS):
        parts.append(
            f"""{prefix}_v{k + 1} AS MATERIALIZED (SELECT pt, g,
      any_value(v) + (any_value(sg) * sum(s - m * mu) - any_value(v)) / (1 + any_value(sg) * any_value(sg) * sum(m * mu * (1 - mu))) AS v
    FROM (SELECT b.*, v, 1 / (1 + exp(-(fixed + sg * v))) AS mu FROM {prefix}_b b JOIN {prefix}_v{k} USING (pt, g)) GROUP BY pt, g)"""
        )
    w, skew = "m * mu * (1 - mu)", "m * mu * (1 - mu) * (1 - 2 * mu)"
    sums = ["any_value(sg) AS sg", "any_value(v) AS v", "sum(s * eta - m * ln(1 + exp(eta))) AS ll", "sum(s - m * mu) AS r", f"sum({w}) AS h"]
    outs = ["sum(ll - v * v / 2 - ln(a) / 2) AS f"]
    if gradient:
        sums.append(f"sum({skew}) AS t")
        for i in range(size):
            sums += [f"sum(x{i} * (s - m * mu)) AS gx_{i}", f"sum({w} * x{i}) AS c_{i}", f"sum({skew} * x{i}) AS d_{i}"]
            outs.append(f"sum(gx_{i} - sg * sg / a * (d_{i} - t * sg * sg / a * c_{i}) / 2) AS g_{i}")
        outs.append(f"sum(r * v - (2 * h * sg / a + sg * sg / a * t * (v + sg / a * (r - sg * h * v))) / 2) AS g_{size}")
    parts.append(
        f"""{prefix}_f AS MATERIALIZED (SELECT pt, {", ".join(outs)} FROM (SELECT *, 1 + sg * sg * h AS a FROM (
      SELECT pt, g, {", ".join(sums)} FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (
        SELECT b.*, v, fixed + sg * v AS eta FROM {prefix}_b b JOIN {prefix}_v{MODE_ROUNDS} USING (pt, g))) GROUP BY pt, g)) GROUP BY pt)"""
    )
    return ",\n".join(parts)


def glmm(model: str, rows: str, outcome: str, group: str, terms: list[str]) -> str:
    """Random-intercept logistic fit by Laplace: the best variance on a grid at the plain logistic
    estimates, then Newton steps with the curvature differenced from gradients."""
    size = len(terms) + 1
    names = [f"z{i}" for i in range(1, size)]
    k = size + 1
    raw = ", ".join(f"{term_sql(t)} AS {z}" for t, z in zip(terms, names, strict=True))
    moments = ", ".join(f"avg({z}) AS m_{z}, stddev_pop({z}) AS s_{z}" for z in names)
    scaled = ", ".join(f"({z} - m_{z}) / s_{z} AS {z}" for z in names)
    parts = [
        f"raw AS MATERIALIZED (SELECT {group} AS g, {raw}, CAST({outcome} AS DOUBLE) AS y FROM ({rows}))",
        f"mom AS MATERIALIZED (SELECT {moments}, count(*)::DOUBLE AS n FROM raw)",
        f"std AS MATERIALIZED (SELECT g, {scaled}, y FROM raw, mom)",
        _newton("SELECT * FROM std", "y", names).replace("pat AS MATERIALIZED", "pat0 AS MATERIALIZED").replace("FROM pat, b", "FROM pat0, b").replace("SELECT pat.*", "SELECT pat0.*"),
        f"pat AS MATERIALIZED (SELECT g, 1.0::DOUBLE AS x0, {', '.join(f'{z} AS x{i}' for i, z in enumerate(names, 1))}, count(*)::DOUBLE AS m, sum(y) AS s FROM std GROUP BY ALL)",
        f"""grid AS MATERIALIZED (SELECT q.i AS pt, {", ".join(f"b_{i} AS t_{i}" for i in range(size))},
            CASE WHEN q.i = 0 THEN 0.0 ELSE pow(10, -2.5 + q.i / 6.0) END::DOUBLE AS sg FROM b{NEWTON_ROUNDS}, generate_series(0, 18) AS q(i))""",
        _laplace("grid", size, "gr", gradient=False),
        f"""par0 AS MATERIALIZED (SELECT {", ".join(f"t_{i} AS p_{i}" for i in range(size))}, sg AS p_{size}
            FROM grid WHERE pt = (SELECT arg_max(pt, f) FROM gr_f))""",
    ]
    columns = [f"t_{i}" for i in range(size)] + ["sg"]
    for n in range(LAPLACE_ROUNDS):
        stencil = []
        for pt in range(2 * k + 1):
            moved, sign = (pt - 1) % k, "+" if pt <= k else "-"
            cells = [f"p_{i}{f' {sign} {LAPLACE_H}' if pt and i == moved else ''} AS {c}" for i, c in enumerate(columns)]
            stencil.append(f"SELECT {pt} AS pt, {', '.join(cells)} FROM par{n}")
        parts.append(f"pts{n} AS MATERIALIZED ({' UNION ALL '.join(stencil)})")
        parts.append(_laplace(f"pts{n}", size, f"la{n}", gradient=True))

        def at(pt: int, j: int) -> str:
            return f"max(g_{j}) FILTER (pt = {pt})"

        hessian = [
            f"-({at(1 + i, j)} - {at(1 + k + i, j)} + {at(1 + j, i)} - {at(1 + k + j, i)}) / (4 * {LAPLACE_H}) AS a_{i}_{j}"
            for i in range(k)
            for j in range(i, k)
        ]
        parts.append(f"hs{n} AS MATERIALIZED (SELECT {', '.join(hessian)}, {', '.join(f'{at(0, j)} AS g_{j}' for j in range(k))} FROM la{n}_f)")
        parts.append(solve(f"hs{n}", k, "g", f"ns{n}"))
        parts.append(f"par{n + 1} AS MATERIALIZED (SELECT {', '.join(f'p_{i} + (SELECT v FROM ns{n}_sol WHERE i = {i}) AS p_{i}' for i in range(k))} FROM par{n})")
    last = LAPLACE_ROUNDS - 1
    # Weights of the standardised coefficients in each original one.
    weights = ["SELECT 0 AS term_no, 0 AS i, 1.0::DOUBLE AS w"]
    weights += [f"SELECT 0, {i}, -m_{z} / s_{z} FROM mom" for i, z in enumerate(names, 1)]
    weights += [f"SELECT {i}, {i}, 1 / s_{z} FROM mom" for i, z in enumerate(names, 1)]
    values = " UNION ALL ".join(f"SELECT {i} AS i, p_{i} AS v FROM par{LAPLACE_ROUNDS}" for i in range(size))
    return f"""WITH {(", ").join(parts)},
  wt AS MATERIALIZED ({" UNION ALL ".join(weights)}),
  be AS (SELECT term_no, sum(w * v) AS estimate FROM wt JOIN ({values}) USING (i) GROUP BY term_no),
  se AS (SELECT a.term_no, sqrt(sum(a.w * c.w * n.v)) AS std_error FROM wt a JOIN wt c ON c.term_no = a.term_no
         JOIN ns{last}_inv n ON n.i = a.i AND n.j = c.i GROUP BY a.term_no)
  SELECT '{model}' AS model, term, round(estimate, 4) AS estimate, round(std_error, 4) AS std_error, round(estimate / std_error, 3) AS statistic,
    round((SELECT abs(p_{size}) FROM par{LAPLACE_ROUNDS}), 4) AS group_sd, round((SELECT f FROM la{last}_f WHERE pt = 0), 4) AS loglik
  FROM be JOIN se USING (term_no) JOIN {_labels(["(Intercept)", *terms])} ON i = term_no"""
