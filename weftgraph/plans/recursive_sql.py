"""SQL of the iterative queries: recursive common table expressions that follow the same rounds as the DataFrame loops.

Each builder takes the expressions of a graph (e(u, v, w) edges, n(id) vertices) or of a
hypergraph (i(h, v) incidences).  A plain recursion sees the rows of its last round only, so a
state is carried whole from round to round; the answer is the state of the last one.
"""

from __future__ import annotations

import math

from weftgraph.functions.hashing import ROUNDS32, ROUNDS64

_FULL = "18446744073709551616::UHUGEINT"
#: Added before rounding: scores are often fractions that lie on a tie of the last digit, where the order of sums would decide.
OFF_9, OFF_6 = 1.2345e-10, 1.2345e-7


def _let(expr: str, body: str) -> str:
    """``body`` with x standing for ``expr``."""
    return f"list_transform([{expr}], lambda x: {body})[1]"


def mix32(expr: str) -> str:
    """The 32-bit integer mix of the low 32 bits, as a BIGINT."""
    out = f"CAST({expr} AS BIGINT) % 4294967296"
    for constant, first, second, shift in ROUNDS32:
        a = f"(x + {constant})" if first == "+" else f"xor(x, {constant}::BIGINT)"
        b = f"(x * {1 << shift})" if shift > 0 else f"(x >> {-shift})"
        both = f"({a} + {b}) % 4294967296" if second == "+" else f"xor({a} % 4294967296, {b} % 4294967296)"
        out = _let(out, both)
    return out


def mix64(expr: str) -> str:
    """The 64-bit integer mix, as a UBIGINT."""
    out = f"CAST({expr} AS UBIGINT)"
    for constant, first, second, shift in ROUNDS64:
        a = f"CAST((x::UHUGEINT + {constant}::UHUGEINT) % {_FULL} AS UBIGINT)" if first == "+" else f"xor(x, {constant}::UBIGINT)"
        b = f"CAST((x::UHUGEINT * {1 << shift}::UHUGEINT) % {_FULL} AS UBIGINT)" if shift > 0 else f"(x >> {-shift})"
        both = f"CAST(({a}::UHUGEINT + {b}::UHUGEINT) % {_FULL} AS UBIGINT)" if second == "+" else f"xor({a}, {b})"
        out = _let(out, both)
    return out


def step64(expr: str) -> str:
    """One step of the combined generator, as a UBIGINT."""
    times = lambda x, c: f"CAST(({x}::UHUGEINT * {c}::UHUGEINT) % {_FULL} AS UBIGINT)"
    out = f"CAST((({expr})::UHUGEINT * 3935559000370003845::UHUGEINT % {_FULL} + 2691343689449507681::UHUGEINT) % {_FULL} AS UBIGINT)"
    for shift in (-21, 37, -4, None, 20, -41, 5):
        out = _let(out, times("x", 4768777513237032717) if shift is None else f"xor(x, {times('x', 1 << shift)})" if shift > 0 else f"xor(x, x >> {-shift})")
    return out


def _last(state: str, columns: str) -> str:
    return f"SELECT {columns} FROM {state} WHERE k = (SELECT max(k) FROM {state})"


def dependency(base: str) -> str:
    return f"""WITH RECURSIVE {base}, b(id, lvl) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0 UNION
 SELECT e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v),
 g(lvl, id, sigma) AS (SELECT 0, CAST(0 AS BIGINT), 1.0::DOUBLE UNION ALL
 SELECT g.lvl + 1, e.v, sum(g.sigma) FROM g JOIN e ON e.u = g.id JOIN b ON b.id = e.v AND b.lvl = g.lvl + 1 GROUP BY g.lvl + 1, e.v),
 d(lvl, id, sigma, score) AS (SELECT lvl, id, sigma, 0.0::DOUBLE FROM g WHERE lvl = (SELECT max(lvl) FROM g) UNION ALL
 SELECT x.lvl, x.id, x.sigma, x.sigma * coalesce(sum((1 + d.score) / d.sigma), 0) FROM (SELECT DISTINCT lvl - 1 AS l FROM d) q JOIN g x ON x.lvl = q.l
 LEFT JOIN e ON e.u = x.id LEFT JOIN d ON d.id = e.v GROUP BY x.lvl, x.id, x.sigma)
 SELECT n.id, d.sigma, round(d.score + {OFF_6}::DOUBLE, 6) AS score FROM n LEFT JOIN d ON d.id = n.id"""


def hyper_dependency(base: str) -> str:
    """``base`` also has m(base): hyperedges are the ids from there on, vertices lie on even levels."""
    return f"""{base}, b(id, lvl) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), 0 UNION
 SELECT e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v WHERE r.id IS NULL GROUP BY e.v),
 g(lvl, id, sigma) AS (SELECT 0, CAST(0 AS BIGINT), 1.0::DOUBLE UNION ALL
 SELECT g.lvl + 1, e.v, sum(g.sigma) FROM g JOIN e ON e.u = g.id JOIN b ON b.id = e.v AND b.lvl = g.lvl + 1 GROUP BY g.lvl + 1, e.v),
 d(lvl, id, sigma, score) AS (SELECT lvl, id, sigma, CASE WHEN lvl % 2 = 0 AND lvl > 0 THEN 1.0::DOUBLE ELSE 0.0 END FROM g WHERE lvl = (SELECT max(lvl) FROM g) UNION ALL
 SELECT x.lvl, x.id, x.sigma, CASE WHEN x.lvl % 2 = 1 THEN coalesce(sum(d.score / d.sigma), 0) ELSE (CASE WHEN x.lvl > 0 THEN 1 ELSE 0 END) + x.sigma * coalesce(sum(d.score), 0) END
 FROM (SELECT DISTINCT lvl - 1 AS l FROM d) q JOIN g x ON x.lvl = q.l LEFT JOIN e ON e.u = x.id LEFT JOIN d ON d.id = e.v GROUP BY x.lvl, x.id, x.sigma)
 SELECT CASE WHEN n.id < base THEN 'v' ELSE 'h' END AS kind, CASE WHEN n.id < base THEN n.id ELSE n.id - base END AS id, d.sigma, round(d.score + {OFF_6}::DOUBLE, 6) AS score
 FROM n CROSS JOIN m LEFT JOIN d ON d.id = n.id"""


def pagerank_delta(base: str) -> str:
    return f"""WITH RECURSIVE {base}, c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM n), g AS (SELECT u, count(*) AS d FROM e GROUP BY u),
 s(k, id, score, delta, active) AS (SELECT 0, id, 0.0::DOUBLE, 1.0::DOUBLE / c.n, true FROM n CROSS JOIN c UNION ALL
 SELECT s.k + 1, s.id, CASE WHEN s.k = 0 THEN s.score + t.x + (1 - 0.85::DOUBLE) / c.n WHEN abs(t.x) > 0.01::DOUBLE * s.score THEN s.score + t.x ELSE s.score END,
  CASE WHEN s.k = 0 THEN t.x + (1 - 0.85::DOUBLE) / c.n - 1.0::DOUBLE / c.n ELSE t.x END,
  CASE WHEN s.k = 0 THEN abs(t.x + (1 - 0.85::DOUBLE) / c.n - 1.0::DOUBLE / c.n) > 0.01::DOUBLE * (s.score + t.x + (1 - 0.85::DOUBLE) / c.n) ELSE abs(t.x) > 0.01::DOUBLE * s.score END
 FROM s CROSS JOIN c JOIN (SELECT n.id, 0.85::DOUBLE * coalesce(x, 0) AS x FROM n LEFT JOIN (SELECT e.v, sum(a.delta / g.d) AS x FROM e JOIN s a ON a.id = e.u AND a.active JOIN g ON g.u = e.u GROUP BY e.v) ON v = n.id) t ON t.id = s.id
 WHERE s.k < 100 AND (s.k = 0 OR (SELECT sum(abs(delta)) FROM s) >= 1e-7))
 {_last("s", "id, round(score * (SELECT n FROM c), 6) AS score")}"""


def factorize(base: str, k: int = 20, rounds: int = 5) -> str:
    """Coordinates that start equal stay equal, so one number a vertex stands for all ``k``."""
    ctes = [base, "x0 AS (SELECT id, 0.5::DOUBLE AS x FROM n)"]
    for r in range(rounds):
        ctes.append(
            f"x{r + 1} AS (SELECT o.id, o.x + 3.5e-7::DOUBLE * (-0.001::DOUBLE * o.x + coalesce(g, 0)) AS x FROM x{r} o LEFT JOIN (SELECT e.v, sum((e.w - {k} * a.x * b.x) * a.x) AS g FROM e JOIN x{r} a ON a.id = e.u JOIN x{r} b ON b.id = e.v GROUP BY e.v) ON v = o.id)"
        )
    return "WITH " + ", ".join(ctes) + f" SELECT id, CAST(range AS INTEGER) AS coordinate, round(x, 9) AS x FROM x{rounds} CROSS JOIN range({k})"


def radii(base: str) -> str:
    return f"""WITH RECURSIVE {base}, q AS (SELECT DISTINCT CAST({mix64("range")} % (SELECT count(*) FROM n) AS BIGINT) AS id FROM range(64)),
 b(s, id, lvl) USING KEY (s, id) AS (SELECT id, id, 0 FROM q UNION
 SELECT b.s, e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v AND r.s = b.s WHERE r.id IS NULL GROUP BY b.s, e.v)
 SELECT n.id, CAST(max(lvl) AS INTEGER) AS value FROM n LEFT JOIN b ON b.id = n.id GROUP BY n.id"""


def set_cover(base: str, epsilon: float = 0.01) -> str:
    up = f"{1.0 + epsilon}::DOUBLE"
    level = f"CAST(floor({1.0 / math.log(1.0 + epsilon)!r}::DOUBLE * ln(CAST(d AS DOUBLE))) AS BIGINT)"
    return f"""WITH RECURSIVE {base}, s(k, id, bkt, inc, cov) AS (SELECT 0, n.id, CASE WHEN d > 0 THEN {level} END, false, false FROM n LEFT JOIN (SELECT u, count(*) AS d FROM e GROUP BY u) ON u = n.id UNION ALL
 (WITH t AS (SELECT max(bkt) AS top FROM s), a AS (SELECT s.id FROM s JOIN t ON s.bkt = t.top),
  l AS (SELECT e.u, e.v FROM e JOIN a ON a.id = e.u JOIN s ON s.id = e.v WHERE NOT s.cov),
  z AS (SELECT a.id, count(l.u) AS d FROM a LEFT JOIN l ON l.u = a.id GROUP BY a.id),
  w AS (SELECT l.v, min(l.u) AS id FROM l JOIN z ON z.id = l.u CROSS JOIN t WHERE z.d >= ceil(pow({up}, t.top)) GROUP BY l.v),
  j AS (SELECT w.id FROM w CROSS JOIN t GROUP BY w.id, t.top HAVING count(*) >= greatest(ceil(pow({up}, t.top - 1)), 1))
  SELECT s.k + 1, s.id, CASE WHEN j.id IS NOT NULL THEN NULL WHEN z.id IS NOT NULL THEN CASE WHEN z.d > 0 THEN {level.replace("CAST(d ", "CAST(z.d ")} END ELSE s.bkt END, s.inc OR j.id IS NOT NULL,
   s.cov OR (w.v IS NOT NULL AND w.id IN (SELECT id FROM j))
  FROM s LEFT JOIN z ON z.id = s.id LEFT JOIN j ON j.id = s.id LEFT JOIN w ON w.v = s.id WHERE (SELECT top FROM t) IS NOT NULL))
 {_last("s", "id, inc AS in_cover")}"""


def hyper_bpath(incidence: str) -> str:
    return f"""WITH RECURSIVE {incidence}, z AS (SELECT h, count(*) AS c FROM i GROUP BY h),
 b(kind, id, lvl) USING KEY (kind, id) AS (SELECT 'v', CAST(0 AS BIGINT), 0 UNION
 SELECT * FROM (SELECT 'h' AS kind, i.h AS id, max(r.lvl) + 1 AS lvl FROM i JOIN recurring.b r ON r.kind = 'v' AND r.id = i.v JOIN z ON z.h = i.h
   WHERE NOT EXISTS (SELECT 1 FROM recurring.b f WHERE f.kind = 'h' AND f.id = i.h) GROUP BY i.h, z.c HAVING count(*) = z.c
  UNION ALL SELECT 'v', i.v, min(b.lvl) + 1 FROM b JOIN i ON i.h = b.id WHERE b.kind = 'h' AND NOT EXISTS (SELECT 1 FROM recurring.b f WHERE f.kind = 'v' AND f.id = i.v) GROUP BY i.v))
 SELECT 'v' AS kind, p_partkey AS id, b.id IS NOT NULL AS reached, lvl AS level FROM part LEFT JOIN b ON b.kind = 'v' AND b.id = p_partkey
 UNION ALL SELECT 'h', z.h, b.id IS NOT NULL, lvl FROM z LEFT JOIN b ON b.kind = 'h' AND b.id = z.h"""


def hyper_independent_set(incidence: str, inverse_probability: int = 3) -> str:
    """Rows of kind 'v' carry the flags, rows of kind 'p' the incidences that are left."""
    return f"""WITH RECURSIVE {incidence}, s(k, kind, h, v, flag, done) AS (SELECT 1, 'v', CAST(0 AS BIGINT), p_partkey, 0, CAST(0 AS BIGINT) FROM part UNION ALL SELECT 1, 'p', h, v, 0, 0 FROM i UNION ALL
 (WITH o AS (SELECT v FROM s WHERE kind = 'v' AND flag = 0), t AS (SELECT count(*) AS c FROM o),
  drawn AS (SELECT s.v FROM s WHERE kind = 'v' AND flag = 0 AND {mix64("s.v + s.done")} % {inverse_probability} = 0), l AS (SELECT h, v FROM s WHERE kind = 'p'),
  whole AS (SELECT l.h FROM l LEFT JOIN drawn ON drawn.v = l.v GROUP BY l.h HAVING count(drawn.v) = count(*)),
  kept AS (SELECT v FROM drawn WHERE v NOT IN (SELECT v FROM l WHERE h IN (SELECT h FROM whole))),
  rest AS (SELECT h, v FROM l WHERE v NOT IN (SELECT v FROM kept)), sizes AS (SELECT h, count(*) AS c, min(v) AS v FROM rest GROUP BY h)
  SELECT s.k + 1, 'v', CAST(0 AS BIGINT), s.v, CASE WHEN s.flag <> 0 THEN s.flag WHEN s.v IN (SELECT v FROM kept) THEN s.k + 1 WHEN s.v IN (SELECT v FROM sizes WHERE c = 1) THEN 1 ELSE 0 END, s.done + (SELECT c FROM t)
  FROM s WHERE kind = 'v' AND (SELECT c FROM t) > 0
  UNION ALL SELECT (SELECT max(k) FROM s) + 1, 'p', h, v, 0, 0 FROM rest WHERE h IN (SELECT h FROM sizes WHERE c > 1) AND (SELECT c FROM t) > 0))
 {_last("s", "v AS id, flag, flag >= 2 AS in_set")} AND kind = 'v'"""


def hyper_kcore(incidence: str) -> str:
    return f"""WITH RECURSIVE {incidence}, s(k, kind, id, d, core, low) AS (
 SELECT 0, 'v', p_partkey, count(i.h), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM part LEFT JOIN i ON i.v = p_partkey GROUP BY p_partkey UNION ALL SELECT DISTINCT 0, 'h', h, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM i UNION ALL
 (WITH t AS (SELECT greatest(max(low), min(d) FILTER (WHERE kind = 'v' AND core IS NULL)) AS low, count(*) FILTER (WHERE kind = 'v' AND core IS NULL) AS open FROM s),
  gone AS (SELECT s.id FROM s CROSS JOIN t WHERE kind = 'v' AND core IS NULL AND d <= t.low),
  killed AS (SELECT DISTINCT i.h FROM i JOIN gone ON gone.id = i.v JOIN s ON s.kind = 'h' AND s.id = i.h AND s.d = 0),
  cut AS (SELECT i.v, count(*) AS c FROM i JOIN killed ON killed.h = i.h GROUP BY i.v)
  SELECT s.k + 1, s.kind, s.id, CASE WHEN s.kind = 'v' THEN s.d - coalesce(cut.c, 0) WHEN killed.h IS NOT NULL THEN 1 ELSE s.d END, CASE WHEN s.kind = 'v' AND gone.id IS NOT NULL THEN t.low ELSE s.core END, t.low
  FROM s CROSS JOIN t LEFT JOIN gone ON s.kind = 'v' AND gone.id = s.id LEFT JOIN killed ON s.kind = 'h' AND killed.h = s.id LEFT JOIN cut ON s.kind = 'v' AND cut.v = s.id WHERE t.open > 0))
 {_last("s", "id, CAST(core AS INTEGER) AS value")} AND kind = 'v'"""


# ---- eccentricity: everything is counted out of the distances of all pairs -------------------


def _pairs(base: str) -> str:
    return f"""WITH RECURSIVE {base}, b(s, id, lvl) USING KEY (s, id) AS (SELECT id, id, 0 FROM n UNION
 SELECT b.s, e.v, min(b.lvl) + 1 FROM b JOIN e ON e.u = b.id LEFT JOIN recurring.b r ON r.id = e.v AND r.s = b.s WHERE r.id IS NULL GROUP BY b.s, e.v),
 parts AS (SELECT id, min(s) AS label, count(*) AS size FROM b GROUP BY id), ecc AS (SELECT s AS id, max(lvl) AS e FROM b GROUP BY s)"""


def _order(seed: int, column: str = "id") -> str:
    return f"md5('{seed}#' || {column})"


def _bits(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}#' || id), 1, 15) AS BIGINT)"


_SMALL = "CAST(CASE WHEN size = 1 THEN 0 WHEN size = 2 THEN 1 ELSE {} END AS INTEGER)"


def _sampled(most: str, where: str = "true") -> str:
    return f"(SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_order(1)}, id) AS r FROM parts WHERE {where}) WHERE r <= {most})"


def kbfs(base: str, two_phase: bool, per: int = 64, large: int = 1024) -> str:
    first = f"{_pairs(base)}, q1 AS {_sampled(str(per))}, f1 AS (SELECT b.id, max(lvl) AS value FROM b JOIN q1 ON q1.id = b.s GROUP BY b.id)"
    if not two_phase:
        return f"{first} SELECT parts.id, {_SMALL.format('coalesce(value, 0)')} AS value FROM parts JOIN f1 ON f1.id = parts.id"
    return f"""{first}, q2 AS (SELECT id FROM (SELECT parts.id, row_number() OVER (PARTITION BY label ORDER BY value DESC, parts.id) AS r FROM parts JOIN f1 ON f1.id = parts.id WHERE size > {large}) WHERE r <= {per}),
 f2 AS (SELECT b.id, max(lvl) AS value FROM b JOIN q2 ON q2.id = b.s GROUP BY b.id)
 SELECT parts.id, {_SMALL.format('greatest(coalesce(f1.value, 0), coalesce(f2.value, 0))')} AS value FROM parts JOIN f1 ON f1.id = parts.id LEFT JOIN f2 ON f2.id = parts.id"""


def sketch(base: str) -> str:
    """A mask grows when the nearest vertex of another lowest bit is heard of."""
    return f"""{_pairs(base)}, q AS (SELECT id, CASE WHEN h = 0 THEN 1 ELSE h & -h END AS low FROM (SELECT id, {_bits(1)} AS h FROM n))
 SELECT id, CAST(max(near) AS INTEGER) AS value FROM (SELECT b.id, q.low, min(lvl) AS near FROM b JOIN q ON q.id = b.s GROUP BY b.id, q.low) GROUP BY id"""


def registers(base: str, count: int = 10) -> str:
    """A register grows last when the nearest vertex of its greatest reachable value is heard of."""
    return f"""{_pairs(base)}, q AS (SELECT id, {_bits(1)} % {count} AS slot, CASE WHEN h = 0 THEN 63 ELSE least(63, CAST(round(log2(CAST(h & -h AS DOUBLE))) AS INTEGER) + 1) END AS z FROM (SELECT id, {_bits(2)} AS h FROM n))
 SELECT id, CAST(max(lvl) AS INTEGER) AS value FROM (SELECT b.id, q.slot, min_by(lvl, (-q.z, lvl)) AS lvl FROM b JOIN q ON q.id = b.s GROUP BY b.id, q.slot) GROUP BY id"""


def two_approximation(base: str) -> str:
    return f"{_pairs(base)}, q AS {_sampled('1')} SELECT b.id, CAST(e AS INTEGER) AS value FROM b JOIN q ON q.id = b.s JOIN ecc ON ecc.id = q.id"


def _near_sets(base: str) -> str:
    size = "CAST(size AS DOUBLE)"
    return f"""{_pairs(base)}, sz AS (SELECT *, least(size, floor(sqrt({size} * log2({size})))) AS near FROM parts WHERE size > 2),
 cn AS (SELECT *, least(size, greatest(10, floor({size} / greatest(near, 1) * log2({size})))) AS most FROM sz),
 q1 AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_order(1)}, id) AS r FROM cn) WHERE r <= most),
 d1 AS (SELECT b.id, min(lvl) AS d_near, max(lvl) AS d_far FROM b JOIN q1 ON q1.id = b.s GROUP BY b.id),
 w AS (SELECT label, arg_max(d1.id, (d_near, -d1.id)) AS id FROM d1 JOIN sz ON sz.id = d1.id GROUP BY label),
 fw AS (SELECT b.id, b.s, b.lvl AS d_w FROM b JOIN w ON w.id = b.s),
 q2 AS (SELECT id, label FROM (SELECT fw.id, sz.label, near, row_number() OVER (PARTITION BY sz.label ORDER BY d_w, fw.id) AS r FROM fw JOIN sz ON sz.id = fw.id) WHERE r <= near)"""


def lower_bounds(base: str) -> str:
    return f"""{_near_sets(base)}, q AS (SELECT id FROM q1 UNION SELECT id FROM q2 UNION SELECT id FROM w),
 f AS (SELECT b.id, max(greatest(lvl, e - lvl)) AS value FROM b JOIN q ON q.id = b.s JOIN ecc ON ecc.id = b.s GROUP BY b.id)
 SELECT parts.id, {_SMALL.format('coalesce(value, 0)')} AS value FROM parts LEFT JOIN f ON f.id = parts.id"""


def near_set_estimate(base: str) -> str:
    return f"""{_near_sets(base)}, q AS (SELECT id FROM q1 UNION SELECT id FROM q2 UNION SELECT id FROM w),
 lo AS (SELECT label, min(e) AS min_s FROM q1 JOIN ecc ON ecc.id = q1.id GROUP BY label),
 t AS (SELECT b.id, min((b.lvl, b.s)) AS t FROM b JOIN q2 ON q2.id = b.s GROUP BY b.id)
 SELECT sz.id, CAST(CASE WHEN q.id IS NOT NULL THEN own.e WHEN t.t[1] <= tw.d_w THEN greatest(d_far, fw.d_w, et.e) ELSE greatest(d_far, fw.d_w, min_s) END AS INTEGER) AS value
 FROM sz JOIN d1 ON d1.id = sz.id JOIN fw ON fw.id = sz.id JOIN t ON t.id = sz.id JOIN fw tw ON tw.id = t.t[2] JOIN ecc et ON et.id = t.t[2] JOIN ecc own ON own.id = sz.id JOIN lo ON lo.label = sz.label LEFT JOIN q ON q.id = sz.id
 UNION ALL SELECT id, CAST(size - 1 AS INTEGER) FROM parts WHERE size <= 2"""


# ---- local clustering -----------------------------------------------------------------------

_SCORES = f"id, round(score + {OFF_9}::DOUBLE, 9) AS score"
_DEG = "g AS (SELECT u, CAST(count(*) AS DOUBLE) AS d FROM e GROUP BY u)"


def nibble(base: str, steps: int = 10, epsilon: float = 1e-9) -> str:
    return f"""WITH RECURSIVE {base}, {_DEG}, s(k, id, score) AS (SELECT 0, CAST(0 AS BIGINT), 1.0::DOUBLE UNION ALL
 SELECT k + 1, id, sum(x) FROM (SELECT s.k, s.id, s.score / 2 AS x FROM s JOIN g ON g.u = s.id WHERE s.score > d * {epsilon!r}::DOUBLE
  UNION ALL SELECT s.k, e.v, s.score / (2 * d) FROM s JOIN g ON g.u = s.id JOIN e ON e.u = s.id WHERE s.score > d * {epsilon!r}::DOUBLE) WHERE k < {steps} GROUP BY k, id)
 {_last("s", _SCORES)}"""


def push_pagerank(base: str, optimised: bool, alpha: float = 0.15, epsilon: float = 1e-9) -> str:
    take = 2 * alpha / (1 + alpha) if optimised else alpha
    keep = 0.0 if optimised else (1 - alpha) / 2
    give = (1 - alpha) / (1 + alpha) if optimised else (1 - alpha) / 2
    act = f"s.r > g.d * {epsilon!r}::DOUBLE"
    return f"""WITH RECURSIVE {base}, {_DEG}, s(k, id, p, r) AS (SELECT 0, CAST(0 AS BIGINT), 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
 SELECT k + 1, id, sum(p), sum(r) FROM (
  SELECT s.k, s.id, CASE WHEN {act} THEN s.p + {take!r}::DOUBLE * s.r ELSE s.p END AS p, CASE WHEN {act} THEN {keep!r}::DOUBLE * s.r ELSE s.r END AS r FROM s LEFT JOIN g ON g.u = s.id
  UNION ALL SELECT s.k, e.v, 0.0, sum({give!r}::DOUBLE * s.r / g.d) FROM s JOIN g ON g.u = s.id JOIN e ON e.u = s.id WHERE {act} GROUP BY s.k, e.v)
 WHERE (SELECT count(*) FROM s JOIN g ON g.u = s.id WHERE {act}) > 0 GROUP BY k, id)
 SELECT id, round(p + {OFF_9}::DOUBLE, 9) AS score FROM s WHERE k = (SELECT max(k) FROM s) AND p > 0"""


def heat_kernel(base: str, psi: list[float], t: float = 3.0, epsilon: float = 1e-9) -> str:
    levels = len(psi)
    ctes = [base, _DEG, "r0 AS (SELECT CAST(0 AS BIGINT) AS id, 1.0::DOUBLE AS x)"]
    for j in range(levels):
        bound = math.exp(t) * epsilon / (2.0 * levels * psi[j])
        keep = f"WHERE x >= d * {bound!r}::DOUBLE" if j else ""
        ctes.append(f"a{j} AS (SELECT id, x, d FROM r{j} JOIN g ON g.u = id {keep})")
        share = "x / d" if j + 1 == levels else f"{t / (j + 1)!r}::DOUBLE * x / d"
        ctes.append(f"r{j + 1} AS (SELECT e.v AS id, sum({share}) AS x FROM a{j} JOIN e ON e.u = a{j}.id GROUP BY e.v)")
    every = " UNION ALL ".join([f"SELECT id, x FROM a{j}" for j in range(levels)] + [f"SELECT id, x FROM r{levels}"])
    return "WITH " + ", ".join(ctes) + f" SELECT id, round(sum(x) + {OFF_9}::DOUBLE, 9) AS score FROM ({every}) GROUP BY id"


def heat_walks(base: str, walks: int, longest: int = 10, t: float = 3.0, seed: int = 1) -> str:
    chance, cumulative, total = math.exp(-t), [], 0.0
    for k in range(longest):
        total += chance
        cumulative.append(total)
        chance *= t / (k + 1)
    length = " + ".join(f"CAST(u > {c!r}::DOUBLE AS INTEGER)" for c in cumulative[: longest - 1])
    signed = _let(step64(f"walk * 1000033 + k * 7919 + {seed}"), "CASE WHEN x >= 9223372036854775808 THEN CAST(x AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(x AS HUGEINT) END")
    return f"""WITH RECURSIVE {base}, l AS (SELECT u, list(v ORDER BY v) AS tos, count(*) AS c FROM e GROUP BY u),
 s(k, walk, here, length) AS (SELECT 0, walk, CAST(0 AS BIGINT), {length} FROM (SELECT range AS walk, ({step64(f"range + {seed * 1_000_003}")} % 1073741824) / 1073741824.0::DOUBLE AS u FROM range({walks})) UNION ALL
 SELECT k + 1, walk, CASE WHEN length > k AND c IS NOT NULL THEN tos[CAST(({signed} % c + c) % c AS BIGINT) + 1] ELSE here END, length FROM s LEFT JOIN l ON l.u = s.here WHERE k < {longest})
 SELECT here AS id, round(count(*) / {float(walks)!r}::DOUBLE + {OFF_9}::DOUBLE, 9) AS score FROM s WHERE k = {longest} GROUP BY here"""


# ---- generators -----------------------------------------------------------------------------


def rmat_degrees(seed: int = 1, a: float = 0.5, b: float = 0.10000000149011612) -> str:
    h = f"CAST({mix32(str(seed))} AS HUGEINT)"
    low = lambda x: f"CAST(({x}) % 4294967296 AS BIGINT)"
    half = "CAST(pow(2, levels - k - 1) AS BIGINT)"
    return f"""WITH RECURSIVE c AS (SELECT CAST(ceil(log2(count(*))) AS INTEGER) AS levels FROM part),
 t(k, i, r, st, u, v) AS (SELECT 0, range, {mix32(low(f"2 * CAST(range AS HUGEINT) * {h}"))}, {mix32(low(f"(2 * CAST(range AS HUGEINT) + 1) * {h}"))}, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM (SELECT unnest(range(CAST(10 * (SELECT count(*) FROM part) AS BIGINT))) AS range) UNION ALL
 SELECT k + 1, i, (r + st) % 4294967296, st, u + CASE WHEN p >= {a + b!r} THEN {half} ELSE 0 END, v + CASE WHEN (p >= {a!r} AND p < {a + b!r}) OR p >= {a + b + b!r} THEN {half} ELSE 0 END
 FROM (SELECT *, {mix32("r")} / 4294967295.0::DOUBLE AS p FROM t CROSS JOIN c WHERE k < levels)),
 e AS (SELECT DISTINCT u, v FROM (SELECT u, v, k FROM t UNION ALL SELECT v, u, k FROM t) CROSS JOIN c WHERE k = levels AND u <> v)
 SELECT range AS id, count(e.v) AS degree FROM (SELECT unnest(range(CAST(pow(2, levels) AS BIGINT))) AS range FROM c) LEFT JOIN e ON e.u = range GROUP BY range"""


def local_degrees(dimension: int = 2) -> str:
    return f"""WITH RECURSIVE c AS (SELECT count(*) AS n FROM part),
 t(k, i, h, pow, j, done) AS (SELECT range, range // 10, range, {dimension + 2}, CAST(-1 AS BIGINT), 0 FROM (SELECT unnest(range(CAST(10 * n AS BIGINT))) AS range FROM c) UNION ALL
 SELECT k, i, h2, CASE WHEN done = 0 AND h2 % 1000003 < 500001 THEN pow + {dimension} ELSE pow END, CASE WHEN done = 1 THEN to_ ELSE j END,
  CASE WHEN done = 0 THEN CASE WHEN h2 % 1000003 < 500001 THEN 0 ELSE 1 END WHEN to_ = i THEN 0 ELSE 2 END
 FROM (SELECT *, (i + h2 % CAST(pow(2, pow) AS HUGEINT)) % n AS to_ FROM (SELECT t.*, n, {mix32("h")} AS h2 FROM t CROSS JOIN c WHERE done < 2))),
 d AS (SELECT CAST(i AS BIGINT) AS u, CAST(j AS BIGINT) AS v FROM t WHERE done = 2), e AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM d UNION ALL SELECT v, u FROM d))
 SELECT range AS id, count(e.v) AS degree FROM (SELECT unnest(range(CAST(n AS BIGINT))) AS range FROM c) LEFT JOIN e ON e.u = range GROUP BY range"""


def random_hypergraph(cardinality: int = 3) -> str:
    return f"""SELECT DISTINCT CAST({mix64("range")} % (SELECT count(*) FROM part) AS BIGINT) AS v, range // {cardinality} AS h
 FROM (SELECT unnest(range(CAST(10 * {cardinality} * (SELECT count(*) FROM part) AS BIGINT))) AS range)"""


def _weight(position: str, level: str) -> str:
    return f"CAST(({mix32(position)} % (2 * {level})) // 2 + 1 AS INTEGER)"


def add_weights(base: str) -> str:
    return f"""WITH {base}, c AS (SELECT greatest(1, CAST(floor(log2(count(*))) AS BIGINT)) AS l FROM n),
 p AS (SELECT u, v, {_weight("r", "l")} AS w FROM (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS r, l FROM e CROSS JOIN c))
 SELECT u AS src, v AS dst, w FROM p WHERE u > v UNION ALL SELECT v, u, w FROM p WHERE u > v"""


def add_hyper_weights(incidence: str) -> str:
    return f"""WITH {incidence}, c AS (SELECT greatest(1, CAST(floor(log2(greatest((SELECT count(*) FROM part), count(DISTINCT h)))) AS BIGINT)) AS l FROM i)
 SELECT v, h, {_weight("h", "l")} AS w FROM i CROSS JOIN c"""
