"""DuckDB SQL that grows a small boosted ensemble by the rules of ``operators.booster``.

A level of a tree is a group of CTEs: sums by (node, feature, bin), bins in order (levels by
mean gradient), cumulative sums, the gain of every cut and side of the missing bin, the best
one of each node, and the rows sent down. Leaf limits are not mirrored (they do not bind
here); trees go level by level, which gives the same trees as best leaf first.
"""
from __future__ import annotations

from ..operators.booster import GRID, NUMERIC_BINS, Params
from ..schema import NUMERIC_FEATURES

#: What the registered queries with an oracle fit.
SMALL = Params(learning_rate=0.3, max_iter=2, max_leaf_nodes=None, max_depth=3, min_samples_leaf=50, l2=1.5)
#: Categorical features that have levels in the view (two are always null).
LEVELS = ["currency", "colour_1", "material_1", "material_2", "reclining", "pull_out_bed", "storage"]
FEATURES = [*NUMERIC_FEATURES, *LEVELS]


def _bins() -> str:
    probs = "[" + ", ".join(repr(k / NUMERIC_BINS) for k in range(1, NUMERIC_BINS)) + "]"
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs}))) AS e_{c}" for c in NUMERIC_FEATURES)
    levels = ", ".join(f"list_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER (WHERE {c} IS NOT NULL)) AS v_{c}" for c in LEVELS)
    sizes = "\nUNION ALL ".join(
        [f"SELECT {i} AS f, len(e_{c}) + 2 AS nb, true AS num FROM ed" for i, c in enumerate(NUMERIC_FEATURES)]
        + [f"SELECT {i} AS f, len(v_{c}) + 1 AS nb, false AS num FROM lvl" for i, c in enumerate(LEVELS, len(NUMERIC_FEATURES))])
    return f""",
tr AS MATERIALIZED (SELECT *, CAST(floor(price * {GRID} + 0.5) AS BIGINT) AS y FROM train WHERE price < 90000.0),
ed AS MATERIALIZED (SELECT {edges} FROM tr),
lvl AS MATERIALIZED (SELECT {levels} FROM train),
fe AS MATERIALIZED ({sizes})"""


def _long(name: str, source: str, key: str) -> str:
    """Bins of the rows of ``source``, a row for each feature."""
    parts = []
    for i, c in enumerate(NUMERIC_FEATURES):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT {key} AS k, {i} AS f, CASE WHEN {c} IS NULL OR NOT isfinite({x}) THEN len(e_{c}) + 1 "
                     f"ELSE len(list_filter(e_{c}, lambda q: q < {x})) END AS b FROM {source}, ed")
    for i, c in enumerate(LEVELS, len(NUMERIC_FEATURES)):
        x = f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT {key}, {i}, CASE WHEN list_contains(v_{c}, {x}) THEN list_position(v_{c}, {x}) - 1 ELSE len(v_{c}) END FROM {source}, lvl")
    return f",\n{name} AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def _sent(name: str, cur: str, rows: str, best: str, sets: str) -> str:
    """The rows one level down."""
    return f""",
{name} AS MATERIALIZED (SELECT c.k, c.path || CASE WHEN x.f IS NULL THEN '' WHEN l.b = x.nb - 1 THEN (CASE WHEN x.missing_left THEN 'l' ELSE 'r' END)
    WHEN list_contains(z.bins, l.b) THEN 'l' ELSE 'r' END AS path
  FROM {cur} c LEFT JOIN {best} x ON x.path = c.path LEFT JOIN {sets} z ON z.path = c.path LEFT JOIN {rows} l ON l.k = c.k AND l.f = x.f)"""


def ensemble(p: Params = SMALL) -> str:
    """CTEs ``base``, and for tree t ``best_t_d``, ``set_t_d`` and ``leaf_t``."""
    sql = _bins() + _long("rows", "tr", "listing_key") + """,
base AS MATERIALIZED (SELECT CAST(floor(CAST(sum(y) AS HUGEINT) // count(*)) AS BIGINT) AS v FROM tr),
s_0 AS MATERIALIZED (SELECT listing_key AS k, y, v AS score FROM tr, base)"""
    least, l2 = p.min_samples_leaf, p.l2
    for t in range(p.max_iter):
        sql += f""",
g_{t} AS MATERIALIZED (SELECT k, score - y AS g FROM s_{t}),
cur_{t}_0 AS MATERIALIZED (SELECT k, '' AS path FROM g_{t})"""
        for d in range(p.max_depth):
            sql += f""",
node_{t}_{d} AS MATERIALIZED (SELECT path, count(*) AS n, CAST(sum(g) AS BIGINT) AS tot FROM cur_{t}_{d} JOIN g_{t} USING (k)
  WHERE length(path) = {d} GROUP BY path HAVING count(*) >= {2 * least if d else 0}),
h_{t}_{d} AS MATERIALIZED (SELECT path, f, b, CAST(sum(g) AS BIGINT) AS s, count(*) AS m FROM cur_{t}_{d} JOIN g_{t} USING (k) JOIN rows USING (k)
  WHERE path IN (SELECT path FROM node_{t}_{d}) GROUP BY path, f, b),
o_{t}_{d} AS (
  SELECT a.path, a.f, a.b, a.b AS pos, coalesce(h.s, 0) AS s, coalesce(h.m, 0) AS m
    FROM (SELECT path, f, unnest(range(nb - 1)) AS b FROM node_{t}_{d}, fe WHERE num) a LEFT JOIN h_{t}_{d} h ON h.path = a.path AND h.f = a.f AND h.b = a.b
  UNION ALL SELECT path, h.f, b, row_number() OVER (PARTITION BY path, h.f ORDER BY CAST(s AS DOUBLE) / (m + {l2!r}), b), s, m
    FROM h_{t}_{d} h JOIN fe ON fe.f = h.f WHERE NOT num AND b < nb - 1),
c_{t}_{d} AS MATERIALIZED (SELECT *, CAST(sum(s) OVER w AS BIGINT) AS cs, CAST(sum(m) OVER w AS BIGINT) AS cm FROM o_{t}_{d}
  WINDOW w AS (PARTITION BY path, f ORDER BY pos)),
q_{t}_{d} AS (SELECT c.path, c.f, c.pos, fe.nb, n, tot, side, cs + CASE WHEN side = 1 THEN z.s ELSE 0 END AS ls, cm + CASE WHEN side = 1 THEN z.m ELSE 0 END AS lm
  FROM c_{t}_{d} c JOIN fe ON fe.f = c.f JOIN node_{t}_{d} USING (path) LEFT JOIN h_{t}_{d} z ON z.path = c.path AND z.f = c.f AND z.b = fe.nb - 1,
  (VALUES (1), (2), (3)) v(side) WHERE (z.m IS NULL) = (side = 3)),
best_{t}_{d} AS MATERIALIZED (SELECT *, CASE side WHEN 1 THEN true WHEN 2 THEN false ELSE 2 * lm >= n END AS missing_left FROM (
  SELECT *, CAST(ls AS DOUBLE) * CAST(ls AS DOUBLE) / (lm + {l2!r}) + CAST(tot - ls AS DOUBLE) * CAST(tot - ls AS DOUBLE) / (n - lm + {l2!r})
    - CAST(tot AS DOUBLE) * CAST(tot AS DOUBLE) / (n + {l2!r}) AS gain FROM q_{t}_{d} WHERE lm >= {least} AND n - lm >= {least})
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, f, side, pos) = 1),
set_{t}_{d} AS MATERIALIZED (SELECT x.path, list(c.b ORDER BY c.b) AS bins FROM best_{t}_{d} x JOIN c_{t}_{d} c ON c.path = x.path AND c.f = x.f AND c.pos <= x.pos
  GROUP BY x.path)""" + _sent(f"cur_{t}_{d + 1}", f"cur_{t}_{d}", "rows", f"best_{t}_{d}", f"set_{t}_{d}")
        sql += f""",
leaf_{t} AS MATERIALIZED (SELECT path, count(*) AS n, CAST(sum(g) AS BIGINT) AS tot,
    CAST(floor({-p.learning_rate!r} * CAST(sum(g) AS DOUBLE) / (count(*) + {l2!r}) + 0.5) AS BIGINT) AS value
  FROM cur_{t}_{p.max_depth} JOIN g_{t} USING (k) GROUP BY path),
s_{t + 1} AS MATERIALIZED (SELECT k, y, score + value AS score FROM s_{t} JOIN cur_{t}_{p.max_depth} USING (k) JOIN leaf_{t} USING (path))"""
    return sql


def nodes(p: Params = SMALL) -> str:
    """The ensemble's nodes."""
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES))
    inner = [f"SELECT {t} AS tree, x.path, CASE x.f {names} END AS feature, array_to_string(bins, ',') AS left_bins, missing_left, "
             f"n, tot AS total, CAST(0 AS BIGINT) AS value FROM best_{t}_{d} x JOIN set_{t}_{d} z ON z.path = x.path"
             for t in range(p.max_iter) for d in range(p.max_depth)]
    leaves = [f"SELECT {t}, path, NULL, NULL, NULL, n, tot, value FROM leaf_{t}" for t in range(p.max_iter)]
    return "\nUNION ALL ".join(inner + leaves)


def scored(source: str, key: str, p: Params = SMALL) -> str:
    """CTE ``price_of`` (k, predicted_price) for the rows of ``source``."""
    sql = _long("own", source, key)
    for t in range(p.max_iter):
        sql += f",\nto_{t}_0 AS (SELECT {key} AS k, '' AS path FROM {source})"
        for d in range(p.max_depth):
            sql += _sent(f"to_{t}_{d + 1}", f"to_{t}_{d}", "own", f"best_{t}_{d}", f"set_{t}_{d}")
    ends = "\nUNION ALL ".join(f"SELECT k, value FROM to_{t}_{p.max_depth} JOIN leaf_{t} USING (path)" for t in range(p.max_iter))
    return sql + f",\nprice_of AS (SELECT k, CAST(sum(value) + max(v) AS DOUBLE) / {GRID} AS predicted_price FROM ({ends}), base GROUP BY k)"
