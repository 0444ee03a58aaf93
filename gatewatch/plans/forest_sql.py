"""The fitted isolation forest as DuckDB SQL, for the oracle strings: the same
md5 draws as ``operators.forest``, one pair of CTEs per level."""

from gatewatch.operators.forest import _DRAW_BITS, _H_UNIT, DIGITS, HEX, PIECE_ROWS

_DRAW = f"CAST('0x' || substr(md5({{}}), 1, {_DRAW_BITS // 4}) AS BIGINT)"


def scaled_sql(src: str, features: list[str], scale: bool = True) -> str:
    """CTE ``scaled`` (row_id, forest, x0..) of the features, standardised."""
    if not scale:
        xs = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) AS x{j}" for j, c in enumerate(features))
        return f", scaled AS MATERIALIZED (SELECT row_id, '' AS forest, {xs} FROM {src})"
    stats = ", ".join(f"avg({c}) AS m{j}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{j}"
                      for j, c in enumerate(features))
    xs = ", ".join(f"round(({c} - m{j}) / s{j}, {DIGITS}) AS x{j}" for j, c in enumerate(features))
    return (f", stats AS MATERIALIZED (SELECT {stats} FROM {src})"
            f", scaled AS MATERIALIZED (SELECT row_id, '' AS forest, {xs} FROM {src}, stats)")


def _sample_sql(key: str, levels: int = 10) -> str:
    """CTE ``smp`` (forest, tree, vid, w): the psi rows of smallest hex-digit
    draws of every tree, as counts per vector, over pieces of equal rows."""
    rows = "length(u) - length(replace(u, {}, ''))"
    q = f"""
, sp0 AS MATERIALIZED (SELECT forest, tree, psi AS need, vid, v, k, least({PIECE_ROWS}, w - {PIECE_ROWS} * k) AS open
  FROM (SELECT *, unnest(range((w + {PIECE_ROWS - 1}) // {PIECE_ROWS})) AS k FROM vw) JOIN tr USING (forest))
, hex AS (SELECT unnest(string_split('{HEX}', '')) AS d)"""
    for i in range(levels):
        q += f"""
, su{i} AS MATERIALIZED (SELECT *, left(md5({key.format('s')}, ':', v, ':', k, ':{i}')), CAST(open AS BIGINT)) AS u FROM sp{i} WHERE open > 0)
, sc{i} AS MATERIALIZED (SELECT forest, tree, d, need - cum + c AS rest FROM (
    SELECT *, sum(c) OVER (PARTITION BY forest, tree ORDER BY d) AS cum FROM (
      SELECT forest, tree, need, d, sum({rows.format('d')}) AS c FROM su{i}, hex GROUP BY ALL)) WHERE cum >= need AND cum - c < need)
, sp{i + 1} AS MATERIALIZED (SELECT forest, tree, rest AS need, vid, v, k, {rows.format('d')} AS open,
    len(list_filter(string_split(u, ''), lambda x: x < d)) AS took FROM su{i} JOIN sc{i} USING (forest, tree))"""
    taken = " UNION ALL ".join(f"SELECT forest, tree, vid, took AS w FROM sp{i + 1}" for i in range(levels))
    return q + f"""
, smp AS (SELECT * FROM ({taken} UNION ALL SELECT forest, tree, vid, open FROM sp{levels}) WHERE w > 0)"""


def forest_sql(d: int, k: int, psi: str, trees: str, seed: int = 42, levels: int = 18, src: str = "scaled") -> str:
    """CTEs over ``src`` (row_id, forest, x0..) with ``psi`` and ``trees`` as SQL
    of n. The last, ``path`` (forest, tree, vid, h), has the path length of
    every vector ``vid`` in every tree; ``vec`` maps vectors to values,
    ``prm`` holds n, psi, c(psi) of each forest."""
    xs = [f"x{j}" for j in range(d)]
    key = f"concat('{seed}:', forest, ':{{}}:', tree"
    q = f"""
, prm AS MATERIALIZED (SELECT *, greatest(1, CAST(ceil(log2(greatest(psi, 2))) AS BIGINT)) AS depth,
    2.0 * (ln(psi - 1) + 0.5772156649) - 2.0 * (psi - 1) / psi AS c_psi
  FROM (SELECT *, least(n, CAST({psi} AS BIGINT)) AS psi, CAST({trees} AS BIGINT) AS n_trees
        FROM (SELECT forest, COUNT(*) AS n FROM {src} GROUP BY forest)))
, tr AS MATERIALIZED (SELECT forest, psi, depth, unnest(range(n_trees)) AS tree FROM prm)
, vec AS MATERIALIZED (SELECT {', '.join(xs)}, row_number() OVER (ORDER BY {', '.join(xs)}) AS vid
  FROM (SELECT DISTINCT {', '.join(xs)} FROM {src}))
, vrow AS MATERIALIZED (SELECT row_id, forest, vid FROM {src} JOIN vec USING ({', '.join(xs)}))
, vw AS MATERIALIZED (SELECT forest, vid, min(row_id) AS v, COUNT(*) AS w FROM vrow GROUP BY forest, vid)
{_sample_sql(key)}
, use AS MATERIALIZED (SELECT forest, tree, {', '.join(f'bool_or(j = {j}) AS u{j}' for j in range(d))} FROM (
    SELECT forest, tree, j FROM tr, (SELECT unnest(range({d})) AS j)
    QUALIFY row_number() OVER (PARTITION BY forest, tree ORDER BY md5({key.format('f')}, ':', j)), j) <= {k})
  GROUP BY forest, tree)
, seen AS (SELECT forest, tree, vid, sum(w) AS w FROM smp GROUP BY forest, tree, vid)
, l0 AS MATERIALIZED (SELECT tr.forest, tr.tree, depth, vec.vid, coalesce(w, 0) AS w, CAST(1 AS BIGINT) AS node
  FROM tr CROSS JOIN vec LEFT JOIN seen ON seen.forest = tr.forest AND seen.tree = tr.tree AND seen.vid = vec.vid)"""
    for i in range(levels):
        mm = ", ".join(f"min({x}) FILTER (w > 0) AS lo{j}, max({x}) FILTER (w > 0) AS hi{j}" for j, x in enumerate(xs))
        m = f"md5({key.format('n')}, ':', node, ':', {{}}))"
        options = ", ".join(f"CASE WHEN u{j} AND hi{j} > lo{j} THEN {{'m': {m.format(j)}, 'j': {j}, 'lo': lo{j}, 'hi': hi{j}}} END"
                            for j in range(d))
        u = _DRAW.format(key.format("t") + ", ':', node)")
        x = "CASE f " + " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(xs)) + " END"
        q += f"""
, c{i} AS MATERIALIZED (SELECT forest, tree, node, c.j AS f, CASE WHEN t < c.hi THEN t ELSE c.lo END AS t FROM (
    SELECT *, c.lo + {u} / {float(1 << _DRAW_BITS)} * (c.hi - c.lo) AS t FROM (
      SELECT *, list_min([{options}]) AS c FROM (
        SELECT forest, tree, node, {mm} FROM l{i} JOIN vec USING (vid)
        WHERE depth > {i} AND node >= {1 << i} GROUP BY forest, tree, node) JOIN use USING (forest, tree))
    WHERE c IS NOT NULL))
, l{i + 1} AS MATERIALIZED (SELECT forest, tree, depth, vid, w, CASE WHEN f IS NULL THEN node WHEN {x} <= t THEN node * 2
    ELSE node * 2 + 1 END AS node FROM l{i} JOIN vec USING (vid) LEFT JOIN c{i} USING (forest, tree, node))"""
    return q + f"""
, leaf AS (SELECT forest, tree, node, sum(w) AS n FROM l{levels} GROUP BY forest, tree, node)
, path AS MATERIALIZED (SELECT forest, tree, vid, (length(bin(node)) - 1) * {_H_UNIT} + CAST(round(CASE WHEN n <= 1 THEN 0.0
    WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n END * {_H_UNIT}) AS BIGINT) AS h
  FROM l{levels} JOIN leaf USING (forest, tree, node))"""


def scores_sql(contamination: float) -> str:
    """CTEs ``scored`` (row_id, forest, score) by each row's own forest and
    ``off`` (forest, off, n)."""
    return f"""
, vs AS (SELECT forest, vid, -pow(2.0, -(CAST(sum(h) AS DOUBLE) / ({float(_H_UNIT)} * COUNT(*))) / any_value(c_psi)) AS score
  FROM path JOIN prm USING (forest) GROUP BY forest, vid)
, scored AS MATERIALIZED (SELECT row_id, forest, score FROM vrow JOIN vs USING (forest, vid))
, off AS (SELECT forest, quantile_cont(score, {contamination}) AS off, COUNT(*) AS n FROM scored GROUP BY forest)"""
