"""The same results in plain SQL (DuckDB dialect) over the given tables.

Written from the definitions, not from the Spark plans: nested loops where the library
prunes, sorts and row numbers where it merges sketches.
"""

from __future__ import annotations

from geotrail.plans import inputs as i

C, B = i.CIRCLE, i.BOX
SIDE = i.BOUNDS.width
FINE = 2**i.MAX_DEPTH
PAD = repr(i.BOUNDS.pad)
KD_LEVELS = 16
DEEPEST = 30
FINISHED_US = "epoch_us(ts)"

ST_POINTS = f"""st_points AS (
  SELECT CAST(user_id AS VARCHAR) AS traj_id, value * 2.0 AS x,
         CAST((event_id * 7919) % 100000 AS DOUBLE) / 100.0 AS y,
         date_diff('second', TIMESTAMP '{i.ORIGIN}', date_trunc('second', ts)) AS t, event_id
  FROM events)"""

CIRCLES = """circles AS (
  SELECT event_id AS query_id, x, y, CAST(2 + (event_id // 50) % 50 AS DOUBLE) AS r,
         t AS ta, t + 1000 + (event_id * 7919) % 1000000 AS tb, t * 1000 AS issued_ms
  FROM st_points WHERE event_id % 50 = 0)"""

EVERY_CIRCLE = CIRCLES.replace("circles AS", "every_circle AS").replace(" WHERE event_id % 50 = 0", "")

BOXES = """boxes AS (
  SELECT query_id, x - r AS x0, y - r AS y0, x + r AS x1, y + r AS y1, ta, tb FROM circles)"""


def quad_ctes(side: float = SIDE) -> list[str]:
    """Regions of the quadtree and the region of every point."""
    depth = i.MAX_DEPTH
    return [
        f"""cells AS (
  SELECT *, CAST(floor(x * {FINE} / {side}) AS BIGINT) AS fx, CAST(floor(y * {FINE} / {side}) AS BIGINT) AS fy
  FROM st_points WHERE x >= 0 AND x < {side} AND y >= 0 AND y < {side})""",
        f"""levels AS (
  SELECT l.level, fx >> ({depth} - l.level) AS ix, fy >> ({depth} - l.level) AS iy, count(*) AS n
  FROM cells, (SELECT unnest(range(0, {depth} + 1)) AS level) l GROUP BY ALL)""",
        f"split AS (SELECT level, ix, iy FROM levels WHERE n > {i.CAPACITY} AND level < {depth})",
        """nodes AS (
  SELECT 0 AS level, 0 AS ix, 0 AS iy
  UNION ALL
  SELECT level + 1, ix * 2 + q.q % 2, iy * 2 + q.q // 2 FROM split, (SELECT unnest(range(0, 4)) AS q) q)""",
        f"""regions AS (
  SELECT 'q' || array_to_string([((ix >> (level - k)) % 2) + 2 * ((iy >> (level - k)) % 2)
                                 for k in range(1, level + 1)], '') AS loc,
         CAST(level AS BIGINT) AS level, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy,
         ix * {side} / power(2, level) AS x0, iy * {side} / power(2, level) AS y0,
         (ix + 1) * {side} / power(2, level) AS x1, (iy + 1) * {side} / power(2, level) AS y1
  FROM nodes n WHERE NOT EXISTS (
    SELECT 1 FROM split s WHERE s.level = n.level AND s.ix = n.ix AND s.iy = n.iy))""",
        """located AS (
  SELECT p.*, coalesce(r.loc, 'outside') AS loc
  FROM st_points p LEFT JOIN regions r ON p.x >= r.x0 AND p.x < r.x1 AND p.y >= r.y0 AND p.y < r.y1)""",
    ]


KEYED = f"keyed AS (SELECT *, t // {i.WINDOW} AS block FROM located)"
QUAD = [ST_POINTS, *quad_ctes()]
KEYED_ALL = [*QUAD, KEYED]


def touches(x: str, y: str, r: str) -> str:
    dx = f"greatest(x0 - {PAD} - {x}, 0.0, {x} - (x1 + {PAD}))"
    dy = f"greatest(y0 - {PAD} - {y}, 0.0, {y} - (y1 + {PAD}))"
    return f"{dx} * {dx} + {dy} * {dy} <= {r} * {r}"


def touches_literal(x: float, y: float, r: float) -> str:
    return touches(f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)", f"CAST({r} AS DOUBLE)")


CANDIDATES = [
    CIRCLES,
    f"""touched AS (
  SELECT q.query_id, r.loc, q.ta, q.tb, q.issued_ms FROM circles q JOIN regions r ON {touches('q.x', 'q.y', 'q.r')}
  UNION ALL
  SELECT query_id, 'outside', ta, tb, issued_ms FROM circles
  WHERE NOT (x - r >= 0 AND x + r < {SIDE} AND y - r >= 0 AND y + r < {SIDE}))""",
    f"""cand AS (
  SELECT query_id, loc, unnest(range(ta // {i.WINDOW}, tb // {i.WINDOW} + 1)) AS block, issued_ms AS access_ms
  FROM touched)""",
]

STATUS = [
    f"""seen AS (
  SELECT loc, block, max(access_ms) AS last_ms FROM cand WHERE access_ms <= {i.NOW_MS} GROUP BY loc, block)""",
    f"""status AS (
  SELECT k.loc, k.block, coalesce(s.last_ms, 0) AS active_ms,
         {i.NOW_MS} < coalesce(s.last_ms, 0) + {i.ACTIVE_MS} + {i.DELAY_MS} AS is_hot
  FROM (SELECT DISTINCT loc, block FROM keyed) k LEFT JOIN seen s ON k.loc = s.loc AND k.block = s.block)""",
]


HOURLY = [
    "hours AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)",
    "placed AS (SELECT event_type, n, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS pos FROM hours)",
]


def kd_ctes() -> list[str]:
    """Median cuts, one level after the other, down to the depth the count asks for."""
    ctes = [
        f"""kd AS MATERIALIZED (
  SELECT greatest(0, CAST(ceil(log2(count(*) / {float(i.CAPACITY)})) AS INTEGER)) AS depth FROM st_points
  WHERE x >= 0 AND x < {SIDE} AND y >= 0 AND y < {SIDE})""",
        f"""p0 AS MATERIALIZED (
  SELECT x, y, 1 AS node FROM st_points WHERE x >= 0 AND x < {SIDE} AND y >= 0 AND y < {SIDE})""",
        f"b0 AS MATERIALIZED (SELECT 1 AS node, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, {SIDE}::DOUBLE AS x1, {SIDE}::DOUBLE AS y1)",
    ]
    for n in range(KD_LEVELS):
        axis = "xy"[n % 2]
        lo, hi = f"{axis}0", f"{axis}1"
        other = [e for e in ("x0", "y0", "x1", "y1") if e not in (lo, hi)]
        ctes += [
            f"""c{n} AS MATERIALIZED (
  SELECT node, quantile_disc({axis}, 0.5) AS cut FROM p{n} WHERE {n} < (SELECT depth FROM kd) GROUP BY node)""",
            f"""p{n + 1} AS MATERIALIZED (
  SELECT p.x, p.y, CASE WHEN c.cut IS NULL THEN p.node WHEN p.{axis} >= c.cut THEN 2 * p.node + 1 ELSE 2 * p.node END AS node
  FROM p{n} p LEFT JOIN c{n} c ON p.node = c.node)""",
            f"""b{n + 1} AS MATERIALIZED (
  SELECT CASE WHEN {n} < d.depth THEN 2 * b.node + s.s ELSE b.node END AS node, {', '.join('b.' + e for e in other)},
         CASE WHEN {n} >= d.depth OR s.s = 0 THEN b.{lo} ELSE coalesce(c.cut, b.{hi}) END AS {lo},
         CASE WHEN {n} >= d.depth OR s.s = 1 THEN b.{hi} ELSE coalesce(c.cut, b.{hi}) END AS {hi}
  FROM b{n} b CROSS JOIN kd d JOIN (VALUES (0), (1)) s(s) ON s.s = 0 OR {n} < d.depth LEFT JOIN c{n} c ON b.node = c.node)""",
        ]
    ctes.append(
        f"kd_regions AS (SELECT 'k' || substr(bin(node), 2) AS loc, x0, y0, x1, y1 FROM b{KD_LEVELS})"
    )
    return ctes


KD = [ST_POINTS, *kd_ctes()]

STR = [
    ST_POINTS,
    f"""str AS MATERIALIZED (
  SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(ceil(count(*) / {float(i.CAPACITY)}))) AS BIGINT)) AS side FROM st_points)""",
    "xr AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY x) AS rn FROM st_points)",
    """xc AS MATERIALIZED (
  SELECT k.k, xr.x AS cut
  FROM str, (SELECT unnest(range(1, (SELECT side FROM str))) AS k) k
  JOIN xr ON xr.rn = ceil(CAST(k.k AS DOUBLE) / (SELECT side FROM str) * (SELECT n FROM str)))""",
    """slabs AS MATERIALIZED (
  SELECT p.event_id, p.x, p.y, (SELECT count(*) FROM xc WHERE xc.cut <= p.x) AS slab FROM st_points p)""",
    """yr AS MATERIALIZED (
  SELECT slab, y, row_number() OVER (PARTITION BY slab ORDER BY y) AS rn, count(*) OVER (PARTITION BY slab) AS n FROM slabs)""",
    """yc AS MATERIALIZED (
  SELECT yr.slab, k.k, yr.y AS cut
  FROM (SELECT unnest(range(1, (SELECT side FROM str))) AS k) k
  JOIN yr ON yr.rn = ceil(CAST(k.k AS DOUBLE) / (SELECT side FROM str) * yr.n))""",
    """tiled AS MATERIALIZED (
  SELECT s.*, (SELECT count(*) FROM yc WHERE yc.slab = s.slab AND yc.cut <= s.y) AS tile FROM slabs s)""",
    """str_regions AS (
  SELECT 's' || s.slab || '_' || t.tile AS loc, xl.cut AS x0, yl.cut AS y0, xh.cut AS x1, yh.cut AS y1
  FROM (SELECT unnest(range(0, (SELECT side FROM str))) AS slab) s
  CROSS JOIN (SELECT unnest(range(0, (SELECT side FROM str))) AS tile) t
  LEFT JOIN xc xl ON xl.k = s.slab LEFT JOIN xc xh ON xh.k = s.slab + 1
  LEFT JOIN yc yl ON yl.slab = s.slab AND yl.k = t.tile
  LEFT JOIN yc yh ON yh.slab = s.slab AND yh.k = t.tile + 1)""",
]

N, M = i.GRID
GRID_CELL = f"""'g' || CAST(floor(x * {float(N)} / {SIDE}) AS BIGINT) || '_' || CAST(floor(y * {float(M)} / {SIDE}) AS BIGINT)"""
GRID_LOC = f"CASE WHEN x >= 0 AND x < {SIDE} AND y >= 0 AND y < {SIDE} THEN {GRID_CELL} ELSE 'outside' END"

IN_CIRCLE = f"(x - {C.x}::DOUBLE) * (x - {C.x}::DOUBLE) + (y - {C.y}::DOUBLE) * (y - {C.y}::DOUBLE) <= {C.r * C.r}"
IN_BOX = f"x BETWEEN {B.x0} AND {B.x1} AND y BETWEEN {B.y0} AND {B.y1}"
CIRCLE_HITS = f"hits AS (SELECT *, 1::BIGINT AS query_id FROM st_points WHERE {IN_CIRCLE} AND t BETWEEN {C.ta} AND {C.tb})"
BOX_HITS = f"hits AS (SELECT *, 1::BIGINT AS query_id FROM st_points WHERE {IN_BOX} AND t BETWEEN {B.ta} AND {B.tb})"
CIRCLE_JOIN = """SELECT q.query_id, p.traj_id, p.t, p.x, p.y FROM {workload} q JOIN st_points p
  ON p.t BETWEEN q.ta AND q.tb AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= q.r * q.r"""
WORKLOAD_HITS = f"hits AS ({CIRCLE_JOIN.format(workload='circles')})"
BOX_WORKLOAD_HITS = """hits AS (
  SELECT q.query_id, p.traj_id, p.t FROM boxes q JOIN st_points p
  ON p.t BETWEEN q.ta AND q.tb AND p.x BETWEEN q.x0 AND q.x1 AND p.y BETWEEN q.y0 AND q.y1)"""
FAR = """asked AS (
  SELECT query_id, x, y, r, ta, tb FROM circles
  UNION ALL SELECT -query_id - 1, x, y + 5000.0, r, ta, tb FROM circles)"""
TRAJECTORIES = """SELECT query_id, traj_id, count(*) AS n_points, min(t) AS t_min, max(t) AS t_max
FROM hits GROUP BY query_id, traj_id"""

COUNTER = [
    f"""ticks AS MATERIALIZED (
  SELECT floor((epoch_us(ts) // 1000) / {i.TICK_MS})::BIGINT AS tick, count(*) AS n FROM events GROUP BY 1)""",
    f"""counter AS MATERIALIZED (
  SELECT (a.tick + 1) * {i.TICK_MS} AS tick_ms, coalesce(n, 0) AS finished,
         CAST(sum(coalesce(n, 0)) OVER (ORDER BY a.tick) AS BIGINT) AS counter
  FROM (SELECT unnest(range((SELECT min(tick) FROM ticks), (SELECT max(tick) FROM ticks) + 1)) AS tick) a
  LEFT JOIN ticks USING (tick))""",
]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def sessions(source: str, keys: str, at: str, gap: int, start: str, end: str) -> list[str]:
    return [
        f"""marked AS (
  SELECT {keys}, {at} AS moment,
         CASE WHEN {at} - lag({at}) OVER (PARTITION BY {keys} ORDER BY {at}) < {gap} THEN 0 ELSE 1 END AS fresh
  FROM {source})""",
        f"numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY moment ROWS UNBOUNDED PRECEDING) AS period FROM marked)",
        f"""periods AS (
  SELECT {keys}, min(moment) AS {start}, max(moment) + {gap} AS {end}, count(*) AS n_accesses
  FROM numbered GROUP BY {keys}, period)""",
    ]


ALL_POINTS = with_ctes([ST_POINTS], "SELECT traj_id, x, y, t FROM st_points")
STREAM_LATE_US = 3_600_000_000

ORACLE: dict[str, str] = {
    "read_trajectories": ALL_POINTS,
    "flatten_points": ALL_POINTS,
    "read_points": ALL_POINTS,
    "set_partitions": with_ctes([ST_POINTS], f"SELECT {i.PARTITIONS} AS n_partitions, count(*) AS n_points FROM st_points"),
    "replicate_dataset": with_ctes(
        [ST_POINTS], "SELECT traj_id || '#' || k.k AS traj_id, x, y, t FROM st_points, (SELECT unnest(range(0, 3)) AS k) k"
    ),
    "store_roundtrip": with_ctes(KEYED_ALL, "SELECT event_id, traj_id, x, y, t, loc, block FROM keyed"),
    "read_partitions": with_ctes(
        KEYED_ALL + CANDIDATES, "SELECT event_id, loc, block FROM keyed WHERE (loc, block) IN (SELECT (loc, block) FROM cand)"
    ),
    "read_workload": with_ctes(
        [ST_POINTS, EVERY_CIRCLE],
        "SELECT x, y, r, ta, tb, row_number() OVER (ORDER BY query_id) AS query_id FROM every_circle",
    ),
    "format_workload": with_ctes(
        [ST_POINTS, EVERY_CIRCLE],
        "SELECT query_id, concat_ws(',', x::VARCHAR, y::VARCHAR, r::VARCHAR, ta::VARCHAR, tb::VARCHAR) AS line FROM every_circle",
    ),
    "skip_rows": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id OFFSET 899",
    "time_block": with_ctes(
        [ST_POINTS],
        f"SELECT event_id, t // {i.WINDOW} AS block, (t - 1000000) // {i.WINDOW} AS block_shifted FROM st_points",
    ),
    "index_key": with_ctes(KEYED_ALL, "SELECT event_id, '1&' || loc || '&' || block AS key FROM keyed"),
    "parse_index_key": with_ctes(KEYED_ALL, "SELECT event_id, '1' AS oid, loc, block FROM keyed"),
    "index_order": with_ctes(
        KEYED_ALL,
        """SELECT loc, block, row_number() OVER (ORDER BY loc, block::VARCHAR) AS key_rank
FROM (SELECT DISTINCT loc, block FROM keyed)""",
    ),
    "filter_circle": with_ctes([ST_POINTS], f"SELECT event_id, traj_id, x, y, t FROM st_points WHERE {IN_CIRCLE}"),
    "filter_box": with_ctes([ST_POINTS], f"SELECT event_id, traj_id, x, y, t FROM st_points WHERE {IN_BOX}"),
    "filter_time": with_ctes(
        [ST_POINTS], f"SELECT event_id, traj_id, x, y, t FROM st_points WHERE t BETWEEN {C.ta} AND {C.tb}"
    ),
    "number_queries": with_ctes(
        [ST_POINTS, EVERY_CIRCLE],
        "SELECT query_id, issued_ms, row_number() OVER (ORDER BY issued_ms, query_id) AS query_no FROM every_circle",
    ),
    "outside_points": with_ctes(
        [ST_POINTS], "SELECT event_id, NOT (x >= 0 AND x < 512 AND y >= 0 AND y < 512) AS is_outside FROM st_points"
    ),
    "sample_trajectories": with_ctes(
        [ST_POINTS],
        f"""SELECT event_id, traj_id, x, y FROM st_points WHERE traj_id IN (
  SELECT traj_id FROM (SELECT DISTINCT traj_id FROM st_points) ORDER BY md5(traj_id || '{i.SEED}'), traj_id LIMIT {i.SAMPLE})""",
    ),
    "grid_model": with_ctes(
        [ST_POINTS],
        f"""SELECT loc, x0, y0, x1, y1, (SELECT count(*) FROM st_points p WHERE p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1) AS n_points
FROM (SELECT 'g' || ix || '_' || iy AS loc, ix * {SIDE} / {N} AS x0, iy * {SIDE} / {M} AS y0,
             (ix + 1) * {SIDE} / {N} AS x1, (iy + 1) * {SIDE} / {M} AS y1
      FROM (SELECT unnest(range(0, {N})) AS ix) a, (SELECT unnest(range(0, {M})) AS iy) b)""",
    ),
    "grid_assign": with_ctes([ST_POINTS], f"SELECT event_id, {GRID_LOC} AS loc FROM st_points"),
    "quadtree_model": with_ctes(QUAD, "SELECT loc, level, ix, iy, x0, y0, x1, y1 FROM regions"),
    "quadtree_any_depth": with_ctes(
        [
            ST_POINTS,
            f"""finest AS MATERIALIZED (
  SELECT event_id, x, y, CAST(floor(x / {SIDE} * {2**DEEPEST}) AS BIGINT) AS fx, CAST(floor(y / {SIDE} * {2**DEEPEST}) AS BIGINT) AS fy
  FROM st_points WHERE x >= 0 AND x < {SIDE} AND y >= 0 AND y < {SIDE})""",
            f"""cells AS MATERIALIZED (
  SELECT event_id, x, y, level, fx >> ({DEEPEST} - level) AS ix, fy >> ({DEEPEST} - level) AS iy
  FROM finest, (SELECT unnest(range(0, {DEEPEST} + 1)) AS level))""",
            f"""split AS (
  SELECT level, ix, iy FROM cells GROUP BY ALL
  HAVING count(*) > {i.SMALL_CAPACITY} AND (min(x) < max(x) OR min(y) < max(y)) AND level < {DEEPEST})""",
            """leaf AS (
  SELECT event_id, min(level) AS level FROM cells c
  WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.level = c.level AND s.ix = c.ix AND s.iy = c.iy) GROUP BY 1)""",
            """named AS (
  SELECT event_id, 'q' || array_to_string([((ix >> (level - k)) % 2) + 2 * ((iy >> (level - k)) % 2)
                                           for k in range(1, level + 1)], '') AS loc
  FROM leaf JOIN cells USING (event_id, level))""",
        ],
        """SELECT coalesce(loc, 'outside') AS loc, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum
FROM st_points LEFT JOIN named USING (event_id) GROUP BY 1""",
    ),
    "quadtree_assign": with_ctes(QUAD, "SELECT event_id, loc FROM located"),
    "kdtree_model": with_ctes(KD, "SELECT loc, x0, y0, x1, y1 FROM kd_regions"),
    "kdtree_assign": with_ctes(
        KD,
        """SELECT p.event_id, coalesce(r.loc, 'outside') AS loc FROM st_points p
LEFT JOIN kd_regions r ON p.x >= r.x0 AND p.x < r.x1 AND p.y >= r.y0 AND p.y < r.y1""",
    ),
    "strtree_model": with_ctes(STR, "SELECT loc, x0, y0, x1, y1 FROM str_regions"),
    "strtree_assign": with_ctes(STR, "SELECT event_id, 's' || slab || '_' || tile AS loc FROM tiled"),
    "strtree_boxes": with_ctes(
        STR,
        """SELECT 's' || slab || '_' || tile AS loc, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1
FROM tiled GROUP BY slab, tile""",
    ),
    "regions_for_circle": with_ctes(QUAD, f"SELECT loc FROM regions WHERE {touches_literal(C.x, C.y, C.r)}"),
    "regions_for_box": with_ctes(
        QUAD,
        f"""SELECT loc FROM regions
WHERE x0 - {PAD} <= {B.x1} AND {B.x0} <= x1 + {PAD} AND y0 - {PAD} <= {B.y1} AND {B.y0} <= y1 + {PAD}""",
    ),
    "model_size": with_ctes(
        [*QUAD, *kd_ctes(), *STR[1:2]],
        """SELECT 'quadtree' AS kind, count(*) AS n_regions FROM regions
UNION ALL SELECT 'kdtree', CAST(power(2, depth) AS BIGINT) FROM kd
UNION ALL SELECT 'strtree', side * side FROM str""",
    ),
    "partition_points": with_ctes(KEYED_ALL, "SELECT event_id, loc, block FROM keyed"),
    "gather_partitions": with_ctes(
        KEYED_ALL, "SELECT loc, block, count(*) AS n_points, min(t) AS t_min, max(t) AS t_max FROM keyed GROUP BY loc, block"
    ),
    "gather_slices": with_ctes(
        [*KEYED_ALL, """placed AS (
  SELECT *, row_number() OVER (PARTITION BY loc, block ORDER BY t, x, y, traj_id) - 1 AS pos FROM keyed)"""],
        """SELECT loc, block, pos // 3 AS part, string_agg(t || ' ' || traj_id, ',' ORDER BY pos) AS points
FROM placed GROUP BY loc, block, pos // 3""",
    ),
    "partition_counts": with_ctes(KEYED_ALL, "SELECT loc, block, count(*) AS n_points FROM keyed GROUP BY loc, block"),
    "partition_profile": with_ctes(
        KEYED_ALL,
        """SELECT count(*) AS n_points, count(DISTINCT (loc, block)) AS n_partitions, count(DISTINCT loc) AS n_locs,
       count(*) FILTER (loc = 'outside') AS n_outside FROM keyed""",
    ),
    "build_trajectories": with_ctes(
        [ST_POINTS, CIRCLE_HITS],
        """SELECT query_id, traj_id, count(*) AS n_points, string_agg(t::VARCHAR, ',' ORDER BY t, x, y) AS times
FROM hits GROUP BY query_id, traj_id""",
    ),
    "query_result_counts": with_ctes(
        [ST_POINTS, CIRCLES, FAR, f"hits AS ({CIRCLE_JOIN.format(workload='asked')})"],
        """SELECT a.query_id, count(DISTINCT h.traj_id) AS n_trajectories, count(h.traj_id) AS n_points
FROM asked a LEFT JOIN hits h ON a.query_id = h.query_id GROUP BY a.query_id""",
    ),
    "blocks_for_interval": with_ctes(
        [ST_POINTS, EVERY_CIRCLE],
        f"SELECT query_id, unnest(range(ta // {i.WINDOW}, tb // {i.WINDOW} + 1)) AS block FROM every_circle",
    ),
    "block_ranges": with_ctes(
        [ST_POINTS, CIRCLES, EVERY_CIRCLE],
        f"""SELECT query_id, ta // {i.WINDOW} AS first_block, tb // {i.WINDOW} AS last_block FROM every_circle
UNION ALL SELECT -query_id - 1, {-(2**63 // i.WINDOW)}, {(2**63 - 1) // i.WINDOW} FROM circles""",
    ),
    "candidate_ranges": with_ctes(
        QUAD + CANDIDATES[:2],
        f"SELECT query_id, loc, ta // {i.WINDOW} AS first_block, tb // {i.WINDOW} AS last_block FROM touched",
    ),
    "candidates_open_interval": with_ctes(
        KEYED_ALL + CANDIDATES[:2],
        "SELECT t.query_id, k.loc, k.block FROM touched t JOIN (SELECT DISTINCT loc, block FROM keyed) k ON t.loc = k.loc",
    ),
    "last_access_open_interval": with_ctes(
        KEYED_ALL + CANDIDATES[:2],
        """SELECT k.loc, k.block, max(t.issued_ms) AS last_ms
FROM touched t JOIN (SELECT DISTINCT loc, block FROM keyed) k ON t.loc = k.loc GROUP BY k.loc, k.block""",
    ),
    "candidate_partitions": with_ctes(QUAD + CANDIDATES, "SELECT query_id, loc, block FROM cand"),
    "fetch_partitions": with_ctes(
        KEYED_ALL + CANDIDATES, "SELECT event_id, loc, block FROM keyed WHERE (loc, block) IN (SELECT (loc, block) FROM cand)"
    ),
    "circle_points": with_ctes([ST_POINTS, CIRCLE_HITS], "SELECT query_id, event_id, traj_id, x, y, t FROM hits"),
    "circle_query": with_ctes([ST_POINTS, CIRCLE_HITS], TRAJECTORIES),
    "circle_query_points": with_ctes(
        [ST_POINTS, CIRCLE_HITS],
        """SELECT query_id, traj_id, 0::BIGINT AS part, t, x, y,
       row_number() OVER (PARTITION BY traj_id ORDER BY t, x, y) - 1 AS pos FROM hits""",
    ),
    "circle_query_kdtree": with_ctes([ST_POINTS, CIRCLE_HITS], TRAJECTORIES),
    "circle_query_strtree": with_ctes([ST_POINTS, CIRCLE_HITS], TRAJECTORIES),
    "box_query": with_ctes([ST_POINTS, BOX_HITS], TRAJECTORIES),
    "circle_workload": with_ctes([ST_POINTS, CIRCLES, WORKLOAD_HITS], TRAJECTORIES),
    "box_workload": with_ctes([ST_POINTS, CIRCLES, BOXES, BOX_WORKLOAD_HITS], TRAJECTORIES),
    "circle_workload_kdtree": with_ctes([ST_POINTS, CIRCLES, WORKLOAD_HITS], TRAJECTORIES),
    "circle_workload_strtree": with_ctes([ST_POINTS, CIRCLES, WORKLOAD_HITS], TRAJECTORIES),
    "box_workload_kdtree": with_ctes([ST_POINTS, CIRCLES, BOXES, BOX_WORKLOAD_HITS], TRAJECTORIES),
    "box_workload_grid": with_ctes([ST_POINTS, CIRCLES, BOXES, BOX_WORKLOAD_HITS], TRAJECTORIES),
    "hot_workload": with_ctes(
        [ST_POINTS, CIRCLES],
        """SELECT q.query_id, count(*) AS n_points, CAST(sum(p.event_id) AS BIGINT) AS id_sum
FROM (SELECT query_id, 20 + query_id // 50 % 50 AS x, 200 + query_id // 2500 % 50 AS y, r FROM circles) q
JOIN st_points p ON p.t BETWEEN 0 AND 400000 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= q.r * q.r
GROUP BY q.query_id""",
    ),
    "workload_open_interval": with_ctes(
        [ST_POINTS, CIRCLES, "always AS (SELECT query_id, x, y, r, -1 AS ta, 9223372036854775807 AS tb FROM circles)",
         f"hits AS ({CIRCLE_JOIN.format(workload='always')})"],
        TRAJECTORIES,
    ),
    "circle_scan": with_ctes([ST_POINTS, CIRCLE_HITS], "SELECT query_id, event_id, traj_id, x, y, t FROM hits"),
    "box_scan": with_ctes([ST_POINTS, BOX_HITS], "SELECT query_id, event_id, traj_id, x, y, t FROM hits"),
    "overlay_partitions": with_ctes(
        KEYED_ALL + CANDIDATES,
        """SELECT event_id, loc, block,
       CASE WHEN (loc, block) IN (SELECT (loc, block) FROM cand) THEN 'reloaded' ELSE 'kept' END AS origin FROM keyed""",
    ),
    "cold_requested": with_ctes(
        KEYED_ALL + CANDIDATES + STATUS,
        "SELECT loc, block FROM status WHERE NOT is_hot AND (loc, block) IN (SELECT (loc, block) FROM cand)",
    ),
    "last_access": with_ctes(
        QUAD + CANDIDATES, "SELECT loc, block, max(access_ms) AS last_ms FROM cand GROUP BY loc, block"
    ),
    "classify_partitions": with_ctes(KEYED_ALL + CANDIDATES + STATUS, "SELECT loc, block, active_ms, is_hot FROM status"),
    "evict_cold": with_ctes(
        KEYED_ALL + CANDIDATES + STATUS,
        """SELECT s.loc, s.block, s.is_hot, CASE WHEN s.is_hot THEN count(*) ELSE 0 END AS n_points
FROM status s JOIN keyed k ON s.loc = k.loc AND s.block = k.block GROUP BY s.loc, s.block, s.is_hot""",
    ),
    "all_cold": with_ctes(
        KEYED_ALL, "SELECT DISTINCT loc, block, false AS is_hot, false AS has_points FROM keyed"
    ),
    "hot_count": with_ctes(
        KEYED_ALL + CANDIDATES + STATUS,
        "SELECT count(*) FILTER (is_hot) AS n_hot, count(*) AS n_partitions FROM status",
    ),
    "activity_sessions": with_ctes(
        QUAD + CANDIDATES + sessions("cand", "loc, block", "access_ms", i.SESSION_MS, "from_ms", "cold_ms"),
        "SELECT loc, block, from_ms, cold_ms, n_accesses FROM periods",
    ),
    "query_counter": with_ctes(COUNTER, "SELECT tick_ms, finished, counter FROM counter"),
    "throughput": with_ctes(
        COUNTER,
        f"""SELECT 'events' AS run, tick_ms // {i.TICK_MS} AS seq,
       counter - lag(counter, 1, 0) OVER (ORDER BY tick_ms) AS throughput FROM counter""",
    ),
    "series_chunks": with_ctes(
        HOURLY,
        f"""SELECT event_type AS series, pos // {i.CHUNK} AS chunk, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY pos) AS items
FROM placed GROUP BY 1, 2""",
    ),
    "throughput_rollup": with_ctes(
        HOURLY,
        """SELECT event_type AS series, -1 AS bucket, 0 AS total FROM placed GROUP BY 1
UNION ALL
SELECT event_type, (pos - 1) // 6, CAST(sum(n) AS BIGINT) FROM placed WHERE pos >= 1 GROUP BY 1, 2""",
    ),
    "parse_series": with_ctes(
        HOURLY,
        """SELECT event_type AS series, 0 AS pos, 0 AS v FROM placed GROUP BY 1
UNION ALL
SELECT event_type, (pos - 1) // 6 + 1, CAST(sum(n) AS BIGINT) FROM placed WHERE pos >= 1 GROUP BY 1, 2""",
    ),
    "format_series": with_ctes(
        [*HOURLY, "sums AS (SELECT event_type, (pos - 1) // 6 AS bucket, sum(n) AS total FROM placed WHERE pos >= 1 GROUP BY 1, 2)"],
        """SELECT event_type || ' 0 ' || string_agg(CAST(total AS BIGINT)::VARCHAR, ' ' ORDER BY bucket) AS value
FROM sums GROUP BY event_type""",
    ),
    "stream_throughput": f"""WITH closed AS (
  SELECT epoch_us(ts) // 10000000 AS tick, count(*) AS finished FROM events GROUP BY 1)
SELECT tick * 10000 AS start_ms, (tick + 1) * 10000 AS end_ms, finished FROM closed
WHERE (tick + 1) * 10000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - {STREAM_LATE_US}""",
    "stream_activity": with_ctes(
        [
            ST_POINTS,
            f"""seen AS (
  SELECT {GRID_LOC} AS loc, t // {i.WINDOW} AS block, epoch_us(e.ts) AS us
  FROM st_points p JOIN events e ON p.event_id = e.event_id)""",
            *sessions("seen", "loc, block", "us", i.STREAM_MS * 1000, "from_us", "cold_us"),
        ],
        f"""SELECT loc, block, from_us, cold_us, n_accesses FROM periods
WHERE cold_us - 1 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - {STREAM_LATE_US}""",
    ),
}
