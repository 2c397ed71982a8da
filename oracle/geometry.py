"""SQL text for the spatial results: the same geodesy, written a second way.

Latitude on the target ellipsoid is found by fixed-point iteration here, and
the distance to the zone by joining every place with every edge.
"""

from math import radians

# Ellipsoids, datum shift and grid origin (published Ordnance Survey figures).
A1, B1 = 6378137.0, 6356752.314245
A2, B2 = 6377563.396, 6356256.909
TX, TY, TZ = -446.448, 125.157, -542.060
RX, RY, RZ = (radians(s / 3600) for s in (-0.1502, -0.2470, -0.8421))
SCALE = 1 + 20.4894e-6
PHI0, LAM0, F0 = radians(49), radians(-2), 0.9996012717

ITERATIONS = 8


def projection(prefix: str, source: str, key: str, lon: str = "longitude", lat: str = "latitude") -> str:
    """CTEs ending in ``{prefix}_xy(key, x_m, y_m)``."""
    p = prefix
    e1, e2 = (A1**2 - B1**2) / A1**2, (A2**2 - B2**2) / A2**2
    n = (A2 - B2) / (A2 + B2)
    steps = [f"""{p}_a AS (SELECT {key}, radians({lat}) AS f, radians({lon}) AS l FROM {source}),
{p}_b AS (SELECT {key}, {A1}/sqrt(1 - {e1}*sin(f)*sin(f))*cos(f)*cos(l) AS x,
  {A1}/sqrt(1 - {e1}*sin(f)*sin(f))*cos(f)*sin(l) AS y,
  {A1}*(1 - {e1})/sqrt(1 - {e1}*sin(f)*sin(f))*sin(f) AS z FROM {p}_a),
{p}_c AS (SELECT {key}, {TX} + {SCALE}*x - ({RZ})*y + ({RY})*z AS x, {TY} + ({RZ})*x + {SCALE}*y - ({RX})*z AS y,
  {TZ} - ({RY})*x + ({RX})*y + {SCALE}*z AS z FROM {p}_b),
{p}_f0 AS (SELECT {key}, z, sqrt(x*x + y*y) AS p, atan2(y, x) - ({LAM0}) AS d,
  atan2(z, sqrt(x*x + y*y)*(1 - {e2})) AS f FROM {p}_c)"""]
    for i in range(ITERATIONS):
        steps.append(f"{p}_f{i + 1} AS (SELECT {key}, z, p, d, "
                     f"atan2(z + {e2}*{A2}/sqrt(1 - {e2}*sin(f)*sin(f))*sin(f), p) AS f FROM {p}_f{i})")
    steps.append(f"""{p}_g AS (SELECT {key}, d, f, {A2 * F0}/sqrt(1 - {e2}*sin(f)*sin(f)) AS nu,
  {A2 * F0}*(1 - {e2})/pow(1 - {e2}*sin(f)*sin(f), 1.5) AS rho,
  {B2 * F0}*((1 + {n} + 1.25*{n**2} + 1.25*{n**3})*(f - {PHI0})
    - (3*{n} + 3*{n**2} + 2.625*{n**3})*sin(f - {PHI0})*cos(f + {PHI0})
    + (1.875*{n**2} + 1.875*{n**3})*sin(2*(f - {PHI0}))*cos(2*(f + {PHI0}))
    - {35 / 24 * n**3}*sin(3*(f - {PHI0}))*cos(3*(f + {PHI0}))) AS m FROM {p}_f{ITERATIONS}),
{p}_xy AS (SELECT {key},
  400000 + nu*cos(f)*d + nu/6*pow(cos(f), 3)*(nu/rho - pow(tan(f), 2))*pow(d, 3)
    + nu/120*pow(cos(f), 5)*(5 - 18*pow(tan(f), 2) + pow(tan(f), 4) + 14*(nu/rho - 1)
      - 58*pow(tan(f), 2)*(nu/rho - 1))*pow(d, 5) AS x_m,
  -100000 + m + nu/2*sin(f)*cos(f)*pow(d, 2)
    + nu/24*sin(f)*pow(cos(f), 3)*(5 - pow(tan(f), 2) + 9*(nu/rho - 1))*pow(d, 4)
    + nu/720*sin(f)*pow(cos(f), 5)*(61 - 58*pow(tan(f), 2) + pow(tan(f), 4))*pow(d, 6) AS y_m
  FROM {p}_g)""")
    return ",\n".join(steps)


ZONE = """corners(seq, longitude, latitude) AS (VALUES (1, -1.9168::DOUBLE, 52.4883::DOUBLE),
  (2, -1.8801, 52.4891), (3, -1.8715, 52.4741), (4, -1.8902, 52.4635), (5, -1.9150, 52.4690), (6, -1.9168, 52.4883))"""

EDGES = """edges AS (SELECT a.x_m AS x1, a.y_m AS y1, b.x_m AS x2, b.y_m AS y2
  FROM corners_xy a JOIN corners_xy b ON b.seq = a.seq + 1)"""


def tiered(source: str, key: str, straddle: bool) -> str:
    """CTEs ending in ``{source}_tier(key, caz_tier, distance_to_caz_metres)``; needs ``edges``."""
    s = source
    touch = "WHEN edge <= 0.000001 THEN '2. Close Boundary (Straddles CAZ)'" if straddle else ""
    return f"""{projection(s, s, key)},
{s}_d AS (SELECT {key}, min(sqrt(pow(x_m - x1 - t*(x2 - x1), 2) + pow(y_m - y1 - t*(y2 - y1), 2))) AS edge,
    sum(CASE WHEN (y1 > y_m) <> (y2 > y_m) AND x_m < (x2 - x1)*(y_m - y1)/(y2 - y1) + x1
             THEN 1 ELSE 0 END) % 2 = 1 AS odd
  FROM (SELECT *, greatest(0.0, least(1.0, ((x_m - x1)*(x2 - x1) + (y_m - y1)*(y2 - y1))
          / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM {s}_xy CROSS JOIN edges) GROUP BY {key}),
{s}_tier AS (SELECT {key}, CASE WHEN odd AND edge > 0.000001 THEN '1. Inside CAZ' {touch}
    WHEN m <= 500 THEN '2. Close Boundary (<=500m)' WHEN m <= 2000 THEN '3. Near Boundary (500m-2km)'
    WHEN m <= 5000 THEN '4. Background (2km-5km)' ELSE '5. Outer Regional Control (>5km)' END AS caz_tier,
    CAST(round(CAST(m AS DECIMAL(28,10)), 2) AS DOUBLE) AS distance_to_caz_metres
  FROM (SELECT *, CASE WHEN odd THEN 0.0 ELSE edge END AS m FROM {s}_d))"""


def points(source: str, key: str, wkt: str = "wkt") -> str:
    """CTEs ending in ``points(id, part, ring, seq, x, y)``, all counted from 1."""
    return f"""flat AS (SELECT {key} AS id, regexp_replace(regexp_replace({wkt}, '\\s*([(),])\\s*', '\\1', 'g'),
  '^[A-Za-z]+\\(+|\\)+$', '', 'g') AS body FROM {source}),
part_rows AS (SELECT id, p AS part, string_split(body, ')),((')[p] AS body FROM
  (SELECT id, body, unnest(range(1, len(string_split(body, ')),((')) + 1)) AS p FROM flat)),
ring_rows AS (SELECT id, part, r AS ring, string_split(body, '),(')[r] AS body FROM
  (SELECT id, part, body, unnest(range(1, len(string_split(body, '),(')) + 1)) AS r FROM part_rows)),
points AS (SELECT id, part, ring, i AS seq, CAST(split_part(string_split(body, ',')[i], ' ', 1) AS DOUBLE) AS x,
    CAST(split_part(string_split(body, ',')[i], ' ', 2) AS DOUBLE) AS y FROM
  (SELECT id, part, ring, body, unnest(range(1, len(string_split(body, ',')) + 1)) AS i FROM ring_rows))"""


def held(source: str, key: str) -> str:
    """CTEs ending in ``held(key, id, edge, odd)``: every place beside every outline; needs ``points``."""
    return f"""{projection(source, source, key)},
{projection('corner', 'points', 'id, part, ring, seq', 'x', 'y')},
sides AS (SELECT id, part, ring, x_m AS x1, y_m AS y1, lead(x_m) OVER w AS x2, lead(y_m) OVER w AS y2
  FROM corner_xy WINDOW w AS (PARTITION BY id, part, ring ORDER BY seq)),
held AS (SELECT {key}, id, min(sqrt(pow(x_m - x1 - t*(x2 - x1), 2) + pow(y_m - y1 - t*(y2 - y1), 2))) AS edge,
    count(*) FILTER ((y1 > y_m) <> (y2 > y_m) AND x_m < (x2 - x1)*(y_m - y1)/(y2 - y1) + x1) % 2 = 1 AS odd
  FROM (SELECT *, greatest(0.0, least(1.0, ((x_m - x1)*(x2 - x1) + (y_m - y1)*(y2 - y1))
          / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM {source}_xy CROSS JOIN sides WHERE x2 IS NOT NULL) GROUP BY {key}, id)"""


# Squared distance of v from the chord a-b; from a itself when the chord has no length.
_T = ("greatest(0.0, least(1.0, coalesce(((v.x - a.x)*(b.x - a.x) + (v.y - a.y)*(b.y - a.y))"
      " / nullif((b.x - a.x)*(b.x - a.x) + (b.y - a.y)*(b.y - a.y), 0), 0)))")
_GAP2 = f"(pow(v.x - a.x - {_T}*(b.x - a.x), 2) + pow(v.y - a.y - {_T}*(b.y - a.y), 2))"

# Douglas-Peucker as a recursion over chords: each round splits every chord at its farthest vertex.
SIMPLIFIED = f"""vertex AS (SELECT id, part, ring, seq, x, y, max(seq) OVER (PARTITION BY id, part, ring) AS n FROM points),
chord AS (
  SELECT id, part, ring, CAST(1 AS BIGINT) AS lo, n AS hi FROM vertex WHERE seq = 1
  UNION ALL
  SELECT id, part, ring, CASE side WHEN 0 THEN lo ELSE far END, CASE side WHEN 0 THEN far ELSE hi END
  FROM (SELECT c.id, c.part, c.ring, c.lo, c.hi, arg_max(v.seq, {_GAP2}) AS far, max({_GAP2}) AS gap
        FROM chord c
        JOIN vertex a ON a.id = c.id AND a.part = c.part AND a.ring = c.ring AND a.seq = c.lo
        JOIN vertex b ON b.id = c.id AND b.part = c.part AND b.ring = c.ring AND b.seq = c.hi
        JOIN vertex v ON v.id = c.id AND v.part = c.part AND v.ring = c.ring AND v.seq > c.lo AND v.seq < c.hi
        GROUP BY c.id, c.part, c.ring, c.lo, c.hi) CROSS JOIN (VALUES (0), (1)) sides(side)
  WHERE gap > 0.0001 * 0.0001),
kept AS (SELECT DISTINCT v.id, v.part, v.ring, v.seq, v.x, v.y FROM vertex v
  JOIN chord c ON c.id = v.id AND c.part = v.part AND c.ring = v.ring AND (v.seq = c.lo OR v.seq = c.hi))"""


def text(source: str, digits: int) -> str:
    """CTEs ending in ``drawn(id, body)``: rounded coordinates back to nested text.

    A ring below four vertices goes; a part goes with its outer ring.
    """
    def number(v: str) -> str:
        fixed = f"CAST(round(CAST({v} AS DECIMAL(28,10)), {digits}) AS DECIMAL(28,{digits}))"
        return f"rtrim(rtrim(CAST({fixed} AS STRING), '0'), '.')"

    return f"""ring_text AS (SELECT id, part, ring, count(*) AS n,
    string_agg(concat({number('x')}, ' ', {number('y')}), ',' ORDER BY seq) AS body FROM {source} GROUP BY 1, 2, 3),
part_text AS (SELECT id, part, string_agg(body, '),(' ORDER BY ring) FILTER (WHERE n >= 4) AS body,
    max(CASE WHEN ring = 1 THEN n END) AS outer_n FROM ring_text GROUP BY 1, 2),
drawn AS (SELECT id, string_agg(body, ')),((' ORDER BY part) FILTER (WHERE outer_n >= 4) AS body
  FROM part_text GROUP BY 1)"""


def wrapped(wkt: str, body: str) -> str:
    return (f"CASE WHEN {wkt} LIKE 'MULTI%' THEN concat('MULTIPOLYGON(((', {body}, ')))')"
            f" ELSE concat('POLYGON((', {body}, '))') END")
