"""Views that give the test tables the shape of the engine's inputs.

The text runs unchanged in Spark and in DuckDB. Numbers that become text go
through DECIMAL, so both engines print the same digits.
"""

READINGS = """
SELECT l_suppkey AS site_id,
  l_shipdate + INTERVAL '1' HOUR * CAST((l_orderkey*7 + l_linenumber*5) % 24 AS INT) AS date_time,
  CASE WHEN year(l_shipdate) = 1996 AND month(l_shipdate) > 6 AND l_suppkey % 3 = 0 THEN NULL
       WHEN (l_suppkey*7 + month(l_shipdate)*5) % 12 < (l_suppkey + year(l_shipdate)) % 12 THEN NULL
       WHEN l_discount > 0.095 AND l_linenumber = 7 THEN l_quantity * 20.0
       ELSE l_quantity - 3.0 END AS no2
FROM lineitem"""

STAGING = """
SELECT site_id, no2,
  CASE WHEN no2 IS NULL AND month(date_time) = 2 THEN 'no data'
       ELSE concat(lpad(CAST(day(date_time) AS STRING), 2, '0'), '/',
                   lpad(CAST(month(date_time) AS STRING), 2, '0'), '/',
                   CAST(year(date_time) AS STRING), ' ',
                   lpad(CAST(hour(date_time) AS STRING), 2, '0'), ':00') END AS date_time
FROM readings"""

SITES = """
SELECT s_suppkey AS site_id,
  CASE WHEN s_acctbal < 0 THEN concat('Shared ', CAST(s_nationkey AS STRING)) ELSE s_name END AS site_name,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Background' ELSE 'ROADSIDE' END AS site_type,
  CASE WHEN s_suppkey % 4 = 0 THEN 'INSIDE' ELSE 'OUTSIDE' END AS caz_zone,
  CAST(52280 + s_suppkey*37 % 340 AS DOUBLE) / 1000 AS latitude,
  CAST(s_suppkey*53 % 390 - 2070 AS DOUBLE) / 1000 AS longitude,
  CASE WHEN s_nationkey < 4 THEN NULL WHEN s_nationkey < 12 THEN 'DEFRA' ELSE 'BCC' END AS data_source,
  CAST('2000-01-01' AS DATE) AS start_date,
  CASE WHEN s_suppkey % 9 = 0 THEN CAST('2001-06-30' AS DATE)
       WHEN s_suppkey % 31 = 0 THEN CAST('1999-06-30' AS DATE) END AS end_date
FROM supplier"""

WARDS = """
SELECT c_custkey AS area_code,
  CASE WHEN c_custkey % 50 = 0 THEN concat(c_name, ' ') ELSE c_name END AS area_name,
  CASE WHEN c_custkey = 4 THEN CAST(524741 AS DOUBLE) / 10000
       ELSE CAST(52280 + c_custkey*37 % 340 AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN c_custkey = 4 THEN CAST(-18715 AS DOUBLE) / 10000
       ELSE CAST(c_custkey*53 % 390 - 2070 AS DOUBLE) / 1000 END AS longitude      -- ward 4 is a corner of the zone
FROM customer"""

TRAFFIC = """
SELECT d AS date, v AS vehicle_type,
  CASE WHEN v IN ('Unrecognised','Motorcycles and Other') THEN NULL ELSE ok END AS compliant_vehicles,
  CASE WHEN v IN ('Unrecognised','Motorcycles and Other') THEN NULL ELSE n - ok END AS noncompliant_vehicles,
  n AS total_vehicles
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d,
        CASE WHEN o_custkey % 9 = 1 THEN 'Bus/Coach' WHEN o_custkey % 9 = 2 THEN 'Mini-Bus'
             WHEN o_custkey % 9 = 4 THEN 'Exempt' WHEN o_orderpriority = '1-URGENT' THEN 'Car'
             WHEN o_orderpriority = '2-HIGH' THEN 'LGV' WHEN o_orderpriority = '3-MEDIUM' THEN 'HGV'
             WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unrecognised' ELSE 'Motorcycles and Other' END AS v,
        CAST(count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS INT) AS ok, CAST(count(*) AS INT) AS n
      FROM orders GROUP BY 1, 2) g"""

ADMISSIONS = """
SELECT c_mktsegment AS health_condition, c_nationkey AS area_code,
  CAST(concat(CAST(year(o_orderdate) AS VARCHAR(4)), '-04-01') AS DATE) AS fiscal_start_date,
  CAST(count(*) AS INT) AS admissions, CAST(count(DISTINCT o_custkey)*100 AS INT) AS population,
  CAST(count(*)*1000.0/(count(DISTINCT o_custkey)*100) AS DECIMAL(8,2)) AS standardised_rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""


def _text(micro_degrees: str) -> str:
    return f"CAST(CAST(({micro_degrees}) * 0.000001 AS DECIMAL(12,6)) AS STRING)"


def _ring(corners: list[tuple[str, str]]) -> str:
    """Closed ring text round (px, py); corners are micro-degree offsets."""
    points = [f"{_text(f'px + {dx}')}, ' ', {_text(f'py + {dy}')}" for dx, dy in [*corners, corners[0]]]
    return "concat('(', " + ", ', ', ".join(points) + ", ')')"


# Some corners sit within the simplification tolerance of a chord, some do not; none are equally far from one.
_OUTER = _ring([("-4000", "-3000"), ("0", "-3000 + c % 160 - 80"), ("4000", "-3000"),
                ("4000 + c*7 % 400 - 200", "0"), ("4000", "3000"), ("1500", "3000 + c*3 % 150 * 2"),
                ("-1500", "3001 + c*11 % 150 * 2"), ("-4000", "3000"), ("-4000 - c*5 % 250", "500")])
_HOLE = _ring([("-500", "-500"), ("-500", "500"), ("500 + c % 90", "500"), ("500", "-500")])
_ISLAND = _ring([("9000", "0"), ("9500", "c % 70"), ("10000", "0"), ("9500", "800")])

BOUNDARIES = f"""
SELECT CAST(c AS INT) AS fid, c AS wd23cd, name AS wd23nm, CAST(NULL AS STRING) AS wd23nmw,
  concat('L', CAST(nation AS STRING)) AS lad23cd, concat('Authority ', CAST(nation AS STRING)) AS lad23nm,
  CASE WHEN c % 10 = 0 THEN concat('MULTIPOLYGON((', {_OUTER}, ',', {_HOLE}, '), (', {_ISLAND}, '))')
       ELSE concat('POLYGON(', {_OUTER}, ')') END AS wkt
FROM (SELECT c_custkey AS c, c_name AS name, c_nationkey AS nation,
             (c_custkey*53 % 390 - 2070)*1000 AS px, (c_custkey*37 % 340 + 52280)*1000 AS py
      FROM customer WHERE c_custkey % 17 <> 5) k"""

# Outline of each tier: the extent of the wards dealt to it, with one corner that simplification drops.
OUTLINES = f"""
SELECT caz_tier, concat('MULTIPOLYGON((', concat('(',
    {_text('x0')}, ' ', {_text('y0')}, ', ', {_text('x0 + 900')}, ' ', {_text('y0 + 40')}, ', ',
    {_text('x1')}, ' ', {_text('y0')}, ', ', {_text('x1')}, ' ', {_text('y1')}, ', ',
    {_text('x0')}, ' ', {_text('y1')}, ', ', {_text('x0')}, ' ', {_text('y0')}, ')'), '))') AS wkt
FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN '1. Inside CAZ' WHEN 1 THEN '2. Close Boundary (<=500m)'
               WHEN 2 THEN '3. Near Boundary (500m-2km)' WHEN 3 THEN '4. Background (2km-5km)'
               ELSE '5. Outer Regional Control (>5km)' END AS caz_tier,
             min(c_custkey*53 % 390 - 2070)*1000 AS x0, max(c_custkey*53 % 390 - 2070)*1000 AS x1,
             min(c_custkey*37 % 340 + 52280)*1000 AS y0, max(c_custkey*37 % 340 + 52280)*1000 AS y1
      FROM customer GROUP BY 1) o"""

# The same tables as they might arrive: repeated keys, missing values, broken totals, rows without their parent.
# Only the audits read them, as a load would refuse them.
LOOSE_READINGS = """
SELECT CASE WHEN month(date_time) = 3 AND site_id % 7 = 1 THEN NULL ELSE site_id END AS site_id,
  CASE WHEN site_id % 8 = 2 AND no2 IS NULL THEN NULL ELSE date_time END AS date_time, no2 FROM readings"""
LOOSE_SITES = """
SELECT CASE WHEN site_id % 6 = 5 THEN NULL ELSE site_id END AS site_id, site_name FROM sites WHERE site_id % 4 <> 3
UNION ALL SELECT site_id, site_name FROM sites WHERE site_id % 5 = 1"""
LOOSE_WARDS = """
SELECT area_code, CASE WHEN area_code % 30 = 6 THEN NULL ELSE area_name END AS area_name,
  CASE WHEN area_code % 40 = 9 THEN NULL ELSE latitude END AS latitude, longitude FROM wards WHERE area_code % 7 <> 3
UNION ALL SELECT area_code, area_name, latitude, NULL FROM wards WHERE area_code % 20 = 4"""
LOOSE_TRAFFIC = """
SELECT date, CASE WHEN month(date) = 5 AND vehicle_type = 'Car' THEN NULL ELSE vehicle_type END AS vehicle_type,
  CASE WHEN month(date) = 6 THEN NULL ELSE compliant_vehicles END AS compliant_vehicles,
  noncompliant_vehicles + CASE WHEN month(date) = 7 THEN 1 ELSE 0 END AS noncompliant_vehicles,
  CASE WHEN month(date) = 8 AND vehicle_type = 'HGV' THEN NULL ELSE total_vehicles END AS total_vehicles FROM traffic
UNION ALL SELECT * FROM traffic WHERE month(date) = 2"""
LOOSE_ADMISSIONS = """
SELECT health_condition, area_code, fiscal_start_date, CASE WHEN area_code % 9 = 2 THEN -admissions ELSE admissions END AS admissions,
  CASE WHEN area_code % 8 = 4 THEN NULL WHEN area_code % 8 = 5 THEN 0 ELSE population END AS population, standardised_rate FROM admissions
UNION ALL SELECT health_condition, area_code, fiscal_start_date, admissions, population, NULL FROM admissions WHERE area_code % 5 = 1"""
LOOSE_BOUNDARIES = """
SELECT CASE WHEN fid % 12 = 3 THEN 'Shared name' WHEN fid % 25 = 6 THEN NULL ELSE wd23nm END AS wd23nm,
  CASE WHEN fid % 14 = 2 THEN NULL ELSE wkt END AS wkt FROM boundaries"""
# One tier is missing, one is listed twice, one has no name; two calendar years share a fiscal year.
LOOSE_TIERS = """
SELECT caz_tier FROM outlines WHERE caz_tier NOT LIKE '3%' UNION ALL SELECT caz_tier FROM outlines WHERE caz_tier LIKE '5%'
UNION ALL SELECT NULL FROM outlines WHERE caz_tier LIKE '1%'"""
LOOSE_YEARS = """
SELECT calendar_year, CASE WHEN calendar_year = 1999 THEN '1998/99'
    ELSE concat(CAST(calendar_year AS STRING), '/', CAST(calendar_year + 1 AS STRING)) END AS fiscal_year
FROM (SELECT DISTINCT year(date_time) AS calendar_year FROM readings WHERE year(date_time) > 1995) y
UNION ALL SELECT 1998, '1998/99'"""

# In order of dependence.
VIEWS = {"readings": READINGS, "staging": STAGING, "sites": SITES, "wards": WARDS, "traffic": TRAFFIC,
         "admissions": ADMISSIONS, "boundaries": BOUNDARIES, "outlines": OUTLINES,
         "loose_readings": LOOSE_READINGS, "loose_sites": LOOSE_SITES, "loose_wards": LOOSE_WARDS, "loose_traffic": LOOSE_TRAFFIC,
         "loose_admissions": LOOSE_ADMISSIONS, "loose_boundaries": LOOSE_BOUNDARIES, "loose_tiers": LOOSE_TIERS,
         "loose_years": LOOSE_YEARS}
LOOSE_OF = {"loose_years": "readings", "loose_tiers": "outlines"} | {
    n: n.removeprefix("loose_") for n in VIEWS if n.startswith("loose_") and n not in ("loose_years", "loose_tiers")}
BASE_TABLES = {"readings": "lineitem", "staging": "readings", "sites": "supplier", "wards": "customer",
               "traffic": "orders", "boundaries": "customer", "outlines": "customer"}
