"""Labels, limits and shapes that results are compared on.

Every value here is a default; the functions that use one take it as a keyword.
"""

# Data-capture rules for annual means.
SENTINEL_FLOOR = -1.0          # readings below this are instrument error codes
SPIKE_LIMIT = 500.0            # readings above this are physically implausible
CAPTURE_THRESHOLD = 0.75       # share of a month's readings that must be valid
PASS_MONTHS = 9                # valid months needed to use an annual mean directly
ANNUALISE_MONTHS = 3           # fewest valid months that can still be annualised

# Status texts of a site-year.
STATUS_PASS = "PASS (Use As-Is)"
STATUS_ANNUALISE = "ACTION (Requires Annualisation)"
STATUS_EXCLUDE = "ACTION (Exclude - Insufficient Data)"
PASS_PREFIX = "PASS"

# Peak-percentile eligibility texts.
PERCENTILE_VALID = "VALID"
PERCENTILE_INVALID = "INVALID (Seasonal Bias Risk)"
DIRECTIVE_COMPUTE = "Compute PERCENTILE_CONT(0.998) from hourly data"
DIRECTIVE_PROXY = "Nullify Percentile; Flag via DEFRA > 60 µg/m³ Mean Proxy"
DIRECTIVE_SUPPRESS = "Suppress from acute peak reporting entirely"
PEAK_QUANTILE = 0.998
PEAK_HOURS = 19
REFERENCE_SITE_TYPE = "BACKGROUND"

# Metropolitan bounding box, degrees.
LATITUDE_BOUNDS = (52.30, 52.60)
LONGITUDE_BOUNDS = (-2.05, -1.70)
LATITUDE_FLAG = "Latitude Out of Bounds"
LONGITUDE_FLAG = "Longitude Out of Bounds"

# Distance tiers (label, description) and their upper limits in metres.
TIER_INSIDE = "1. Inside CAZ"
TIER_STRADDLES = "2. Close Boundary (Straddles CAZ)"
TIER_CLOSE = "2. Close Boundary (<=500m)"
TIER_NEAR = "3. Near Boundary (500m-2km)"
TIER_BACKGROUND = "4. Background (2km-5km)"
TIER_OUTER = "5. Outer Regional Control (>5km)"
TIER_LIMITS = ((500.0, TIER_CLOSE), (2000.0, TIER_NEAR), (5000.0, TIER_BACKGROUND))
TIER_DESCRIPTIONS = (
    (TIER_INSIDE, "Core Clean Air Zone area"),
    (TIER_CLOSE, "Buffer zone within 500 meters of boundary"),
    (TIER_NEAR, "Extended buffer zone between 500m and 2km"),
    (TIER_BACKGROUND, "Background comparison zone between 2km and 5km"),
    (TIER_OUTER, "Outer regional control zone greater than 5km"),
)

# The zone outline, lon lat in EPSG:4326.
ZONE_NAME = "Ring Road Zone"
ZONE_WKT = (
    "POLYGON((-1.9168 52.4883, -1.8801 52.4891, -1.8715 52.4741, "
    "-1.8902 52.4635, -1.9150 52.4690, -1.9168 52.4883))"
)

# Vehicle classes and fleet load weights.
UNRECOGNISED = "Unrecognised"
BASELINE_LABEL = "Recognised Baseline"
IMPUTED_LABEL = "Imputed Unrecognised"
BASELINE_YEAR = 2022
NONCOMPLIANT_WEIGHT = 1.0
COMPLIANT_WEIGHTS = {
    "Car": 0.327,
    "LGV": 0.725,
    "HGV": 0.15,
    "Bus/Coach": 0.15,
    "Mini-Bus": 0.65,
    "Exempt": 0.60,
}
TOTAL_WEIGHTS = {"Motorcycles and Other": 0.10}
OTHER_TOTAL_WEIGHT = 0.50

# Map layer texts and text limits.
LAYER_ZONE = "CAZ Boundary"
LAYER_SITE = "Monitoring Site"
LAYER_WARD = "Ward Boundary"
LAYER_HOSPITAL_WARD = "Hospital Ward Boundary"
TIER_LABEL_PREFIX = "CAZ Tier "
SIMPLIFY_TOLERANCE = 0.0001
WKT_DIGITS = 5
TEXT_CELL_LIMIT = 32766

# Other expectations.
EXPECTED_WARDS = 69
FISCAL_START_MONTH = 4
CALENDAR_YEARS = (2018, 2025)
TIMESTAMP_PATTERN = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})$"   # DD/MM/YYYY HH24:MI
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
