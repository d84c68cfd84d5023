"""Values the results depend on, stated as they are published with the data."""

# --- fixed values -----------------------------------------------------------
# Speed conditions of one segment-hour.
WIDE_SPREAD = 0.4        # standard deviation over harmonic mean
JAM_SHARE = 0.6          # harmonic mean below this share of the posted limit
PERCENTILE_LEVELS = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95]
P15_POSITION = 3         # 1-based positions in the 19-value array
P50_POSITION = 10
P85_POSITION = 17
PERCENTILE_STEPS = 20.0  # each percentile stands for one twentieth of the vehicles
KMH_PER_MPH = 1.609344

# Hours read as peak and as night.
PEAK_HOURS = [7, 8, 9, 16, 17, 18]
NIGHT_HOURS = [22, 23, 0, 1, 2, 3, 4, 5]

# The week: slot 0 is Monday 00:00, slot 167 is Sunday 23:00.
SLOTS_PER_WEEK = 168
DAYS_PER_WEEK = 7

# Floors, reaches and bands of the reports.
MIN_MEASURED_KM_PER_DAY = 1000.0
MAX_ASSIGNMENT_M = 1500.0
COVERAGE_HIGH_PCT = 70.0
COVERAGE_LOW_PCT = 30.0
WEEKLY_PROFILE_CLASSES = [0, 2, 4, 7]

# Road classes of the map, most important first.
DRIVEABLE = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified",
             "residential", "living_street", "service"]
NOT_DRIVEABLE = ["pedestrian", "footway", "steps", "path", "cycleway", "bridleway", "track",
                 "unknown"]
MAJOR_ROADS = ["motorway", "trunk", "primary"]

# Attribute arrays whose fill rate is reported.
MAP_ATTRIBUTES = ["speed_limits", "speed_profiles", "access_restrictions",
                  "prohibited_transitions", "gradient", "curvature", "road_surface", "routes",
                  "house_numbers", "dual_carriageway", "truck_routes", "hazmat", "toll"]

# British postcode levels read from a full code or from a bare district.
POSTCODE_PATTERNS = {
    "sector": "^([A-Z]{1,2}[0-9][0-9A-Z]? [0-9])",
    "district": "^([A-Z]{1,2}[0-9][0-9A-Z]?)",
}

# Per-road signals that are averaged onto cells and postcodes.
SPEED_SIGNALS = ["mean_speed_kph", "peak_speed_kph", "speed_spread", "congested_hours_pct",
                 "speeding_hours_pct", "single_observation_pct"]

# Road features of a postcode; the volume features need no speed data.
VOLUME_FEATURES = ["vehicle_km_per_day", "major_road_share", "network_coverage_pct",
                   "weekend_traffic_ratio"]
ROAD_FEATURES = ["vehicle_km_per_day", "major_road_share", "network_coverage_pct",
                 "mean_speed_kph", "peak_speed_kph", "speed_spread", "congested_hours_pct",
                 "speeding_hours_pct", "single_observation_pct", "weekend_traffic_ratio"]

# Claims panel: years, months and serious severities.
TARGET_YEAR = 2025
HISTORY_YEAR = 2024
TRAIN_MONTHS = [1, 2, 3, 4, 5, 6, 7, 8, 9]
TEST_MONTHS = [10, 11, 12]
SERIOUS_SEVERITIES = [1, 2]
BLOCK_FOLDS = 5
RATE_FLOOR = 1e-3
# --- end of fixed values ----------------------------------------------------
