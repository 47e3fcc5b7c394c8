"""The contract shared with the data producers and consumers.

Everything below is data, not logic: category domains, column rules, feature lists, draw
weights, thresholds and message texts. Results must reproduce them exactly, but for one
rule: the ``TRIP_*`` texts are the words alone, without the symbol that a page shows before them.
"""

# --- fixed values: categories ------------------------------------------------
SEVERITY_LABELS = {1: "Minor", 2: "Serious", 3: "Fatal"}
VEHICLE_TYPES = ["Car", "Motorcycle", "Bus", "Truck", "Auto-rickshaw", "Bicycle"]
ROAD_TYPES = ["Highway", "City Road", "Rural Road", "Residential"]
WEATHER_TYPES = ["Clear", "Rain", "Fog", "Night"]
SEASON_MONTHS = {
    "Winter": [12, 1, 2],
    "Spring": [3, 4, 5],
    "Monsoon": [6, 7, 8, 9],
    "Post-Monsoon": [10, 11],
}
WEEKEND_DAYS = [5, 6]  # Monday is 0

# --- fixed values: sample generator ------------------------------------------
CITY_CENTRES = {
    "Mumbai": (19.0760, 72.8777),
    "Delhi": (28.7041, 77.1025),
    "Bangalore": (12.9716, 77.5946),
    "Chennai": (13.0827, 80.2707),
    "Kolkata": (22.5726, 88.3639),
    "Hyderabad": (17.3850, 78.4867),
    "Pune": (18.5204, 73.8567),
    "Ahmedabad": (23.0225, 72.5714),
    "Surat": (21.1702, 72.8311),
    "Jaipur": (26.9124, 75.7873),
}
CITY_STATES = {
    "Mumbai": "Maharashtra",
    "Delhi": "Delhi",
    "Bangalore": "Karnataka",
    "Chennai": "Tamil Nadu",
    "Kolkata": "West Bengal",
    "Hyderabad": "Telangana",
    "Pune": "Maharashtra",
    "Ahmedabad": "Gujarat",
    "Surat": "Gujarat",
    "Jaipur": "Rajasthan",
}
UNKNOWN_STATE = "Unknown"
HOUR_WEIGHTS = [
    0.5, 0.3, 0.2, 0.2, 0.3, 0.5, 1.0, 1.5, 2.0, 1.8, 1.5, 1.3,
    1.2, 1.1, 1.0, 1.2, 1.5, 2.2, 2.5, 2.0, 1.8, 1.5, 1.0, 0.7,
]
SEVERITY_WEIGHTS = [0.7, 0.25, 0.05]
VEHICLE_WEIGHTS = [0.4, 0.3, 0.1, 0.1, 0.08, 0.02]
ROAD_WEIGHTS = [0.3, 0.4, 0.2, 0.1]
WEATHER_WEIGHTS = [0.6, 0.2, 0.1, 0.1]
SAMPLE_SEED = 42
SAMPLE_START = "2020-01-01"
SAMPLE_DAYS = 1460
SAMPLE_OFFSET_DEGREES = 0.1
SAMPLE_MINOR_FATALITY_RATE = 0.1

# --- fixed values: thresholds ------------------------------------------------
CLUSTER_MIN_INCIDENTS = 3
GRID_MIN_INCIDENTS = 5
ROAD_RISK_MIN_INCIDENTS = 5
FATALITY_WEIGHT = 3
HOTSPOT_QUANTILE = 0.8
RISK_LEVEL_BOUNDS = [(1.5, "LOW"), (2.2, "MEDIUM"), (2.7, "HIGH")]
RISK_LEVEL_TOP = "CRITICAL"
REQUEST_RADIUS_KM = 5.0
RADIUS_METERS = 1000
SCORING_DEFAULTS = {
    "cell_density": 0.0,
    "neighbor_density": 0.0,
    "city_avg_severity": 2.0,
    "city_severity_std": 0.5,
    "city_avg_casualties": 1.5,
    "road_type_risk": 2.0,
    "vehicle_type_risk": 2.0,
}

# --- fixed values: advice texts ----------------------------------------------
TRIP_RUSH_HOURS = [7, 8, 9, 17, 18, 19, 20]
VULNERABLE_VEHICLES = ["Motorcycle", "Bicycle"]
TRIP_HIGH_RISK = "High risk area - exercise extreme caution"
TRIP_RUSH = "Rush hour - expect heavy traffic and delays"
TRIP_WEATHER = "Poor weather conditions - reduce speed and increase following distance"
TRIP_VULNERABLE = "Vulnerable vehicle type - wear protective gear and stay visible"
TRIP_HIGHWAY = "Highway driving - maintain safe speeds and distances"
TRIP_DEFAULT = "Relatively safe conditions - maintain standard safety practices"
CITY_FATALITY = "CRITICAL: High fatality rate - implement emergency safety measures"
CITY_SEVERITY = "HIGH: Install speed monitoring and traffic calming measures"
CITY_RUSH = "MEDIUM: Rush hour accidents peak at %d:00 - optimize traffic signals"
INFRA_CAMERAS = "Install speed cameras"
INFRA_BARRIERS = "Add median barriers"
INFRA_EMERGENCY = "Improve emergency response"
INFRA_SIGNALS = "Traffic signal optimization"
INSIGHT_HOUR = (
    "Peak Hour Alert",
    "Hour %s:00 has the highest accident rate (%d accidents). "
    "Consider increased traffic monitoring during this time.",
    "High",
)
INSIGHT_CITIES = (
    "Fatal Accident Hotspots",
    "Cities with highest fatal accidents: %s. Immediate infrastructure review recommended.",
    "Critical",
)
INSIGHT_VEHICLES = (
    "Vehicle Safety Focus",
    "Focus safety campaigns on %s drivers - they have higher average accident severity.",
    "Medium",
)
INSIGHT_WEATHER = (
    "Weather-Based Prevention",
    "Most accidents occur during %s conditions. Deploy weather-specific safety measures.",
    "Medium",
)

# --- fixed values: hour ranges, inclusive -------------------------------------
SPARK_HOURS = {"morning": (7, 10), "evening": (17, 20), "night": (21, 5)}
WAREHOUSE_HOURS = {"morning": (6, 10), "evening": (17, 21), "night": (22, 5)}

# --- fixed values: column rules ------------------------------------------------
REQUIRED = ("city", "state", "latitude", "longitude", "accident_datetime", "date", "time")
RANGES = {"hour": (0, 23), "day_of_week": (0, 6), "month": (1, 12), "year": (2000, 2030)}
REQUEST_RANGES = {"latitude": (-90, 90), "longitude": (-180, 180), "hour": (0, 23)}

# --- fixed values: features of the models --------------------------------------
SEVERITY_NUMERIC = [
    "latitude", "longitude", "hour", "day_of_week", "month",
    "is_weekend", "is_rush_hour", "is_night", "cell_density", "neighbor_density",
    "city_avg_severity", "city_severity_std", "city_avg_casualties",
    "road_type_risk", "vehicle_type_risk",
]
SEVERITY_CATEGORIES = ["city", "state", "vehicle_type", "road_type", "weather", "season"]
CASUALTY_NUMERIC = [
    "latitude", "longitude", "hour", "day_of_week", "month", "severity",
    "is_weekend", "is_rush_hour", "is_night", "cell_density", "neighbor_density",
    "road_type_risk", "vehicle_type_risk",
]
CASUALTY_CATEGORIES = ["city", "vehicle_type", "road_type", "weather"]
HOTSPOT_NUMERIC = ["center_lat", "center_lon", "avg_severity", "common_hour"]
HOTSPOT_LEAKING = "density_score"  # a function of the label; only on request
HOTSPOT_CATEGORIES = ["common_vehicle", "common_road"]
