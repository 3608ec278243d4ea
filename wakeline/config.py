"""Fixed values of the analysis (must equal the published method for equal results)."""

from __future__ import annotations

# -- tracks ---------------------------------------------------------------
MAX_SOG_KN = 45.0
SOG_CAP_KN = 80.0
GAP_FLAG_MIN = 20.0
GAP_SPLIT_MIN = 360.0
MIN_TRACK_POINTS = 2
LOITER_KN = 2.0
LOITER_MIN = 30.0
KN_PER_MS = 1.0 / 0.514444
SLICE_H = 6.0            # time slice of the skew-safe windows
FOLD_BLOCK = 1024        # fixes per block of the greedy speed filter

# -- attribution ----------------------------------------------------------
SEARCH_RADIUS_KM = 25.0
TIME_PAD_H = 2.0
ST_SIGMA_KM = 7.0
ST_PROX_SIGMA_KM = 5.0
ST_HALF_WIN_H = 1.5
AXIS_TOL_DEG = 55.0
GATE_KNEE = 0.12
BLACKOUT_FULL_MIN = 120.0
MIN_SCORE = 8.0
TOP_VERDICT_SCORE = 45.0
CLEAR_MARGIN = 15.0

FUSION_WEIGHTS = {
    "spatiotemporal": 0.30, "axis_alignment": 0.18, "proximity": 0.14, "dwell": 0.10,
    "blackout": 0.10, "route_deviation": 0.09, "vessel_prior": 0.09,
}
BASELINE_WEIGHTS = {
    "spatiotemporal": 0.45, "axis_alignment": 0.30, "proximity": 0.15, "dwell": 0.10,
}
EVIDENCE_COMPONENTS = [
    "spatiotemporal", "axis_alignment", "proximity", "dwell", "blackout",
    "ais_anomaly", "route_deviation", "vessel_prior",
]
SCORE_BANDS = [("PRIME_SUSPECT", 70.0), ("PERSON_OF_INTEREST", 45.0), ("WEAK_LEAD", 20.0)]
CONFIDENCE_BANDS = [("HIGH", 0.70), ("MEDIUM", 0.45), ("LOW", 0.30)]
TYPE_PRIOR = {
    "TANKER": 1.00, "CARGO": 0.72, "BULK": 0.70, "CONTAINER": 0.62,
    "PASSENGER": 0.35, "FISHING": 0.30, "TUG": 0.40, "HSC": 0.25,
    "PLEASURE": 0.15, "MILITARY": 0.20, "OTHER": 0.30, "UNKNOWN": 0.30,
}
TYPE_PRIOR_DEFAULT = 0.30

# -- ping model -----------------------------------------------------------
FEATURES = [
    "speed", "course", "rot", "msg_type", "status", "accuracy",
    "course_diff", "rot_diff", "speed_diff", "lat_diff", "long_diff",
]
ANOMALY_THRESHOLD = 1.104481
SEVERITY_HIGH, SEVERITY_CRITICAL = 2.0, 5.0

# -- trajectory model -----------------------------------------------------
BOX_LAT = (-20.565386666666665, -20.05773333333333)
BOX_LON = (57.725333333333325, 58.37872)
BOX_SPEED_MAX = 19.3
SEQ_LEN = 8
MEDIAN_ERR_KM, P90_ERR_KM = 0.19, 0.63
NOMINAL_CADENCE_S = 60.0
RELIABLE_COURSES = ((200.0, 290.0), (20.0, 110.0))
COVERAGE_GAP_FACTOR = 4.0
DEVIATION_SCALE_KM = 5.0 * P90_ERR_KM

# -- drift ----------------------------------------------------------------
WIND_FACTOR, WIND_DEFLECTION_DEG, CURRENT_FACTOR, STOKES_FACTOR = 0.030, 17.0, 1.00, 0.012
DIFFUSIVITY = 8.0
TIMESTEP_S = 600.0
N_PARTICLES = 900
MAX_BACKTRACK_H = 48.0
HORIZONS_H = (6.0, 12.0, 24.0, 48.0)
ORIGIN_GRID, ORIGIN_PAD_KM, ORIGIN_SMOOTH = 140, 8.0, 2.2
AGE_WIDTH0_M, AGE_SPAN, AGE_K = 450.0, 3.29, 2.2
NEAR_EDGE_H = 0.5
SEED_SIGMA_M = 1000.0
STILL_EPS_DEG = 1e-7
OIL_COEFFS = {
    "light_crude": (2.86, 0.045), "medium_crude": (1.65, 0.045), "heavy_crude": (0.39, 0.013),
    "diesel": (3.28, 0.037), "bunker": (0.13, 0.013),
}
DEFAULT_OIL, DEFAULT_WATER_C = "medium_crude", 26.0
FILM_M, OIL_DENSITY, WATER_DENSITY = 1.0e-3, 870.0, 1025.0
MAX_EVAPORATED, FAY_K, VISCOSITY, GRAVITY = 0.75, 1.45, 1.0e-6, 9.81
DOUGLAS = [(0.5, 0), (1.5, 1), (3.3, 2), (5.4, 3), (7.9, 4), (10.7, 5), (13.8, 6), (17.1, 7), (20.7, 8)]

# -- radar ----------------------------------------------------------------
ENL_DEFAULT, LEE_WINDOW, LEE_CMAX = 4.4, 7, 1.73
HYSTERESIS_STEP_DB, OFFSET_K = 1.4, 1.8
OFFSET_MIN_DB, OFFSET_MAX_DB = 1.2, 6.0
MIN_AREA_PX, MIN_AREA_KM2, MAX_AREA_FRAC = 350, 0.5, 0.35
OIL_THRESHOLD, REAL_THRESHOLD = 0.30, 0.75
GATE_WIND_MS, GATE_COAST_KM, GATE_GRADIENT, GATE_SPREADING, GATE_CONTRAST_DB = 13.0, 0.6, 0.06, 82.0, 1.8
BACKGROUND_SCALES = {"SAR": (20, 40, 80, 170), "EO": (8, 16, 32, 60)}
RULE_TERMS = [
    # weight, column, default, centre, divisor, sign
    (0.30, "mean_contrast_db", 0.0, 2.5, 6.0, 1), (0.26, "border_gradient_db_px", 0.0, 0.05, 0.45, 1),
    (0.16, "elongation", 1.0, 1.5, 8.0, 1), (0.12, "complexity", 1.0, 1.2, 2.0, 1),
    (0.10, "solidity", 1.0, 0.85, 0.45, -1), (0.06, "spreading", 50.0, 40.0, 40.0, -1),
]

# -- alerts ---------------------------------------------------------------
ALERT_THRESHOLD, COOLDOWN_MIN, DEDUP_GRID_DEG, BUCKET_MIN, MAX_ATTEMPTS = 0.75, 180, 0.05, 60, 3
