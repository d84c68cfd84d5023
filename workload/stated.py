"""A model with stated weights, so that everything derived from a model has a closed form in SQL."""

from __future__ import annotations

from roadlens.plans.claims_model import SIZE, PoissonModel

INTERCEPT = 0.1

# --- fixed values: weight, mean and deviation of each feature ----------------
VALUES = {
    "month": (0.02, 6.0, 3.0),
    "addresses": (0.4, 3.0, 1.0),
    "vehicle_km_per_day": (0.3, 9.0, 1.0),
    "major_road_share": (-0.1, 0.5, 0.2),
    "network_coverage_pct": (0.05, 80.0, 10.0),
    "mean_speed_kph": (-0.2, 50.0, 20.0),
    "peak_speed_kph": (0.15, 45.0, 20.0),
    "speed_spread": (0.25, 0.4, 0.2),
    "congested_hours_pct": (0.1, 30.0, 25.0),
    "speeding_hours_pct": (-0.05, 40.0, 25.0),
    "single_observation_pct": (-0.15, 15.0, 10.0),
    "weekend_traffic_ratio": (0.08, 0.8, 0.1),
}
# --- end of fixed values -----------------------------------------------------


def model(names: list[str]) -> PoissonModel:
    pick = lambda i: {name: VALUES[name][i] for name in names}
    return PoissonModel(list(names), INTERCEPT, pick(0), pick(1), pick(2))


MODEL, SIZE_MODEL = model(list(VALUES)), model(SIZE)
