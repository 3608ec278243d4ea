"""Registered queries over the given tables."""

import importlib

MODULES = ["q_tracks", "q_evidence", "q_records", "q_drift", "q_raster", "q_models"]


def all_queries():
    from wakeline.plans import registry
    for m in MODULES:
        importlib.import_module(f"wakeline.plans.{m}")
    return registry.QUERIES, registry.ORACLES
