"""Detectors: score(row) in [-1, 0], lower is worse; update(row) afterwards.  No Spark imports here."""
