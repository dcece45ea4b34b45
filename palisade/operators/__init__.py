"""Detectors, joins, scoring, policy, history and reports: DataFrame in, DataFrame out."""
