"""Operators over DataFrames: pairing by keys, lookups, point-cloud normalisation, model calls."""
