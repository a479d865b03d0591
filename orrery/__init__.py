"""Alignment of dataset indexes and point clouds on Spark."""
