"""Batch and streaming jobs for subtitle and dubbing-timeline tables on Spark."""
