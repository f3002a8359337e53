"""Budgeted read sampling on Spark: tiles, junctions, screening, ranking, replay."""
