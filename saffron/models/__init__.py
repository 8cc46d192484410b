"""Spark ML pipelines over dense panels, and their evaluation."""
