"""Alignment of process models with the texts that describe them, for many cases in one Spark job."""
