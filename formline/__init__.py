"""Grouped, time-ordered event analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
