"""Booking value and recommendation analytics as plain Spark DataFrame functions."""
