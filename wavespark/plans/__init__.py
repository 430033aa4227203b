"""Whole tasks, and the queries registered for checks and benchmarks."""
