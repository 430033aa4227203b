"""Relational operators over tables of windows, features and models."""
