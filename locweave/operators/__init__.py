"""Operators over tables of locs, patterns, samples and reports."""
