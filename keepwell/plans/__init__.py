"""Whole jobs: preprocessing, training, scoring, explaining."""
