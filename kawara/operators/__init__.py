"""Operators on DataFrames: entity resolution, views, serving, maintenance."""
