"""Operators on DataFrames: similarity, ranking, flow, statistics, overlap, evaluation."""
