"""Operators over DataFrames: term statistics, ranking, graphs, learning to rank, trees, sessions, tests."""
