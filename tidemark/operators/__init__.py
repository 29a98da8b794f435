"""Operators on change logs, progress, votes and membership: DataFrame to DataFrame."""
