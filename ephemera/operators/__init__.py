"""Operators from DataFrame to DataFrame: joins in time, profiles, windows, preparation, evaluation, forecasts."""
