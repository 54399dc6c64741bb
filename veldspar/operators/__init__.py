"""Operators: DataFrame -> DataFrame or -> Column."""
