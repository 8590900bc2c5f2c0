"""Analytical operators: functions from tables to lazy DataFrames."""
