"""Relational, geometric and interval operators: functions from DataFrame to DataFrame."""
