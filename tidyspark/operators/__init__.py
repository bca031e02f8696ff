"""Verbs: functions from tables to tables."""
