"""Operators: functions from DataFrames to DataFrames. None of them calls an action unless its
name says so (``require_...``)."""
