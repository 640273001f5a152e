"""Extractors: functions from the text of one file to typed rows, run over many files by Spark."""
