"""Operators for building large text corpora, on Spark.

One module for each operator; ``queries`` registers them with the driver.  Nothing outside this subpackage imports it.
"""
