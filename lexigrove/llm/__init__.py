"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Every operator takes and returns DataFrames, never touches local files
and never sends document-sized data to the driver.
"""
