"""Quillgate: a Spark-native governed analytics engine.

A human-approved catalog says what may be queried; a typed logical plan and a
guarded read-only SQL dialect are both turned into DataFrames, and Catalyst
does the planning and the execution.
"""

__version__ = "0.1.0"
