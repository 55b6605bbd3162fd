"""tablework: PySpark-native table analysis.

Load heterogeneous sources into typed DataFrames, clean, validate and
profile them, answer analytical questions (counts, group statistics, top
groups, distributions, patterns, percentages, correlation, regression,
date-delay trends, chart series), shape answers as typed JSON, and parse,
roll up and grade large tables of model responses and runs. Everything is
lazy DataFrame code left to Catalyst and adaptive execution.
"""

from tablework.session import build_session, configure, shared_dir

__all__ = ["build_session", "configure", "shared_dir"]
__version__ = "0.1.0"
