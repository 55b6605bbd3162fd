"""The library's own queries, as the entry file wraps them (without ``llm``)."""

import __spark_entry__ as E
from tablework.plans.queries import ORACLE, QUERIES


def core_queries():
    every = E.queries()
    return {k: every[k] for k in QUERIES}


def core_sql():
    return dict(ORACLE)
