"""Operators for preparing large training corpora (one module each).

Nothing else in the library imports this subpackage. ``queries.QUERIES``
holds the registered queries and ``queries.ORACLE`` their DuckDB SQL.
"""
