"""Sources and sinks: files, partitioned datasets, JDBC, workbooks,
archives and tables inside web pages."""

from tablework.sources.files import (load_csv_split, load_table, load_tables, register_view,
                                     run_sql, save_table, source_kind)

__all__ = ["load_csv_split", "load_table", "load_tables", "register_view", "run_sql",
           "save_table", "source_kind"]
