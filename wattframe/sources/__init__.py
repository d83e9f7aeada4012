"""Sources, sinks and catalog: declared-schema CSV / JSON / Parquet scans and writes, temp views, SQL."""

from wattframe.sources.files import (load_model, read_csv, read_json, read_parquet, read_table, register_views,
                                     run_sql, save_model, write_csv, write_json, write_parquet)

__all__ = ["load_model", "save_model", "read_csv", "read_json", "read_parquet", "read_table", "register_views", "run_sql",
           "write_csv", "write_json", "write_parquet"]
