from indicata.sources.parquet import load_obt, read_csv, read_parquet, with_row_order, write_csv  # noqa: F401
