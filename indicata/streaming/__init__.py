"""Incremental form of the row-count profile (the original work is batch only).

``datamap_stream`` keeps the C2 counts up to date while new Parquet parts
of the observation table land in a folder.
"""

from indicata.streaming.datamap_stream import datamap_stream, read_obt_stream  # noqa: F401
