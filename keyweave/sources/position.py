"""Row numbers that hold for every reading of a table: by file, and by place in the file.

A number that Spark counts up while it reads belongs to that reading: another number of partitions, or
a task that runs again on other splits, gives other numbers.  What a Parquet file says of its rows, its
path and their place in it, doesn't change with that.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places in a file are below 2**40; files are numbered by path above that.
PLACE_BITS = 40
_FILE, _PLACE = "__position_file", "__position_place"


def has_positions(df: DataFrame) -> bool:
    """Whether the rows of ``df`` come from one Parquet source and can still be told by their place there."""
    plan = df._jdf.queryExecution().analyzed()
    hidden = plan.metadataOutput()
    told = any("row_index" in hidden.apply(i).dataType().catalogString() for i in range(hidden.size()))
    return told and plan.collectLeaves().size() == 1 and "_metadata" not in df.columns


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name``: the row's number in its file from 1, and that of the file, in order of paths, above it.

    Tables of one file have the plain numbers of their rows.  ``df`` must have positions: it is read from
    Parquet, and selections, filters and repartitions alone are between; rows that a join makes of one
    share its number.
    """
    files = sorted(re.sub("^file:/+", "file:/", x) for x in df.inputFiles())
    path = F.col("_metadata.file_path")
    path = F.when(path.startswith("file:/"), F.concat(F.lit("file:/"), F.ltrim(F.substring(path, 7, 1 << 30), F.lit("/")))).otherwise(path)
    rows = df.select("*", path.alias(_FILE), (F.col("_metadata.row_index") + 1).alias(_PLACE))
    if len(files) > 1:
        # Spark doesn't know how small a local list is: unasked, it would shuffle and sort the rows by file, a whole file in one task
        numbers = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(files)), f"{name} long, {_FILE} string"))
        rows = rows.join(numbers, _FILE).withColumn(name, F.shiftleft(name, PLACE_BITS) + F.col(_PLACE))
    else:
        rows = rows.withColumn(name, F.col(_PLACE))
    return rows.select(*df.columns, name)

