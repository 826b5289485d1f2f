"""Files in the shared folder, written and read on executors through pyarrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Folders of a table that is read by input partition; a folder holds the partitions of one remainder, in order.
PART_FOLDERS = 1024


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def by_part(df: DataFrame, name: str) -> str:
    """Store a table with a column ``part`` so that ``read_part`` reads one part; the number of folders is bounded."""
    folder = fresh_path(df.sparkSession, name)
    dealt = df.withColumn("folder", F.col("part") % PART_FOLDERS).repartition("folder").sortWithinPartitions("folder", "part")
    # small row groups: a reader skips those of other parts
    dealt.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).partitionBy("folder").parquet(folder)
    return folder


def read_part(folder: str, part: int, columns: list[str], **equal: int) -> pa.Table | None:
    """The rows of one part of a table written by ``by_part`` (with some columns equal to given values); None if there are none."""
    fs, top = open_fs(f"{folder}/folder={part % PART_FOLDERS}")
    if fs.get_file_info(top).type == pafs.FileType.NotFound:
        return None
    which = pc.field("part") == part
    for column, value in equal.items():
        which &= pc.field(column) == value
    found = pads.dataset(top, filesystem=fs, format="parquet").to_table(columns=columns, filter=which)
    return found if found.num_rows else None
