"""Ranked lists as files that a service can answer from without Spark: a request reads one row group.

A list is one row. Rows lie in order of a digest of the customer and the customer itself, in files of disjoint ranges
and small row groups, so customers spread evenly and each has one place. A reader keeps the least and the greatest
place of every row group, read once from the files' footers.
"""

from __future__ import annotations

import bisect
import zlib
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a row group, about, and customers of a file.
GROUP_BYTES = 1 << 20
FILE_ROWS = 1_000_000


def place_of(customer: str) -> str:
    return f"{zlib.crc32(customer.encode()):08x}:{customer}"


def write_lookup(ranked: DataFrame, path: str, customer: str = "customer", group_bytes: int = GROUP_BYTES, file_rows: int = FILE_ROWS) -> None:
    """Write (customer, rank, item, score) for `LookupTable`; a list has to fit into a row, so lists are cut to some length before."""
    key = F.col(customer).cast("string")
    lists = ranked.where(key.isNotNull()).groupBy(key.alias("customer")).agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("items"))
    rows = lists.select(F.concat(F.lpad(F.lower(F.hex(F.crc32(F.col("customer").cast("binary")))), 8, "0"), F.lit(":"), "customer").alias("place"), "items")
    files = max(1, -(-lists.count() // file_rows))
    rows.repartitionByRange(files, "place").sortWithinPartitions("place").write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


class LookupTable:
    """Answers `recommend(customer, k)` from the files in a folder; `reads` counts the row groups that were read."""

    def __init__(self, path: str):
        self.reads = 0
        if not (Path(path) / "_SUCCESS").exists():
            raise FileNotFoundError(f"{path} isn't a table that was written to its end")
        self.groups = []
        for file in sorted(Path(path).glob("part-*.parquet")):
            footer = pq.read_metadata(file)
            for group in range(footer.num_row_groups):
                places = footer.row_group(group).column(0).statistics
                if places is not None and places.has_min_max:
                    self.groups.append((places.min, places.max, str(file), group))
        self.groups.sort()
        self.least = [g[0] for g in self.groups]

    def recommend(self, customer: str, k: int = 10) -> list[tuple[str, float]]:
        place = place_of(str(customer))
        at = bisect.bisect_right(self.least, place) - 1
        if at < 0 or place > self.groups[at][1]:
            raise KeyError(customer)
        self.reads += 1
        found = pq.ParquetFile(self.groups[at][2]).read_row_group(self.groups[at][3])
        places = found.column("place").to_pylist()
        row = bisect.bisect_left(places, place)
        if row == len(places) or places[row] != place:
            raise KeyError(customer)
        return [(x["item"], x["score"]) for x in found.column("items")[row].as_py()[:k]]
