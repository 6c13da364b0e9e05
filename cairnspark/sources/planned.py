"""Tables of data source readers, planned in the driver's own process."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceReader
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 10_000


def table(spark: SparkSession, reader: DataSourceReader, schema: str) -> DataFrame:
    """What a reader gives, each of its partitions in a task of its own.

    ``spark.read.format`` plans in processes beside the driver, a daemon and a worker for each kind of step, which
    live on, and which each would open an archive anew.
    """
    parts = reader.partitions()
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows = iter(reader.read(parts[k]))
                while some := [*islice(rows, BATCH)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, schema)
