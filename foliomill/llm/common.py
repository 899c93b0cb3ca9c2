"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import io
import json
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Resolution of the hash buckets by which bounded samples are drawn.
SAMPLE_BUCKETS = 1_000_003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    The lineage ends there, so several readers share one computation and a lost
    executor costs no recomputation. The folder is the one named in
    ``spark.checkpoint.dir``; without one this raises, as a folder of one machine
    would lose blocks on a cluster.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # a local master is one process on this machine, which shares any folder with itself
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliomill-"))
    return df.checkpoint(eager=True)


def pack(facts: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """A model as bytes: facts as JSON beside its arrays."""
    out = io.BytesIO()
    np.savez_compressed(out, **arrays, _facts=np.frombuffer(json.dumps(facts).encode(), np.uint8))
    return out.getvalue()


def unpack(payload: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    with np.load(io.BytesIO(payload)) as got:
        return json.loads(got["_facts"].tobytes()), {k: got[k] for k in got.files if k != "_facts"}


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Write a fitted model to a table of one row, on any file system Spark knows."""
    spark.createDataFrame([(bytearray(model.save()),)], "model binary").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, kind: Any, path: str) -> Any:
    """Read a model written by ``save_model``; ``kind`` is its class."""
    return kind.load(bytes(spark.read.parquet(path).first()["model"]))


_FITTED: dict[tuple, Any] = {}


def shared_model(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], fit: Callable[[], Any]) -> Any:
    """The model that ``fit`` gives for these tables, fitted once per session.

    The queries of one problem share it as long as the tables' files (names, sizes and
    times of change) stay the same."""
    files = None
    for t in tables:
        got = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{sf_dir}/{t}.parquet")
        files = got if files is None else files.unionByName(got)
    state = files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    key = (spark.sparkContext.applicationId, name, tables, state["h"], state["n"])
    if key not in _FITTED:
        _FITTED.clear() if len(_FITTED) > 16 else None
        _FITTED[key] = fit()
    return _FITTED[key]


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply a Python function to Arrow batches of ``df``.

    ``make`` runs once per task and returns the function, so tables and models
    are built once per task; the function gets the batch's columns as lists and
    returns the columns of ``schema`` as lists of any, equal, length.
    """
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            fn = fn or make()
            got = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            arrays = [pa.array(got[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)


def bounded_sample(df: DataFrame, key: str, stratum: Column, per_stratum: int, columns: list[str]) -> list:
    """About ``per_stratum`` rows of each stratum, chosen by a hash of ``key``.

    A first pass counts the strata (reading only the columns of the stratum), a
    second one keeps the rows whose hash bucket lies under the stratum's share, about
    1.15 times ``per_stratum``. Never more than twice ``per_stratum`` times the number of strata
    reach the driver, even where many rows share a key: those of least hash. Rows whose
    stratum is null are left out. The choice depends only on the rows, not on partitions
    or order.
    """
    keyed = df.withColumn("_s", stratum.cast("string")).where("_s IS NOT NULL")
    counts = {r["_s"]: r["count"] for r in keyed.groupBy("_s").count().collect()}
    if not counts:
        return []
    share = {s: min(1.0, 1.15 * per_stratum / n) if n > per_stratum else 1.0 for s, n in counts.items()}
    limit = F.create_map(*[x for s, v in share.items() for x in (F.lit(s), F.lit(int(v * SAMPLE_BUCKETS) + 1))])
    kept = keyed.withColumn("_h", F.xxhash64(key, F.lit(17))).where(F.pmod("_h", F.lit(SAMPLE_BUCKETS)) < F.try_element_at(limit, F.col("_s")))
    rows = kept.orderBy("_h", F.xxhash64(*columns)).select("_s", *columns).limit(2 * per_stratum * len(counts)).collect()
    return sorted(rows, key=lambda r: (r["_s"], str(r[key]) if key in columns else ""))
