"""A current table of the newest row per key, in hash buckets of the key.

A bucket is a stack of layers, newest last: a batch adds one layer of its own rows to the buckets that its
keys fall in. Where the later layers of a bucket hold ``GROWTH`` times the rows of its first one, the bucket
is rewritten as one layer. So a batch writes its own rows and, spread over batches, a fixed multiple of
them; buckets that it does not touch are neither read nor written, however large the table is.

A version is a small file that names the layers of every bucket. It counts once its write is complete, so
readers see the version before until then and never a part of a batch. A batch that is run again starts
from the versions before its own number and replaces what it wrote. Layers that the last two versions do
not name are removed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
GROWTH = 1.0
_BUCKET, _LAYER = "_tw_bucket", "_tw_layer"


class CurrentTable:
    """The current table under ``path``.

    ``keys`` are needed to write; ``bucket_by`` (all keys by default) names those that choose the bucket.
    ``live`` is a condition on a key's newest row: rows that do not hold are gone for readers, and leave the files
    when their bucket is rewritten.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str] = (), bucket_by: Sequence[str] | None = None,
        live: str = "true", buckets: int = BUCKETS,
    ) -> None:
        self.spark, self.path = spark, path
        self.plan = {"keys": list(keys), "bucket_by": list(bucket_by or keys), "live": live, "buckets": buckets, "layers": {}}

    # --- versions ---------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        files, where = self._fs(path)
        return [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the complete versions, rising."""
        numbers = [int(n.removeprefix("version-")) for n in self._names(self.path) if n.startswith("version-")]
        return sorted(n for n in numbers if "_SUCCESS" in self._names(f"{self.path}/version-{n}"))

    def _load(self, before: int | None) -> dict | None:
        found = [v for v in self.versions() if before is None or v < before]
        return json.loads(self.spark.read.text(f"{self.path}/version-{found[-1]}").first()[0]) if found else None

    # --- reading ----------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.plan["bucket_by"]), F.lit(self.plan["buckets"])).cast("int")

    def read(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Newest row of every key: of the last version, or of the last one below ``before``, of all or some
        buckets. None where there is no version yet."""
        plan = self._load(before)
        return None if plan is None else self._rows(plan, buckets).where(plan["live"])

    def _layer(self, name: str) -> str:
        return f"{self.path}/data/{_LAYER}={name}"

    def _rows(self, plan: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(plan["schema"])
        layers = {b: names for b, names in plan["layers"].items() if buckets is None or int(b) in buckets}
        full = StructType.fromJson(plan["schema"]).add(_LAYER, "string").add(_BUCKET, "integer")

        def files(wanted: dict) -> DataFrame:
            paths = [f"{self._layer(name)}/{_BUCKET}={b}" for b, names in wanted.items() for name, _ in names]
            return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)

        single = {b: names for b, names in layers.items() if len(names) == 1}
        stacked = {b: names for b, names in layers.items() if len(names) > 1}
        parts = [files(single).select(*schema.names)] if single else []
        if stacked:
            newest = files(stacked).groupBy(*plan["keys"]).agg(F.max_by(F.struct(*schema.names), _LAYER).alias("_r"))
            parts.append(newest.select("_r.*"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    # --- writing ----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, layer: str) -> dict[int, int]:
        """Write a layer; rows of each of its buckets."""
        placed = rows.withColumn(_BUCKET, self.bucket())
        placed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(self._layer(layer))
        if not any(name.startswith(_BUCKET) for name in self._names(self._layer(layer))):
            return {}
        counts = self.spark.read.parquet(self._layer(layer)).groupBy(_BUCKET).count()
        # At most one row per bucket.
        return {row[0]: row[1] for row in counts.collect()}

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` fall in."""
        return [row[0] for row in rows.select(self.bucket().alias("b")).distinct().collect()]

    def merge(self, number: int, rows: DataFrame) -> None:
        """Version ``number``: the rows of ``rows``, one per key, replace those of their keys."""
        plan = self._load(number)
        plan = dict(self.plan, schema=rows.schema.jsonValue()) if plan is None else plan
        added = self._write(rows.select(*[f["name"] for f in plan["schema"]["fields"]]), f"b{number:012d}-0")
        full = []
        for bucket, n in sorted(added.items()):
            stack = plan["layers"].setdefault(str(bucket), [])
            stack.append([f"b{number:012d}-0", n])
            if len(stack) > 1 and sum(size for _, size in stack[1:]) >= GROWTH * stack[0][1]:
                full.append(bucket)
        if full:
            whole = self._write(self._rows(plan, full).where(plan["live"]), f"b{number:012d}-1")
            for bucket in full:
                plan["layers"][str(bucket)] = [[f"b{number:012d}-1", whole[bucket]]] if bucket in whole else []
        line = self.spark.createDataFrame([(json.dumps(plan),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/version-{number}")
        self._clean()

    def _clean(self) -> None:
        kept = self.versions()[-2:]
        plans = [json.loads(self.spark.read.text(f"{self.path}/version-{v}").first()[0]) for v in kept]
        named = {name for plan in plans for stack in plan["layers"].values() for name, _ in stack}
        stale = [f"{self.path}/version-{v}" for v in self.versions() if v < kept[0]]
        stale += [f"{self.path}/data/{n}" for n in self._names(f"{self.path}/data") if n.startswith(_LAYER) and n.split("=")[1] not in named]
        for path in stale:
            files, where = self._fs(path)
            files.delete(where, True)
