"""A versioned store of the engine's tables.

All tables of a save are written to a new folder, then one small file is replaced to point there. Readers see the old
state or the new one, never a mixture, and a lost executor only repeats tasks of the write. Files are handled by Hadoop's
file systems, so a store may lie wherever Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.model import SCHEMA_VERSION, TABLES

CURRENT = "_CURRENT"


class Files:
    """The few operations on files that a store needs, below one path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        fs = self._jvm.org.apache.hadoop.fs
        self._base = fs.Path(base)
        self._fs = self._base.getFileSystem(self._conf)
        self._base = self._fs.makeQualified(self._base)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._base, name)

    def read(self, name: str) -> str | None:
        """The text of a file, None if there is none."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file anew; readers see the old text or the new one."""
        fs = self._jvm.org.apache.hadoop.fs
        temporary = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(text.encode())
        stream.close()
        rename = getattr(fs, "Options$Rename")
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(self._base.toUri(), self._conf).rename(temporary, self._at(name), how)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._base)] if self._fs.exists(self._base) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Store:
    """Tables below ``path``; a store of another schema version reads as empty, as everything in it can be built again."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep, self.files = spark, path.rstrip("/"), keep, Files(spark, path)

    def _pointer(self) -> dict | None:
        try:
            return json.loads(self.files.read(CURRENT) or "null")
        except ValueError:
            return None

    def version(self) -> str | None:
        p = self._pointer()
        return p["schema"] if p else None

    def read(self, name: str) -> DataFrame:
        p = self._pointer()
        if not p or p["schema"] != SCHEMA_VERSION or name not in p["tables"]:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{p['tables'][name]}")

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("graph_meta").collect()}

    def save(self, **tables: DataFrame) -> None:
        """Replace the named tables at once; the others stay."""
        p = self._pointer()
        kept = dict(p["tables"]) if p and p["schema"] == SCHEMA_VERSION else {}
        version = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            self._shaped(df, name).write.parquet(f"{self.path}/{version}/{name}")
            kept[name] = f"{version}/{name}"
        self.files.replace(CURRENT, json.dumps({"schema": SCHEMA_VERSION, "tables": kept}))
        used = {x.split("/")[0] for x in kept.values()}
        old = sorted(x for x in self.files.names() if x.startswith("v") and x not in used)
        for x in old[: -self.keep or None]:
            self.files.delete(x)

    def _shaped(self, df: DataFrame, name: str) -> DataFrame:
        fields = self.spark.createDataFrame([], TABLES[name]).schema.fields
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def delete_all(self) -> None:
        self.save(**{t: self.spark.createDataFrame([], s) for t, s in TABLES.items()})

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those with the same keys; a key that is null or empty is an error."""
        if not rows.where(" or ".join(f"{k} is null or {k} = ''" for k in keys)).isEmpty():
            raise ValueError(f"{name}: empty key")
        rows = self._shaped(rows, name)
        self.save(**{name: self.read(name).join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)})

    def insert_new(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows whose keys are not there yet; of equals among them one."""
        old = self.read(name)
        once = self._shaped(rows, name).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).where("_n = 1").drop("_n")
        self.save(**{name: old.unionByName(once.join(old.select(*keys), keys, "left_anti"))})

    def delete(self, name: str, key: str, values: list[str]) -> None:
        """Rows with these keys go; keys that aren't there are no error."""
        gone = self.spark.createDataFrame([(v,) for v in values], f"{key} string")
        self.save(**{name: self.read(name).join(gone, key, "left_anti")})

    def set_meta(self, **values: str) -> None:
        self.upsert("graph_meta", self.spark.createDataFrame(list(values.items()), TABLES["graph_meta"]), ["key"])
