"""Tables of keyed rows in a folder of immutable parts, with a manifest that says which parts count.

A part is a folder of Parquet files, written whole before a new manifest names it. Manifests are numbered files
that are created once, never changed; the highest whole one holds. So readers see the parts of one manifest, all or
none of a write, and of two writers that meet one takes the next number.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: The write that a row comes from; later ones have greater numbers.
ORDER = "_write"


@dataclass(frozen=True)
class Files:
    """A folder on any file system that Spark can reach."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def names(self, name: str = "") -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether a new file of this name was written; False if there was one already."""
        fs, path = self._at(name)
        try:
            stream = fs.create(path, False)
        except Exception as e:  # the JVM's FileAlreadyExistsException and its kin
            if fs.exists(path):
                return False
            raise e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)


class KeyedTable:
    """Rows of `schema` at `path`; of the rows with equal `keys` the one written last counts, without keys all do."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.files = Files(spark, self.path)

    def _manifest(self, back: int = 0) -> tuple[int, dict]:
        """(number, content) of the latest whole manifest, or of an earlier one."""
        for name in reversed(self.files.names("manifest")):
            try:
                found = json.loads(self.files.read(f"manifest/{name}"))
            except ValueError:  # its writer has not finished, or died
                continue
            if back == 0:
                return int(name.split(".")[0]), found
            back -= 1
        return 0, {"parts": [], "writes": 0, "tag": None}

    def _publish(self, change) -> dict:
        """The manifest made by `change` from the latest one, again if another writer was first. A number whose
        file isn't whole is passed over."""
        _, held = self._manifest()
        names = self.files.names("manifest")
        number = int(names[-1].split(".")[0]) if names else 0
        while True:
            number += 1
            new = change(held)
            if self.files.create(f"manifest/{number:020d}.json", json.dumps(new)):
                return new
            _, held = self._manifest()

    def upsert(self, rows: DataFrame, tag: str | None = None) -> bool:
        """Write rows as the latest; False if the last tagged write had the same tag (a repeated micro-batch)."""
        if tag is not None and self._manifest()[1]["tag"] == tag:
            return False
        part = f"part-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).write.parquet(f"{self.path}/parts/{part}")
        self._publish(lambda m: {"parts": [*m["parts"], [part, m["writes"] + 1]], "writes": m["writes"] + 1, "tag": tag or m["tag"]})
        return True

    def _entries(self, manifest: dict) -> DataFrame:
        """All rows of a manifest with their writes; parts made by `compact` carry the writes of their rows."""
        parts: dict[str, int | None] = dict(manifest["parts"])
        ordered = StructType([*self.schema.fields, StructField(ORDER, LongType())])
        found = self.spark.createDataFrame([], ordered)
        plain = {p: n for p, n in parts.items() if n is not None}
        if plain:
            # the part's folder says which write it is: one scan for all parts
            numbers = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
            folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(part-[0-9a-f]+)/[^/]*$", 1)
            read = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/parts/{p}" for p in plain])
            found = found.unionByName(read.withColumn(ORDER, numbers[folder].cast("long")))
        for p in parts.keys() - plain.keys():
            found = found.unionByName(self.spark.read.schema(ordered).parquet(f"{self.path}/parts/{p}"))
        return found

    def entries(self) -> DataFrame:
        """All rows that are stored, replaced ones as long as they aren't compacted."""
        return self._entries(self._manifest()[1])

    def read(self, valid: Column | None = None, owners: DataFrame | None = None) -> DataFrame:
        """The rows that count. Rows that aren't `valid`, or agree with no row of `owners` in the columns they
        share, don't, and so replace nothing."""
        return self._latest(self.entries(), valid, owners).drop(ORDER)

    def _latest(self, entries: DataFrame, valid: Column | None = None, owners: DataFrame | None = None) -> DataFrame:
        names = self.schema.names
        if valid is not None:
            entries = entries.filter(F.coalesce(valid, F.lit(False)))
        if owners is not None:
            shared = [c for c in owners.columns if c in names]
            entries = entries.join(owners.select(*shared).distinct(), shared, "left_semi")
        if not self.keys:
            return entries
        rest = F.struct(ORDER, F.to_json(F.struct(*names)))  # of equal keys in one write the greatest row
        return entries.groupBy(*self.keys).agg(F.max_by(F.struct(*names, ORDER), rest).alias("_row")).select("_row.*")

    def compact(self, valid: Column | None = None) -> None:
        """Write what counts as one part and let it take the place of the parts it was made from."""
        _, seen = self._manifest()
        part = f"part-{uuid.uuid4().hex}"
        self._latest(self._entries(seen), valid).write.parquet(f"{self.path}/parts/{part}")
        old = {p for p, _ in seen["parts"]}
        self._publish(lambda m: m | {"parts": [[part, None], *[x for x in m["parts"] if x[0] not in old]]})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the parts that neither the latest manifest nor the `keep` before it name, and older manifests;
        readers of those manifests, and writers at work, must have ended. Returns the names of deleted parts."""
        wanted: set[str] = set()
        oldest = 0
        for back in range(keep + 1):
            number, m = self._manifest(back)
            wanted |= {p for p, _ in m["parts"]}
            oldest = number or oldest
        gone = [p for p in self.files.names("parts") if p not in wanted]
        for p in gone:
            self.files.delete(f"parts/{p}")
        for name in self.files.names("manifest"):
            if int(name.split(".")[0]) < oldest:
                self.files.delete(f"manifest/{name}")
        return gone

    def parts(self) -> int:
        return len(self._manifest()[1]["parts"])
