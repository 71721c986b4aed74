"""Several tables of content that change together: versions, each committed by one small file.

A store holds the tables of a corpus (segments, chunks, vectors, postings), all with a key that names
the document. Every commit writes a *layer*: the new rows of each table, and the keys that it touches,
whose rows in earlier layers are hidden from then on. What a version consists of stands in one JSON
file, which comes into being by a rename that fails where the file is there already: so a commit is
seen as a whole or not at all, of two writers from one version the second gets ``Conflict``, and a
writer that dies leaves the old version as it was. Readers hold a version and go on reading its files.
Only the layers' new rows are ever written; ``compact`` makes one layer of all, ``clean`` deletes what no
version refers to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed since the version that this one began from."""


@dataclass(frozen=True)
class Snapshot:
    """A version: the layers, oldest first, and what the writer noted (sums, for example)."""

    store: Store
    version: int
    layers: tuple[str, ...]
    schemas: dict[str, str]
    notes: dict = field(default_factory=dict)

    @property
    def hidden(self) -> DataFrame:
        """(key, _since): keys that a later layer touched, and the last such layer."""
        spark, s = self.store.spark, self.store
        each = [spark.read.schema(f"{s.key} {s.key_type}").parquet(f"{s.path}/{layer}/_touched").select(s.key, F.lit(i).alias("_since")) for i, layer in enumerate(self.layers) if i]
        if not each:
            return spark.createDataFrame([], f"{s.key} {s.key_type}, _since int")
        return reduce(DataFrame.unionAll, each).groupBy(s.key).agg(F.max("_since").alias("_since"))

    def table(self, name: str, where=None) -> DataFrame:
        """The rows of a table; ``where`` is a condition that each layer's scan gets, partition columns included."""
        spark, s = self.store.spark, self.store
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        parts = []
        for i, layer in enumerate(self.layers):
            rows = spark.read.schema(schema).parquet(f"{s.path}/{layer}/{name}")
            parts.append((rows if where is None else rows.where(where)).select(*schema.names, F.lit(i).alias("_layer")))
        *older, newest = parts
        if not older:
            return newest.drop("_layer")
        # The touched keys are few between compactions; where they are not, both sides are dealt by key. No later layer hides the newest one's rows.
        rows = reduce(DataFrame.unionAll, older).join(self.hidden, s.key, "left")
        shown = rows.where(F.col("_since").isNull() | (F.col("_layer") >= F.col("_since")))
        return shown.select(*schema.names).unionAll(newest.select(*schema.names))


class Store:
    """The tables below ``path``; ``partitions`` names the columns by which a table's files are laid out."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", partitions: dict[str, list[str]] | None = None):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, partitions or {}

    # Files of Hadoop's file systems, so that any store that Spark writes will do.

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _names(self, path: str) -> list[tuple[str, int]]:
        p, fs, _ = self._fs(path)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _text(self, path: str) -> str:
        p, fs, jvm = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _publish(self, version: int, content: str) -> None:
        """The version's file appears whole, by a rename that does not replace."""
        at = f"{self.path}/_log/{version:012d}.json"
        draft = f"{self.path}/_log/.{uuid.uuid4().hex}"
        p, fs, jvm = self._fs(draft)
        out = fs.create(p, False)
        out.write(bytearray(content.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(p), context.makeQualified(self._fs(at)[0]), none)
        except Exception as e:
            fs.delete(p, False)
            if self._fs(at)[1].exists(self._fs(at)[0]):
                raise Conflict(f"version {version} is there already") from e
            raise

    # Reading

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self._names(f"{self.path}/_log") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one asked for."""
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise LookupError(f"no version {version if version is not None else ''} at {self.path}".replace("  ", " "))
        told = json.loads(self._text(f"{self.path}/_log/{found[-1] if version is None else version:012d}.json"))
        self.key_type = told["key_type"]
        return Snapshot(self, told["version"], tuple(told["layers"]), told["schemas"], told["notes"])

    # Writing

    def _write(self, layer: str, tables: dict[str, DataFrame], touched: DataFrame | None) -> None:
        for name, rows in tables.items():
            by = self.partitions.get(name)
            w = rows.write
            (w.partitionBy(*by) if by else w).parquet(f"{self.path}/{layer}/{name}")
        if touched is not None:
            touched.write.parquet(f"{self.path}/{layer}/_touched")

    def _commit(self, version: int, layers: list[str], schemas: dict[str, str], notes: dict) -> Snapshot:
        told = {"version": version, "layers": layers, "schemas": schemas, "notes": notes, "key_type": self.key_type}
        self._publish(version, json.dumps(told))
        return self.snapshot(version)

    def _drop(self, layer: str) -> None:
        p, fs, _ = self._fs(f"{self.path}/{layer}")
        fs.delete(p, True)

    def create(self, tables: dict[str, DataFrame], notes: Callable[[Callable[[str], DataFrame]], dict] | None = None) -> Snapshot:
        """The first version; ``notes`` may read the tables that were written."""
        layer = f"layer-{uuid.uuid4().hex}"
        self.key_type = next(iter(tables.values())).schema[self.key].dataType.simpleString()
        try:
            self._write(layer, tables, None)
            return self._commit(0, [layer], {n: t.schema.json() for n, t in tables.items()}, notes(lambda n: self.spark.read.schema(tables[n].schema).parquet(f"{self.path}/{layer}/{n}")) if notes else {})
        except Exception:
            self._drop(layer)
            raise

    def replace(self, ids: DataFrame, tables: dict[str, DataFrame], base: Snapshot | None = None, notes: dict | Callable[[Callable[[str], DataFrame]], dict] | None = None, within: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> Snapshot:
        """The next version: documents of ``ids`` have the rows in ``tables`` alone, none where it has none; the others keep theirs.

        Rows of documents outside ``ids`` are not taken. ``within`` makes further tables of the stored ids;
        they hold rows of these alone, and are written as they are laid out. ``notes`` may read the tables that
        were written. Raises ``Conflict``, and leaves nothing, if ``base`` (the newest version, unless told) is
        no longer the newest.
        """
        base = base or self.snapshot()
        if unknown := set(tables) - set(base.schemas):
            raise ValueError(f"no table {', '.join(sorted(unknown))}")
        layer = f"layer-{uuid.uuid4().hex}"
        touched = ids.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        schemas = {n: StructType.fromJson(json.loads(s)) for n, s in base.schemas.items()}
        try:
            self._write(layer, {}, touched)
            own = self.spark.read.schema(touched.schema).parquet(f"{self.path}/{layer}/_touched")
            rows = {n: tables[n].select(*s.names).join(own, self.key, "left_semi") if n in tables else self.spark.createDataFrame([], s) for n, s in schemas.items()}
            rows |= {n: t.select(*schemas[n].names) for n, t in (within(own) if within else {}).items()}
            self._write(layer, rows, None)
            told = notes(lambda n: self.spark.read.schema(schemas[n]).parquet(f"{self.path}/{layer}/{n}")) if callable(notes) else notes
            return self._commit(base.version + 1, [*base.layers, layer], base.schemas, base.notes if told is None else told)
        except Exception:
            self._drop(layer)
            raise

    def delete(self, ids: DataFrame, base: Snapshot | None = None, notes: dict | None = None) -> Snapshot:
        """The next version, without the documents of ``ids`` in any table."""
        return self.replace(ids, {}, base, notes)

    def compact(self, base: Snapshot | None = None, prepare: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Snapshot:
        """The next version, of the same rows in one layer; ``prepare`` deals out and sorts a table's rows."""
        base = base or self.snapshot()
        layer = f"layer-{uuid.uuid4().hex}"
        try:
            self._write(layer, {n: (prepare or {}).get(n, lambda t: t)(base.table(n)) for n in base.schemas}, None)
            return self._commit(base.version + 1, [layer], base.schemas, base.notes)
        except Exception:
            self._drop(layer)
            raise

    def clean(self, keep: int = 1, idle: float = 86_400.0, now: float | None = None) -> list[str]:
        """Deletes versions but the last ``keep``, and layers that no version left refers to and that were not written to for ``idle`` seconds: those of writers that died."""
        import time

        found = self.versions()
        for v in found[: -max(1, keep)]:
            p, fs, _ = self._fs(f"{self.path}/_log/{v:012d}.json")
            fs.delete(p, False)
        used = {layer for v in found[-max(1, keep) :] for layer in self.snapshot(v).layers}
        before = ((time.time() if now is None else now) - idle) * 1000
        gone = [n for n, at in self._names(self.path) if n.startswith("layer-") and n not in used and max([at, *(t for _, t in self._names(f"{self.path}/{n}"))]) <= before]
        for n in gone:
            self._drop(n)
        return gone
