"""Stored states: fitted models and feature tables that are either whole and current, or not there.

A model state is a folder with tables, Spark ML models and a manifest (kind, version, parameters, schemas and the
fingerprint of the training keys). It is built beside its place and renamed to it as the last step, so a reader sees the
old state or the new one. A feature store grows by parts: only keys that no committed part has are built, and a part
counts once its manifest is renamed into place.
"""
import json
import uuid

from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1


class StaleState(ValueError):
    """A stored state that was made from other keys, by other settings or by another version."""


class _Files:
    def __init__(self, spark, path):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(path).getFileSystem(self.conf)

    def at(self, path):
        return self.hadoop.Path(path)

    def exists(self, path):
        return self.fs.exists(self.at(path))

    def names(self, path):
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(path))) if self.exists(path) else []

    def write(self, path, text):
        stream = self.fs.create(self.at(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def read(self, spark, path):
        return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())

    def move(self, source, target):
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"could not publish {target}")

    def delete(self, path):
        self.fs.delete(self.at(path), True)


def fingerprint(keys: DataFrame, *cols) -> str:
    """Number and order-free sums of hashes of the keys: equal for equal multisets of rows, whatever their order."""
    cols = [F.col(c) for c in (cols or keys.columns)]
    row = keys.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.xxhash64(F.lit(i), *cols).cast("decimal(38,0)")), F.lit(0)).alias(f"h{i}")
                                                  for i in range(2)]).first()
    return ":".join(str(int(x)) for x in row)


def save_state(spark: SparkSession, path, kind, parameters=None, tables=None, models=None, keys=""):
    """Publish a state at ``path``, replacing an older one.

    ``tables``: name to DataFrame; ``models``: name to a Spark ML model; ``keys``: :func:`fingerprint` of the training keys.
    """
    files, tables, models = _Files(spark, path), tables or {}, models or {}
    path = path.rstrip("/")
    made = f"{path}.new-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{made}/tables/{name}")
    for name, model in models.items():
        model.write().save(f"{made}/models/{name}")
    manifest = {"kind": kind, "version": VERSION, "keys": keys, "parameters": parameters or {},
                "tables": {n: t.schema.jsonValue() for n, t in tables.items()},
                "models": {n: f"{type(m).__module__}.{type(m).__name__}" for n, m in models.items()}}
    files.write(f"{made}/manifest.json", json.dumps(manifest, sort_keys=True))
    old = f"{path}.old-{uuid.uuid4().hex}"
    if files.exists(path):
        files.move(path, old)
    files.move(made, path)
    files.delete(old)


class State:
    """A published state: its parameters, and its tables and models by name."""

    def __init__(self, spark, path, manifest):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.parameters, self.keys = manifest["parameters"], manifest["keys"]

    def table(self, name) -> DataFrame:
        schema = T.StructType.fromJson(self.manifest["tables"][name])
        stored = self.spark.read.parquet(f"{self.path}/tables/{name}")
        if [(f.name, f.dataType) for f in stored.schema] != [(f.name, f.dataType) for f in schema]:
            raise StaleState(f"table {name} is not the one that was published: {self.path}")
        return stored

    def model(self, name):
        import importlib
        module, _, cls = self.manifest["models"][name].rpartition(".")
        if not module.startswith("pyspark.ml."):
            raise StaleState(f"not a Spark ML model: {module}.{cls}")
        kind = getattr(importlib.import_module(module), cls)
        if not issubclass(kind, MLReadable):
            raise StaleState(f"not a readable model: {module}.{cls}")
        return kind.load(f"{self.path}/models/{name}")


def load_state(spark: SparkSession, path, kind, keys=None) -> State:
    """The state at ``path``; an error if it is another kind or version, or was trained on other keys than ``keys`` says."""
    files, path = _Files(spark, path), path.rstrip("/")
    if not files.exists(f"{path}/manifest.json"):
        raise FileNotFoundError(f"no state: {path}")
    manifest = json.loads(files.read(spark, f"{path}/manifest.json"))
    if manifest["version"] != VERSION or manifest["kind"] != kind:
        raise StaleState(f"{manifest['kind']} of version {manifest['version']} where {kind} of version {VERSION} is wanted: {path}")
    if keys is not None and keys != manifest["keys"]:
        raise StaleState(f"trained on other keys: {path}")
    return State(spark, path, manifest)


class FeatureStore:
    """Features by key in parts that are added as the keys grow.

    ``settings`` describes how features are made; a store that was made otherwise is refused.
    """

    def __init__(self, spark: SparkSession, path, key, settings=""):
        self.spark, self.path, self.key, self.settings = spark, path.rstrip("/"), key, settings
        self.files = _Files(spark, path)

    def parts(self):
        """Manifests of the committed parts, oldest first."""
        found = []
        for name in self.files.names(f"{self.path}/manifests"):
            if name.endswith(".json"):
                found.append(json.loads(self.files.read(self.spark, f"{self.path}/manifests/{name}")))
        for part in found:
            if part["settings"] != self.settings or part["version"] != VERSION:
                raise StaleState(f"features were made with other settings: {self.path}")
        return found

    def read(self) -> DataFrame | None:
        """All committed rows with the number of their ``part``; None for an empty store."""
        rows = None
        for part in self.parts():
            some = (self.spark.read.schema(T.StructType.fromJson(part["schema"])).parquet(f"{self.path}/{part['folder']}")
                    .withColumn("part", F.lit(part["number"])))
            rows = some if rows is None else rows.unionByName(some)
        return rows

    def extend(self, keys: DataFrame, build) -> DataFrame:
        """Features of all ``keys`` (distinct, without null), of which only the missing ones are built.

        ``build`` maps a table of keys to a table with the key and its features. A part that lacks a key it was built
        for is refused before it is committed; one whose run was cut off is never seen.
        """
        stored, number = self.read(), len(self.parts())
        missing = keys if stored is None else keys.join(stored.select(self.key), self.key, "left_anti")
        if not missing.isEmpty():
            folder = f"part-{number}-{uuid.uuid4().hex}"
            made = build(missing)
            made.write.parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(made.schema).parquet(f"{self.path}/{folder}")
            if fingerprint(written, self.key) != fingerprint(missing, self.key):
                self.files.delete(f"{self.path}/{folder}")
                raise ValueError(f"the new part does not hold exactly the missing keys: {self.path}")
            manifest = {"number": number, "folder": folder, "settings": self.settings, "version": VERSION, "schema": made.schema.jsonValue()}
            self.files.write(f"{self.path}/{folder}.json.new", json.dumps(manifest))
            self.files.fs.mkdirs(self.files.at(f"{self.path}/manifests"))
            self.files.move(f"{self.path}/{folder}.json.new", f"{self.path}/manifests/{number:09d}.json")
        return self.read().join(keys.select(self.key), self.key, "left_semi") if number or not missing.isEmpty() else build(keys).withColumn("part", F.lit(0))
