"""Tables of immutable files whose versions are published by one rename (on a local file system by one hard link).

A table is a folder with `data` (a folder for each commit), `keys` (the keys whose earlier rows a commit replaces) and `manifests`. Manifest number v lists the commits
that make up version v. A commit writes its files first, then its manifest under another name, and renames it to the next number; if somebody else has taken that
number, the commit is put on top of theirs and the rename is tried again. So a reader, who goes by the highest number, sees all of a commit or nothing of it. Files that
a version names stay until `vacuum`.

A row is in a version if no later commit of it replaces its key. A replaced key without new rows is gone.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import small

#: How often a commit is tried when others take its number.
TRIES = 20


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, place = _fs(spark, f"{path}/manifests")
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    text = spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> bool:
    """Whether the manifest became this version; not if there is one."""
    fs, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    jvm = spark._jvm
    _, draft = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{version:012d}.json")
    if fs.getUri().getScheme() == "file":  # there a rename looks first, and then moves the file and its checksum one after the other
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(draft, target, none)  # fails where the target exists
        return True
    except Exception as e:  # noqa: BLE001  of the JVM
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise


def _schema(manifest: dict) -> T.StructType:
    return T.StructType.fromJson(manifest["schema"])


def commit(rows: DataFrame, path: str, key: str, keys: DataFrame | None = None, batch: str | None = None) -> int:
    """Adds rows to the table, in place of all rows of the keys (a table with the column `key`; none: nothing is replaced). Gives the number of the new version, or of the
    one that there is if it has the batch already: a name that the caller gives to what must not be added twice. Columns that the table doesn't have
    yet are added to it."""
    spark = rows.sparkSession
    found = _versions(spark, path)
    if batch and found and batch in _manifest(spark, path, found[-1])["batches"]:
        return found[-1]
    name = uuid.uuid4().hex
    plain = [f"`{f.name}`" for f in rows.schema if not isinstance(f.dataType, T.MapType)]
    # a key with many rows is dealt to several files, each with a range of keys
    rows.repartitionByRange(F.col(key), F.xxhash64(*plain)).sortWithinPartitions(key).write.option("compression", "zstd").parquet(f"{path}/data/{name}")
    if keys is not None:
        keys.select(key).distinct().write.parquet(f"{path}/keys/{name}")
    for _ in range(TRIES):
        found = _versions(spark, path)
        last = _manifest(spark, path, found[-1]) if found else {"commits": [], "batches": [], "schema": None, "key": key}
        if batch and batch in last["batches"]:
            return found[-1]
        known = T.StructType([]) if last["schema"] is None else _schema(last)
        whole = T.StructType([*known.fields, *[T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in known.names]])
        mine = {"name": name, "replaces": keys is not None}
        new = {"commits": [*last["commits"], mine], "batches": [*last["batches"], *([batch] if batch else [])][-1000:], "schema": whole.jsonValue(), "key": key}
        version = (found[-1] if found else 0) + 1
        if _publish(spark, path, version, new):
            return version
    raise RuntimeError(f"{path}: no version could be published in {TRIES} tries")


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the last one."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no version")
    m = _manifest(spark, path, found[-1] if version is None else version)
    schema, key, commits = _schema(m), m["key"], m["commits"]
    last = max((i for i, c in enumerate(commits) if c["replaces"]), default=0)
    data = lambda some: spark.read.schema(schema).parquet(*[f"{path}/data/{c['name']}" for c in some])
    out = data(commits[last:])  # nothing later replaces these
    for i, c in enumerate(commits[:last]):
        later = [f"{path}/keys/{x['name']}" for x in commits[i + 1 : last + 1] if x["replaces"]]
        gone = small(spark.read.schema(T.StructType([schema[key]])).parquet(*later).distinct().withColumnRenamed(key, "_gone"))
        out = out.unionByName(data([c]).join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti"))
    return out


def compact(spark: SparkSession, path: str) -> int:
    """A version with the same rows in one commit, so that reading it needs no join. It is published only if no other has come in between."""
    version = _versions(spark, path)[-1]
    m = _manifest(spark, path, version)
    if len(m["commits"]) == 1:
        return version
    name = uuid.uuid4().hex
    rows = read_snapshot(spark, path, version)
    rows.repartitionByRange(F.col(m["key"]), F.xxhash64(*[f"`{f.name}`" for f in rows.schema if not isinstance(f.dataType, T.MapType)])).sortWithinPartitions(m["key"]).write.option("compression", "zstd").parquet(f"{path}/data/{name}")
    return version + 1 if _publish(spark, path, version + 1, m | {"commits": [{"name": name, "replaces": False}]}) else version


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes all but the last `keep` versions, and the files that these don't name. Nobody may be reading or writing an older one."""
    found = _versions(spark, path)
    named = {c["name"] for v in found[-keep:] for c in _manifest(spark, path, v)["commits"]}
    fs, _ = _fs(spark, path)
    for v in found[:-keep]:
        fs.delete(_fs(spark, f"{path}/manifests/{v:012d}.json")[1], False)
    for part in ("data", "keys"):
        place = _fs(spark, f"{path}/{part}")[1]
        for f in fs.listStatus(place) if fs.exists(place) else []:
            if f.getPath().getName() not in named:
                fs.delete(f.getPath(), True)
