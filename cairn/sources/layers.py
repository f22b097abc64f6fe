"""Stored layers: all features of a layer and workspace are replaced as a whole.

A layer has data of versions, each the rows of the workspaces that one replacement was about, and manifests: which version
holds each workspace.  The newest manifest counts, so readers never see half of a change; a replacement writes its own rows
and one manifest row a workspace, whatever else the layer holds.  Rows lie in order of workspaces, so that reading some of
them skips the rest.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, by Hadoop's file system, whatever the store; of no folder, none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _manifest(spark: SparkSession, path: str, layer: str) -> tuple[DataFrame | None, int]:
    """The newest manifest (workspace_id, version) and its number."""
    newest = max((int(n[2:]) for n in _names(spark, f"{path}/{layer}/manifest") if n.startswith("v=") and n[2:].isdigit()), default=0)
    return (spark.read.parquet(f"{path}/{layer}/manifest/v={newest}"), newest) if newest else (None, 0)


def read_layer(spark: SparkSession, path: str, layer: str, workspace_ids: list | None = None) -> DataFrame | None:
    """The newest state of a layer, of all or some workspaces; None if it was never written."""
    manifest, _ = _manifest(spark, path, layer)
    if manifest is None:
        return None
    some = F.lit(True) if workspace_ids is None else F.col("workspace_id").isin(workspace_ids)
    versions = lambda rows: sorted(r[0] for r in rows.select("version").distinct().collect())
    # where nothing is left, the schema is that of anything stored
    live = versions(manifest.where(some)) or versions(manifest) or [n[2:] for n in _names(spark, f"{path}/{layer}/data") if n.startswith("v=")][:1]
    parts = [spark.read.parquet(f"{path}/{layer}/data/v={v}").withColumn("version", F.lit(v)) for v in live]
    data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return data.where(some).join(manifest, ["workspace_id", "version"], "left_semi").drop("version")


def write_layer(rows: DataFrame, path: str, layer: str, workspaces: DataFrame, tries: int = 20) -> None:
    """Replaces a layer's rows of the workspaces (workspace_id) by rows; also by none. Rows of other workspaces are left out.

    Data lie in a folder of their own name, so writers never meet there.  A change counts from the moment at which its
    manifest takes the next number; the number is claimed before by a file that the store lets one writer make.  Others then
    take theirs up from that one, and try again, `tries` times at most.  So no writer's rows ever count as another's.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    keys = workspaces.select("workspace_id").where("workspace_id is not null").distinct()
    rows.join(keys, "workspace_id", "left_semi").repartitionByRange("workspace_id").sortWithinPartitions("workspace_id").write.parquet(f"{path}/{layer}/data/v={version}")
    for turn in range(tries):
        time.sleep(0.2 * min(turn, 10))
        manifest, newest = _manifest(spark, path, layer)
        now = keys.withColumn("version", F.lit(version))
        if manifest is not None:
            now = manifest.join(keys, "workspace_id", "left_anti").unionByName(now)
        draft = f"{path}/{layer}/drafts/{uuid.uuid4().hex}"
        now.write.parquet(draft)
        if _renamed(spark, draft, f"{path}/{layer}/manifest/v={newest + 1}"):
            return
    raise RuntimeError(f"{path}/{layer}: other writers were first {tries} times")


#: Seconds after which a claim whose writer never finished is another's to take.
STALE = 600


def _renamed(spark: SparkSession, draft: str, to: str) -> bool:
    """Whether draft became `to`, which no other writer has claimed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, claim = path(to), path(f"{to}.claimed")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
        fs.delete(claim, False)
    try:
        made = fs.createNewFile(claim)
    except Py4JJavaError:  # made by another meanwhile
        made = False
    return made and not fs.exists(target) and fs.rename(path(draft), target)


def drop_layer(spark: SparkSession, path: str, layer: str, workspaces: DataFrame) -> None:
    """Removes a layer's rows of the workspaces."""
    now = read_layer(spark, path, layer)
    if now is not None:
        write_layer(now.limit(0), path, layer, workspaces)
