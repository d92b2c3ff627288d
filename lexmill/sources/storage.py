"""The shared folder of a session, and the Hadoop file system behind any path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only on one machine (a local master) may it be unset; then a folder of our own is set.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    if not context.getCheckpointDir():
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return context.getCheckpointDir()


def shared_subfolder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Files:
    """Files by path on whatever file system holds them."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        system, p = self._at(path)
        return system.exists(p)

    def delete(self, path: str) -> None:
        system, p = self._at(path)
        system.delete(p, True)

    def rename(self, a: str, b: str) -> None:
        system, p = self._at(a)
        if not system.rename(p, self.jvm.org.apache.hadoop.fs.Path(b)):
            raise OSError(f"cannot move {a} to {b}")

    def names(self, folder: str) -> list[str]:
        system, p = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(p)) if system.exists(p) else []

    def read_text(self, path: str) -> str:
        system, p = self._at(path)
        stream = system.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Written beside the path and moved there whole."""
        draft = f"{path}.{uuid.uuid4().hex}"
        system, p = self._at(draft)
        out = system.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(path)
        self.rename(draft, path)
