"""Paths that driver and executors share, reached through Hadoop's file systems: a local folder or any store."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a local master may do without that; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="souk-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/souk/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to shared storage and read back, so that what follows is planned from a plain scan."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark.sparkContext, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def _listed(self, statuses: object) -> list[str]:
        """Paths of file statuses, as one text from the JVM: a call for each file is slow."""
        if not statuses:
            return []
        joined = self.jvm.org.apache.commons.lang3.ArrayUtils.toString(self.jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses))
        return sorted(x for x in joined[1:-1].split(",") if x)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [x.rsplit("/", 1)[1] for x in self._listed(fs.listStatus(p))] if fs.exists(p) else []

    def stamp(self, path: str) -> str:
        """A text that changes with the files of a folder: their names, sizes and times."""
        fs, p = self._at(path)
        found = fs.listStatus(p) if fs.exists(p) else []
        return ";".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in found))

    def matching(self, pattern: str) -> list[str]:
        """Full paths of the files that a glob names. Names with a comma are not supported."""
        fs, p = self._at(pattern)
        return self._listed(fs.globStatus(p))

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Writes a file that must not exist. It appears whole or not at all, and of several writers one succeeds: the text is
        written aside, then moved without overwriting (on a local disk by a hard link, which fails if the name is taken)."""
        fs, p = self._at(path)
        _, aside = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                at = lambda x: self.jvm.java.io.File(x.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(at(p), at(aside))
            else:
                none = self.spark._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(aside, p, none)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise FileExistsError(path) from e
            raise
        finally:
            fs.delete(aside, False)

    def rename(self, old: str, new: str) -> None:
        self.rename_all({old: new})

    def rename_all(self, names: dict[str, str]) -> None:
        """Moves files within one file system."""
        path, fs = self.jvm.org.apache.hadoop.fs.Path, None
        for old, new in names.items():
            fs = fs or self._at(old)[0]
            if not fs.rename(path(old), path(new)):
                raise OSError(f"cannot rename {old} to {new}")

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
