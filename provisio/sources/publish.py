"""Sinks that readers never see half written: write aside, validate what was written, then point to it.

A published folder has a folder for each version and a file CURRENT that names the one that counts. Tables and reports of one version are
written and checked before CURRENT is replaced by a rename, so a job that fails or is killed before that leaves readers the version before, and all tables of a version
change together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"parquet": {"compression": "zstd"}, "csv": {"header": "true", "escape": '"'}, "json": {}}


class Part(NamedTuple):
    """A table of a version: its rows, its format, and checks that get what was read back and raise."""

    rows: DataFrame
    kind: str = "parquet"
    checks: Sequence[Callable[[DataFrame], None]] = ()
    may_be_empty: bool = False


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path(path)):
            return None
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes a file aside and renames it over the old one."""
        aside = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self.path(aside), self.path(path), options)

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def folders(self, path: str) -> list[tuple[int, str]]:
        """(time of change, name) of the folders in one."""
        if not self.fs.exists(self.path(path)):
            return []
        return sorted((s.getModificationTime(), s.getPath().getName()) for s in self.fs.listStatus(self.path(path)) if s.isDirectory())


def current(spark: SparkSession, path: str) -> str | None:
    """The version that counts."""
    text = Files(spark, path).read(f"{path}/CURRENT")
    return text.strip() if text else None


def staged(spark: SparkSession, path: str, parts: Mapping[str, Part]) -> str:
    """Writes a version aside and validates it: every part has rows, unless it may be empty, and passes its checks. What fails is deleted, and nothing is published."""
    files, version = Files(spark, path), f"v-{uuid.uuid4().hex}"
    try:
        for name, p in parts.items():
            target = f"{path}/{version}/{name}"
            p.rows.write.options(**FORMATS[p.kind]).format(p.kind).save(target)
            back = spark.read.options(**FORMATS[p.kind]).schema(p.rows.schema).format(p.kind).load(target)
            if not p.may_be_empty and back.limit(1).isEmpty():
                raise ValueError(f"{name} has no rows")
            for check in p.checks:
                check(back)
    except BaseException:
        files.delete(f"{path}/{version}")
        raise
    return version


def switched(spark: SparkSession, path: str, version: str, keep: int = 2) -> None:
    """From now on readers get this version. The newest others stay for those who still read them, in all as many as keep says."""
    files, before = Files(spark, path), current(spark, path)
    files.replace(f"{path}/CURRENT", version)
    others = [n for _, n in files.folders(path) if n.startswith("v-") and n not in (version, before)]
    for name in others[: max(0, len(others) - max(0, keep - 2))]:
        files.delete(f"{path}/{name}")


def publish(spark: SparkSession, path: str, parts: Mapping[str, Part], keep: int = 2) -> str:
    version = staged(spark, path, parts)
    switched(spark, path, version, keep)
    return version


def published(spark: SparkSession, path: str, name: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    reader = spark.read.options(**FORMATS[kind]).format(kind)
    return (reader.schema(schema) if schema else reader).load(f"{path}/{version}/{name}")


# ---- what hand-offs must keep


def required(columns: Sequence[str]) -> Callable[[DataFrame], None]:
    def check(df: DataFrame) -> None:
        if missing := sorted(set(columns) - set(df.columns)):
            raise ValueError(f"missing columns: {missing}")

    return check


def keyed(key: Sequence[str]) -> Callable[[DataFrame], None]:
    """No null in the key and no key twice."""

    def check(df: DataFrame) -> None:
        bad = F.lit(False)
        for k in key:
            bad = bad | F.col(k).isNull()
        if not df.where(bad).limit(1).isEmpty():
            raise ValueError(f"null in {list(key)}")
        if not df.groupBy(*key).count().where("count > 1").limit(1).isEmpty():
            raise ValueError(f"rows share {list(key)}")

    return check


def measured(columns: Sequence[str]) -> Callable[[DataFrame], None]:
    """Numbers, none of them negative or missing."""

    def check(df: DataFrame) -> None:
        for c in columns:
            x = F.expr(f"try_cast(`{c}` as double)")
            if not df.where(x.isNull() | F.isnan(x) | (x < 0)).limit(1).isEmpty():
                raise ValueError(f"{c} is missing, no number or negative in some rows")

    return check
