"""Session defaults, and a way to settle an intermediate result where the cluster can read it again."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win over these."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    return SparkSession.builder.master(master).appName("tidemark").config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir. Unset, a local session gets a temporary one; a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; a surrounding passing() deletes it."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (paths := _PASSING.get()) is not None:
        paths.append(path)
    return path


def settle(df: DataFrame, tag: str = "settled") -> DataFrame:
    """df written and read back: its lineage ends there, it is computed once, and a lost executor costs its own tasks only."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted at the end, but for those handed to keep, which what is returned still reads."""
    paths, kept, outer = [], set(), _PASSING.get()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._tidemark_path)
        return df

    token = _PASSING.set(paths)
    try:
        yield keep
    finally:
        _PASSING.reset(token)
        for path in paths:
            if path in kept:
                if outer is not None:
                    outer.append(path)
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may start where it can't be imported; once a Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tidemark-")
        shutil.copytree(package, f"{folder}/code/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/code"))
        context._tidemark_shipped = True
