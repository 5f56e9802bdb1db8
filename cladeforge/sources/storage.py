"""The shared folder: where iterations and intermediate tables are written, so that lineage stays short and a lost executor costs one step."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written since the scopes that are open began.
_SCOPES: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Without that setting a folder of this machine, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='cladeforge-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/cladeforge/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cladeforge_path = path
    for scope in _SCOPES:
        scope.append(out)
    return out


@contextlib.contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables written within it, but for those put into the list it gives. What is kept must itself be written: nothing lazy may read the others."""
    made, kept = [], []
    _SCOPES.append(made)
    try:
        yield kept
    finally:
        _SCOPES.remove(made)
        names = {getattr(k, "_cladeforge_path", None) for k in kept}
        for table in made:
            if table._cladeforge_path not in names:
                discard(table)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    path = getattr(df, "_cladeforge_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
