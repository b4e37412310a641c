"""Tables written in the middle of a job.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir``, which every executor can read: a lost executor takes
nothing with it.  Only a local session without that setting gets a folder of
its own.
"""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        own = tempfile.mkdtemp(prefix="waraq-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own = "file://" + own
    return _own


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses; it goes when the application ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/{sc.applicationId}"
    if getattr(sc, "_waraq_root", None) != root:
        where = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
        sc._waraq_root = root
    return f"{root}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_at(spark: SparkSession, path: str) -> int:
    """Size on disk of a path in any Hadoop file system; 0 where nothing is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text``, whole and by one writer only; False where it is there already.

    The text is written aside and then linked (local and mounted file systems) or renamed without overwriting (HDFS and others, whose
    rename must be atomic as it must be for streaming checkpoints).
    """
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    where, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    fs = where.getFileSystem(conf)
    fs.mkdirs(where.getParent())
    if fs.getUri().getScheme() == "file":
        at, aside = where.toUri().getPath(), draft.toUri().getPath()
        Path(aside).write_text(text, encoding="utf-8")
        try:
            os.link(aside, at)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
    out = fs.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    no_overwriting = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(draft, where, no_overwriting)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None where nothing is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` in ``buckets`` files by the hash of ``key``, each sorted by it."""
    name = f"waraq_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an entry of the catalogue; the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """What ``write_bucketed`` wrote; a join on ``key`` moves none of it."""
    name = f"waraq_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    df = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return df


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def clear(spark: SparkSession) -> None:
    """Delete the session's intermediate tables, once nothing that reads them is of use any more."""
    root = getattr(spark.sparkContext, "_waraq_root", None)
    for name in children(spark, root) if root else []:
        if not name.startswith("package-"):
            remove(spark, f"{root}/{name}")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, wherever it was started from; once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_waraq_shipped", False):
        return
    package = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(source.relative_to(package.parent)))
    where = sc._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "package") + "/waraq.zip")
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(where.toString())
    sc._waraq_shipped = True


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame for a Spark schema of plain columns: integers nullable, all else as Python objects, absent members null."""
    columns = [c.strip().split(" ", 1) for c in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype="Int64" if kind in ("int", "bigint") else object) for name, kind in columns})


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores where its source has fewer pieces than those; for costly work row by row.

    Sources of a cluster's size have more pieces than cores and pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
