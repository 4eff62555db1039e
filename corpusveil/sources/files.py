"""File trees as tables and back.

Reading and writing happens in tasks through Arrow file systems (local, HDFS, object
stores by URI). Spark's own file sources skip names that start with '_' or '.', which
would lose files such as _app.tsx or everything below __tests__.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions.modules import infer_lang
from corpusveil.plans.joins import dictionary_join
from corpusveil.session import materialize, running_sums

FILES_SCHEMA = "path STRING, text STRING, bad_utf8 BOOLEAN, n_replaced INT"
TASK_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
#: Text in one file of a cleaned corpus.
FILE_BYTES = 128 << 20
#: Places in a folder that rows are dealt to.
PLACES = 1 << 40


def _open(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def list_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path below root, size) of all files with these extensions. The driver lists the top
    folder only; every subfolder is walked by a task."""
    from pyarrow import fs

    system, top = _open(root)
    top = top.rstrip("/")
    found = system.get_file_info(fs.FileSelector(top, recursive=False))
    folders = [i.path for i in found if i.type == fs.FileType.Directory]
    ends = tuple(extensions)
    direct = [(i.path[len(top) + 1:], i.size) for i in found if i.type == fs.FileType.File and i.path.endswith(ends)]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as afs

        task_system, _ = _open(root)
        for batch in batches:
            for folder in batch["folder"]:
                stack, rows = [folder], []
                while stack:
                    for info in task_system.get_file_info(afs.FileSelector(stack.pop(), recursive=False)):
                        if info.type == afs.FileType.Directory:
                            stack.append(info.path)
                        elif info.path.endswith(ends):
                            rows.append((info.path[len(top) + 1:], info.size))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["path", "size"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "size"])

    schema = "path STRING, size BIGINT"
    here = spark.createDataFrame(direct, schema)
    if not folders:
        return here
    below = spark.createDataFrame([(f,) for f in folders], "folder STRING").repartition(len(folders))
    return here.unionByName(below.mapInPandas(walk, schema))


def read_sources(spark: SparkSession, root: str, lang: str, project: str = "") -> DataFrame:
    """All source files of a language under root: project, path, lang, text, bad_utf8,
    n_replaced. Invalid UTF-8 is decoded with U+FFFD and reported, line ends become \\n."""
    listed = materialize(list_files(spark, root, v.EXTENSIONS[lang]), "listing")
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, int(total.b // TASK_BYTES) + 1, min(total.n, spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _open(root)
        columns = ["path", "text", "bad_utf8", "n_replaced"]
        for batch in batches:
            rows, held = [], 0
            for path in batch["path"]:
                with system.open_input_stream(f"{top.rstrip('/')}/{path}") as stream:
                    raw = stream.read()
                try:
                    text, bad = raw.decode("utf-8"), False
                except UnicodeDecodeError:
                    text, bad = raw.decode("utf-8", "replace"), True
                text = text.replace("\r\n", "\n").replace("\r", "\n")
                rows.append((path, text, bad, text.count("\ufffd") if bad else 0))
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    texts = listed.select("path").repartition(tasks).mapInPandas(read, FILES_SCHEMA)
    return texts.select(F.lit(project).alias("project"), "path", F.lit(lang).alias("lang"), "text", "bad_utf8", "n_replaced")


def sources_from_table(df: DataFrame, path: str, text: str, project: str | None = None, lang: str | None = None) -> DataFrame:
    """Any table with a path and a text column as a files table."""
    clean = F.make_valid_utf8(F.col(text))
    return df.select(
        (F.col(project) if project else F.lit("")).cast("string").alias("project"),
        F.col(path).cast("string").alias("path"),
        (F.col(lang) if lang else infer_lang(F.col(path).cast("string"))).alias("lang"),
        clean.alias("text"),
        (~F.is_valid_utf8(F.col(text))).alias("bad_utf8"),
        F.when(F.is_valid_utf8(F.col(text)), 0).otherwise(F.regexp_count(clean, F.lit("\ufffd"))).alias("n_replaced"),
    )


def write_clean(files: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Cleaned files as Parquet, a folder per project and language; modules without a source are
    left out.

    All projects lie in a row by their bytes of text, and a row of a project has its place there
    by a hash; every `file_bytes` of it are written by one task. So a large project is many files
    of that size, many small ones share a task, and there are at most bytes / file_bytes + 1 files
    more than folders, whatever the sizes. Only a single text can make a file larger. The rows are
    stored once before, so that they are not made again for their sizes.
    """
    spark = files.sparkSession
    folder = F.to_json(F.struct("project", "lang"))
    stored = materialize(files.where(F.col("path").isNotNull() & F.col("text").isNotNull()), "clean")
    sizes = stored.groupBy(folder.alias("_folder")).agg(F.sum(F.octet_length("text") + 1).alias("_bytes"))
    placed = materialize(running_sums(sizes, ["_folder"], "_bytes", "_nth", "_begin"), "folders")
    total = placed.agg(F.coalesce(F.sum("_bytes"), F.lit(0)).alias("b")).first().b
    within = F.pmod(F.xxhash64("path", "text"), F.lit(PLACES)) / PLACES
    tasks = int(total // file_bytes) + 1
    task = F.floor((F.col("_begin") + within * F.col("_bytes")) / file_bytes).cast("int")
    rows = dictionary_join(stored.withColumn("_folder", folder), placed, ["_folder"], ["path"]).withColumn("_task", task)
    rows.repartitionById(tasks, F.col("_task")).select(*stored.columns).write.mode("overwrite").partitionBy("project", "lang").parquet(path)


def write_tree(files: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Write every text to its path below root from within the tasks; returns the number of
    files. Writing again (a repeated task) replaces a file by the same content."""
    outside = r"(?:^|/)\.\.(?:/|$)|^/"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = _open(root)
        for batch in batches:
            for rel, content in zip(batch["path"], batch["text"]):
                if re.search(outside, rel):
                    raise ValueError(f"path leaves the target folder: {rel}")
                target = f"{top.rstrip('/')}/{rel}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as stream:
                    stream.write(content.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    rows = files.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(
        F.col(path).alias("path"), F.col(text).alias("text")
    )
    return rows.mapInPandas(write, "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def snapshot(files: DataFrame, base: str, now: datetime | None = None, dry_run: bool = False, enabled: bool = True) -> str | None:
    """Full copy of a table before it is reversed; returns its stamped path."""
    if dry_run or not enabled:
        return None
    path = f"{base.rstrip('/')}.backup-{(now or datetime.now()).strftime('%Y%m%d-%H%M%S')}"
    files.write.mode("error").parquet(path)
    return path
