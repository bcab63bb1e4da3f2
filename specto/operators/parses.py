"""An index of source trees that is kept between runs: one parse for each different content, in columns.

All questions about code read the columns they need of it. A run parses only contents that the index doesn't hold yet, so a
second run over a tree with one changed file parses one file, and copies of a file are parsed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specto.operators import code, scripts
from specto.operators.storage import shared_folder, stored
from specto.sources.python_path import importable

FILES = 500  # in a task, while that makes no more than 10,000 tasks
VERSION = 2  # of what a row holds; an index of another version is another folder
FOUND = code.MODULE.removeprefix("file string, ")
ROW = f"hash string, {FOUND}, compressed string, compress_error string, outline {code.OUTLINE}"


def analyse(text: str, lang: str) -> dict:
    """All that is known of one content: what code.parse(), compress() and outline() give, by a single parse.

    A definition of the top level that other files have too is parsed once by a worker; a file that doesn't fall into
    definitions is parsed whole.
    """
    if lang == "python":
        try:
            return in_pieces(text)
        except code.TROUBLE:
            pass  # the whole tells what is wrong, if anything is
    try:
        module = code.Module(text) if lang == "python" else None
        out = module.found() if module else scripts.parse(text)
        out["error"] = None
        if module:
            out["outline"] = code.outlined(module.every)
    except code.TROUBLE as e:
        return {"error": code.message(e)}
    try:
        out["compressed"] = module.compress() if module else scripts.compress(text)
    except code.TROUBLE as e:
        out["compress_error"] = code.message(e)
    return out


def in_pieces(text: str) -> dict:
    module = code.Pieces(text)
    found = module.found()
    return found | {"error": None, "outline": module.outline(), "compressed": module.compress(found)}


def keyed(files: DataFrame) -> DataFrame:
    """file, text, error (of reading it), lang, hash of language and content."""
    lang = code.language(F.col("file"))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.select("file", "text", error.alias("error"), lang.alias("lang"), F.sha2(F.concat_ws("\0", lang, F.coalesce("text", F.lit(""))), 256).alias("hash"))


def default_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/parses-{VERSION}"


def refresh(files: DataFrame, folder: str) -> None:
    """Parses the contents that the index in the folder lacks and appends them.

    Contents are dealt by their hash, so parsing uses all cores however few partitions the files have. What is written
    becomes visible at once when the job commits; a job that dies leaves the index as it was. One writer at a time.
    """
    spark = files.sparkSession
    kinds = spark.createDataFrame([], ROW).schema
    arrow = pa.schema([pa.field(f.name, code.arrow_type(f.dataType)) for f in kinds.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, langs, texts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(hashes), 500):
                rows = [{"hash": h} | analyse(t or "", lang) for h, lang, t in zip(hashes[at : at + 500], langs[at : at + 500], texts[at : at + 500], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    wanted = keyed(files).where("error is null").select("hash", "lang", "text")
    known = stored(spark, folder)
    if known is not None:
        wanted = wanted.join(known.select("hash"), "hash", "left_anti")
    new = wanted.select("hash").distinct().count()
    if known is not None and not new:
        return
    importable(spark)
    # a stated number of tasks: by the size of short texts, adaptive execution would give them all to one
    tasks = max(1, min(-(-new // FILES), 10_000))
    wanted.dropDuplicates(["hash"]).select("hash", "lang", "text").repartition(tasks, "hash").mapInArrow(run, ROW).write.mode("append").parquet(folder)


def indexed(files: DataFrame, folder: str | None = None) -> DataFrame:
    """The files (file, text and, if there is one, the error of reading it) with what is known of each, after a refresh of the index.

    file, text, error, lang, the columns of code.modules(), compressed, compress_error, outline. A very common content is
    one row of the index; adaptive execution splits the files that have it. The index is never sent through the driver.
    """
    return versions(files, folder=folder)[0]


def versions(*trees: DataFrame, folder: str | None = None) -> list[DataFrame]:
    """indexed() of several tables of files for use in one query: all are refreshed before any is read.

    Spark takes two readings of one folder for the same even if files came between them.
    """
    spark = trees[0].sparkSession
    folder = folder or default_folder(spark)
    for files in trees:
        refresh(files, folder)
    return [read(files, folder) for files in trees]


def read(files: DataFrame, folder: str) -> DataFrame:
    known = files.sparkSession.read.schema(ROW).parquet(folder).withColumnRenamed("error", "parse_error")
    rows = keyed(files).join(known.hint("shuffle_merge"), "hash", "left")  # by the size of its files, Spark would take the index for small and broadcast it
    names = [f.split(" ")[0] for f in ("imports", "aliases", "data", "top_classes", "top_functions", "classes", "functions", "compressed", "compress_error", "outline")]
    return rows.select("file", "text", F.coalesce("error", "parse_error").alias("error"), "lang", *names)
