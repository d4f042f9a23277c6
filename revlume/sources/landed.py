"""Raw page files as they landed: one file is one row, and no file that holds a byte is lost.

A file's place says what it is: ``…/app_id=<id>/country=<code>/page=<n>/<name>`` (App Store) or
``…/app_id=<id>/lang=<code>/country=<code>/page=<n>/<name>`` (Google Play).  Whatever does not fit has a place of its
own: ``status`` says why a file gives no page, ``corrupt`` keeps its text, and ``unknown`` keeps, as JSON, the fields that
the parsers do not read.  Spark's file readers pass over files of no bytes at all: such a page counts as never landed.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from revlume.schema import GOOGLE_PLAY_BATCHES, GOOGLE_PLAY_REVIEW

#: Values of ``status``, worst first; only ``ok`` files are read on.
STATUSES = ("bad_path", "empty", "not_json", "no_feed", "ok")
# Columns of the whole-file reader, and how a folder spells a null key.
_BINARY = "path string, modificationTime timestamp, length long, content binary"
_NULL = "__HIVE_DEFAULT_PARTITION__"


def _files(spark: SparkSession, root: str, streaming: bool, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # Folders are not taken for partitions: a value of the wrong type would stop the whole read.
    # Read as bytes: what is no text must not stop the read, and comes with marks in the place of bad bytes.
    files = reader.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).load(root)
    return files.select(F.make_valid_utf8(F.col("content").cast("string")).alias("body"), F.col("_metadata.file_path").alias("file"))


def _writer(folders: list[str], body: str, root: str, null: str):
    # Built in a function, so that it travels with the job and needs no package on the executors.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            for row in batch.to_pylist():
                names = [f"{n}={quote(row[n], safe='') if row[n] else null}" for n in folders]
                folder = os.path.join(root, *names)
                os.makedirs(folder, exist_ok=True)
                # A task that runs again writes the same bytes.
                with open(os.path.join(folder, "page.txt"), "w", encoding="utf-8", newline="") as file:
                    file.write(f"{row[body]}\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def land_files(rows: DataFrame, folders: list[str], body: str, root: str) -> None:
    """One file below ``root`` for each row, in folders by its keys, which are unique, as a collector leaves them.

    In a mounted folder the tasks write the files themselves: Spark's writer takes tens of milliseconds for each file it
    opens, as it starts a program to set the file's rights.  Any other store takes Spark's writer.
    """
    place = urlparse(root)
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in folders], body).repartition(folders[0])
    if place.scheme not in ("", "file"):
        texts.write.partitionBy(*folders).text(root)
        return
    path = unquote(place.path) if place.scheme else root
    written = texts.mapInArrow(_writer(folders, body, path, _NULL), "n long")
    written.write.format("noop").mode("overwrite").save()


def _key(name: str) -> Column:
    """A key from the folder's name, decoded; null where the folder is missing or says so."""
    raw = F.regexp_extract("file", rf"/{name}=([^/]*)/", 1)
    held = F.when(F.contains(F.col("file"), F.lit(f"/{name}=")), F.try_url_decode(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))))
    return F.when(held != _NULL, held)


def _has_folders(*names: str) -> Column:
    place = "".join(rf"/{n}=[^/]*" for n in names)
    return F.col("file").rlike(rf"{place}/[^/]+\z")


def _others(json_text: Column, known: tuple[str, ...]) -> Column:
    """Fields of a JSON object that are not among the known ones, as JSON; null if there are none."""
    fields = F.from_json(json_text, "map<string, string>")
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def _sorted_out(files: DataFrame, folders: tuple[str, ...], wanted: Column) -> DataFrame:
    """Add the keys, ``status`` and ``corrupt``; ``wanted`` is null where the body lacks its main part."""
    page = F.expr(r"try_cast(regexp_extract(file, '/page=([0-9]+)/', 1) AS int)")
    keyed = files.withColumns({**{n: _key(n) for n in folders if n != "page"}, "page": page})
    placed = _has_folders(*folders) & F.col("page").isNotNull()
    status = (
        F.when(~placed, "bad_path")
        .when(F.trim(F.regexp_replace("body", r"\s+", "")) == "", "empty")
        .when(F.try_parse_json("body").isNull() & F.from_json("body", "map<string, string>").isNull(), "not_json")
        .when(wanted.isNull(), "no_feed")
        .otherwise("ok")
    )
    keyed = keyed.withColumn("status", status)
    return keyed.withColumn("corrupt", F.when(F.col("status") != "ok", F.col("body")))


def landed_app_store(
    spark: SparkSession, root: str, streaming: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """``app_id, country, page, body, file, status, corrupt, unknown`` of every file below ``root``.

    ``unknown`` has the fields beside ``feed`` and those of ``feed`` beside ``entry``.  Null and repeated keys, empty
    folders and files of any size are allowed; a file is read in one task.
    """
    feed = F.get_json_object("body", "$.feed")
    rows = _sorted_out(_files(spark, root, streaming, files_per_batch), ("app_id", "country", "page"), feed)
    beside = _others(F.col("body"), ("feed",))
    inside = _others(feed, ("entry",))
    unknown = F.when(
        (F.col("status") == "ok") & (beside.isNotNull() | inside.isNotNull()),
        F.to_json(F.struct(beside.alias("page"), inside.alias("feed"))),
    )
    return rows.select("app_id", "country", "page", "body", "file", "status", "corrupt", unknown.alias("unknown"))


def landed_google_play(
    spark: SparkSession, root: str, streaming: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Batches ``{"next_token": …, "batch": [...]}`` of every file: the columns of the batch schema and what did not fit.

    ``unknown`` has the other fields of the file and of its elements; an element that does not fit the schema keeps what fits.
    """
    array = F.get_json_object("body", "$.batch")
    rows = _sorted_out(_files(spark, root, streaming, files_per_batch), ("app_id", "lang", "country", "page"), array)
    known = tuple(GOOGLE_PLAY_REVIEW.names)
    elements = F.transform(
        F.from_json(array, "array<map<string, string>>"), lambda e: F.map_filter(e, lambda k, v: ~k.isin(*known))
    )
    odd = F.filter(elements, lambda e: F.size(e) > 0)
    beside = _others(F.col("body"), ("next_token", "batch"))
    unknown = F.when(
        (F.col("status") == "ok") & (beside.isNotNull() | (F.size(odd) > 0)),
        F.to_json(F.struct(beside.alias("page"), F.when(F.size(odd) > 0, odd).alias("elements"))),
    )
    ok = F.col("status") == "ok"
    batch = F.from_json(array, GOOGLE_PLAY_BATCHES["batch"].dataType, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"})
    return rows.select(
        "app_id", "lang", "country", "page", F.when(ok, F.get_json_object("body", "$.next_token")).alias("next_token"),
        F.when(ok, batch).alias("batch"), "file", "status", "corrupt", unknown.alias("unknown"),
    )


def landing_report(landed: DataFrame, *key: str) -> DataFrame:
    """Files per ``key``: all of them, those of each status, and those with unknown fields."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return landed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_files"), *counts, F.count("unknown").alias("n_unknown")
    )
