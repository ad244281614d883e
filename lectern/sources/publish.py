"""Sets of files published as one: a new version is written and read back beside the present one, then a pointer is switched.

A folder has versions/<id>/files/... with a table of their digests, and a file CURRENT that names one. Whoever reads sees
one version whole; what fails on the way, a lost executor or a wrong digest, leaves the present one as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.markdown import write_files

FILES = "path string, bytes long, sha256 string"


class PublishError(ValueError):
    """code: expected_manifest_mismatch, unsafe_filename, duplicate_filename or chapter_set_mismatch."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def current(folder: str) -> dict | None:
    """What CURRENT says: version, files, bytes, fingerprint; null before anything was published."""
    store, root = _store(folder)
    if store.get_file_info(f"{root}/CURRENT").is_file:
        with store.open_input_stream(f"{root}/CURRENT") as f:
            return json.loads(f.read())
    return None


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of the present version's files; empty before anything was published."""
    now = current(folder)
    return spark.read.schema(FILES).parquet(f"{folder}/versions/{now['version']}/manifest") if now else spark.createDataFrame([], FILES)


def _read(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).text(f"{root}/files", wholetext=True)
    return raw.select(F.regexp_extract(F.url_decode("_metadata.file_path"), "/versions/[^/]+/files/(.*)$", 1).alias("path"), F.col("value").alias("text"))


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the present version."""
    now = current(folder)
    return _read(spark, f"{folder}/versions/{now['version']}") if now else spark.createDataFrame([], "path string, text string")


def _digest(files: DataFrame) -> dict:
    """Number, size and fingerprint of files (path, bytes, sha256), in any order."""
    each = F.xxhash64("path", "sha256").cast("decimal(38,0)")
    n, size, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum(each), F.lit(0)).cast("string")).first()
    return {"files": n, "bytes": int(size), "fingerprint": f"{n}-{total}"}


def publish(files: DataFrame, folder: str, expected: str | None = None) -> dict:
    """Makes the files (path, text) the present version: {version, files, bytes, fingerprint, disposition}.

    `expected` is the fingerprint that the present version has to have ('' for none yet). Paths have to be below
    the folder and distinct; empty and null texts are refused with the whole set. The disposition is created, replaced, or
    unchanged where the present version has the same files; then nothing is written over. An empty table publishes nothing.
    """
    spark, now = files.sparkSession, current(folder)
    if expected is not None and expected != (now or {}).get("fingerprint", ""):
        raise PublishError("expected_manifest_mismatch")
    good = F.coalesce(F.col("path").rlike("^[^/]") & ~F.col("path").rlike("(^|/)\\.\\.?(/|$)") & (F.length("text") > 0), F.lit(False))
    if not files.where(~good).isEmpty():
        raise PublishError("unsafe_filename")
    if not files.groupBy("path").count().where("count > 1").isEmpty():
        raise PublishError("duplicate_filename")
    version = uuid.uuid4().hex
    root = f"{folder}/versions/{version}"
    store, base = _store(folder)
    store.create_dir(f"{base}/versions/{version}/files", recursive=True)
    try:
        write_files(files, f"{root}/files").write.parquet(f"{root}/written")
        told = files.select("path", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
        told.write.parquet(f"{root}/manifest")
        told = spark.read.schema(FILES).parquet(f"{root}/manifest")
        found = _read(spark, root).select("path", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
        facts = _digest(told)
        if not facts["files"] or facts != _digest(found):
            raise PublishError("chapter_set_mismatch")
    except BaseException:
        store.delete_dir(f"{base}/versions/{version}")
        raise
    if now and facts["fingerprint"] == now["fingerprint"]:
        store.delete_dir(f"{base}/versions/{version}")
        return {**now, "disposition": "unchanged"}
    facts = {"version": version, **facts}
    part = f"{base}/CURRENT.{version}.part"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(facts).encode())
    store.move(part, f"{base}/CURRENT")
    return {**facts, "disposition": "replaced" if now else "created"}
