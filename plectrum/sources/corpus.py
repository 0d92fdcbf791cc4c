"""Corpus folders: manifests, reference documents, manual texts and golden pairs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plectrum.functions.text import trim

MANIFEST = "version int, notice string, entries array<struct<id:string,title:string,category:string,description:string,pdf:string,reference:string,gold:string,synthetic:boolean>>"
DOCUMENT = (
    "id string, parser string, parserVersion string, source struct<name:string,pageCount:int,language:string>, "
    "blocks array<struct<id:string,type:string,text:string,page:int,order:int,level:int,listLevel:int>>"
)
GOLD = "fixtureId string, notice string, entries array<struct<blockId:string,spokenText:string>>"


def _json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("path", F.col("_metadata.file_path"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """place, id, title, category, description, pdf, reference, gold, synthetic of a manifest's entries."""
    return _json(spark, path, MANIFEST).select(F.posexplode("entries").alias("place", "e")).select("place", "e.*")


def cohort(entries: DataFrame) -> DataFrame:
    """The entries that an evaluation covers: those with a reference document."""
    return entries.where(F.col("reference").isNotNull())


def documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id, name, page_count, language, parser, path of reference documents, one file each."""
    return _json(spark, paths, DOCUMENT).select(
        F.col("id").alias("doc_id"), "source.name", F.col("source.pageCount").alias("page_count"), F.coalesce("source.language", F.lit("es")).alias("language"), "parser", "path"
    )


def blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id, block_id, ord, type, text, page, level, list_level of reference documents."""
    each = _json(spark, paths, DOCUMENT).select(F.col("id").alias("doc_id"), F.explode("blocks").alias("b"))
    return each.select(
        "doc_id", F.col("b.id").alias("block_id"), F.col("b.order").alias("ord"), "b.type", "b.text", "b.page", "b.level", F.col("b.listLevel").alias("list_level")
    )


def gold(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """fixture, entry, block_id, gold_text of manual texts, in their order."""
    each = _json(spark, paths, GOLD).select(F.col("fixtureId").alias("fixture"), F.posexplode("entries").alias("entry", "e"))
    return each.select("fixture", "entry", F.col("e.blockId").alias("block_id"), F.col("e.spokenText").alias("gold_text"))


def golden_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """name, source, expected from the files ``name.in.txt`` and ``name.expected.txt`` of a folder."""
    files = spark.read.option("wholetext", True).text(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), trim(F.col("value")).alias("text"))
    told = files.select(F.regexp_extract("file", r"^(.*)\.(in|expected)\.txt$", 1).alias("name"), F.regexp_extract("file", r"^(.*)\.(in|expected)\.txt$", 2).alias("part"), "text").where("name <> ''")
    return told.groupBy("name").agg(F.max(F.when(F.col("part") == "in", F.col("text"))).alias("source"), F.max(F.when(F.col("part") == "expected", F.col("text"))).alias("expected"))


def asset_path(root: str, site_path: str) -> str:
    """The file below root of a path that a manifest gives from the site's top."""
    return root.rstrip("/") + "/" + site_path.removeprefix("/")


def verified(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, content) plus same: whether the content still has the fingerprint that was stored for the path.

    known: path, fingerprint.  A file that has changed or that nobody knows is not reopened at a stored place.
    """
    from plectrum.functions.text import fingerprint

    hit = files.join(known.withColumnRenamed("fingerprint", "_known"), "path", "left")
    return hit.withColumn("same", F.coalesce(fingerprint(F.col("content")) == F.col("_known"), F.lit(False))).drop("_known")
