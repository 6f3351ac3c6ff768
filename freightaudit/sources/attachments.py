"""Attachment bytes and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions.text import decode_text, strip

SUPPORTED_FORMATS = dims.TEXT_FORMATS + dims.OFFICE_FORMATS + dims.GLYPH_FORMATS


def attachment_format(path: Column) -> Column:
    """Lower-case file suffix without the dot; empty if there is none."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def scan_attachments(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below ``root`` as ``(path, length, content)``; ``path`` is relative to ``root``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    whole = qualified(spark, root)
    return reader.load(root).select(
        F.substr(F.col("path"), F.lit(len(whole) + 2)).alias("path"), "length", "content"
    )


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file source writes it in front of its paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.makeQualified(place).toString().rstrip("/")


def needed_attachments(files: DataFrame, mails: DataFrame) -> DataFrame:
    """Only files that some mail refers to.

    Paths alone are joined first, each once however many mails share it; the bytes are then
    joined to that distinct list.  ``sources/folder.py`` opens no other files to begin with.
    """
    refs = mails.select(F.explode("attachments").alias("path")).distinct()
    wanted = files.select("path").join(refs, "path", "left_semi")
    return files.join(wanted, "path", "left_semi")


def read_error(path: Column, text: Column) -> Column:
    """Why a text document cannot be used, or NULL."""
    suffix = attachment_format(path)
    return (
        F.when(
            ~suffix.isin(SUPPORTED_FORMATS),
            F.concat(
                F.lit("Unsupported attachment format: "),
                F.when(suffix == "", F.lit("(none)")).otherwise(F.concat(F.lit("."), suffix)),
            ),
        )
        .when(text.isNull(), F.lit("missing file"))
        .when(strip(text) == "", F.lit("The attachment contains no readable text."))
    )


def with_read_status(texts: DataFrame) -> DataFrame:
    """``(path, text)`` -> ``(path, text, error)``; one bad file never stops a batch."""
    return texts.withColumn("error", read_error(F.col("path"), F.col("text")))


def text_documents(files: DataFrame) -> DataFrame:
    """Documents of the text formats, decoded; other suffixes give their read error."""
    other = dims.OFFICE_FORMATS + dims.GLYPH_FORMATS
    texts = files.where(~attachment_format(F.col("path")).isin(other))
    return with_read_status(texts.select("path", decode_text(F.col("content")).alias("text")))


def required_formats(mails: DataFrame) -> DataFrame:
    """Suffixes used by a batch and whether a reader exists for each."""
    used = mails.select(F.explode("attachments").alias("path")).select(
        attachment_format(F.col("path")).alias("format")
    )
    return used.distinct().select("format", F.col("format").isin(SUPPORTED_FORMATS).alias("supported"))
