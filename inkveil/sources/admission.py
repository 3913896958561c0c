"""What may come in: types by content and by name, limits of a batch, copies, source links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c

PDF_TYPE = "application/pdf"
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
GENERIC_TYPES = ("", "application/octet-stream", "binary/octet-stream")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder; those over the size limit have no content, and it is not read for them."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.where(F.col("length") <= c.MAX_FILE_BYTES).select("path", "modificationTime", F.col("length").alias("size_bytes"), "content", F.sha2("content", 256).alias("content_sha256"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """The same without contents, which are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", F.col("length").alias("size_bytes"))


def intact(content: Column, sha256: Column, size: Column) -> Column:
    return (F.sha2(content, 256) == sha256) & (F.length(content) == size)


def kind_of(content: Column) -> Column:
    """pdf, ole, zip or unsupported, by the first bytes; what a zip holds is for the DOCX reader to say."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    start = F.hex(F.substring(content, 1, 8))
    return F.when(start == "D0CF11E0A1B11AE1", "ole").when(start.startswith("504B0304"), "zip").when(head.contains("%PDF-"), "pdf").otherwise("unsupported")


def extension(filename: Column) -> Column:
    """The suffix with its dot, in lower case: of the last path segment, ASCII letters and digits, 1 to 7 of them; else null."""
    name = F.element_at(F.split(F.replace(filename, F.lit("\\"), F.lit("/")), "/", -1), -1)
    found = F.lower(F.regexp_extract(name, r"^[^.].*(\.[A-Za-z0-9]{1,7})$", 1))
    return F.when(found != "", found)


def declared_disagrees(kind: Column, filename: Column, content_type: Column, others: tuple[str, ...] = (".doc", ".docm", ".dotx", ".odt", ".rtf", ".txt", ".zip", ".exe", ".html", ".jpg", ".png")) -> Column:
    """True if name and declared type hint at different kinds, or at another than the content's."""
    ext = F.coalesce(extension(filename), F.lit(""))
    declared = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";")[0]))
    hints = F.array_compact(F.array(
        F.when((ext == ".pdf") | (declared == PDF_TYPE), "pdf"),
        F.when((ext == ".docx") | (declared == DOCX_TYPE), "docx"),
        F.when(ext.isin(*others) | ~declared.isin(*GENERIC_TYPES, PDF_TYPE, DOCX_TYPE), "other"),
    ))
    single = F.when(hints[0] == "other", kind.isin("pdf", "docx")).otherwise(kind != hints[0])
    return F.when(F.size(hints) == 0, False).when(F.size(hints) > 1, True).otherwise(single)


def upload_code(kind: Column, size: Column, disagrees: Column) -> Column:
    """Null if accepted, else why not. kind is that of docx.identified()."""
    broken = F.when(size == 0, "UPLOAD_MALFORMED_REQUEST").when(size > c.MAX_FILE_BYTES, "UPLOAD_FILE_TOO_LARGE")
    return broken.when(kind == "macro_or_template", "DOCX_MACRO_OR_TEMPLATE").when(~kind.isin("pdf", "docx"), "UPLOAD_UNSUPPORTED_TYPE").when(disagrees, "UPLOAD_SPOOFED_TYPE")


def used_bytes(uploads: DataFrame) -> DataFrame:
    """batch_id, used_bytes, files of the accepted uploads (batch_id, size_bytes, accepted)."""
    return uploads.groupBy("batch_id").agg(F.coalesce(F.sum(F.when(F.col("accepted"), F.col("size_bytes"))), F.lit(0)).cast("long").alias("used_bytes"), F.count_if("accepted").alias("files"))


def over_file_cap(uploads: DataFrame, cap: int = c.MAX_BATCH_FILES) -> DataFrame:
    """uploads (batch_id, arrival, ...) with `refused`: beyond the batch's first `cap` files."""
    return uploads.withColumn("refused", F.row_number().over(Window.partitionBy("batch_id").orderBy("arrival")) > cap)


def over_byte_cap(uploads: DataFrame, cap: int = c.MAX_BATCH_BYTES) -> DataFrame:
    """batch_id, arrival, refused: a file that would bring the accepted bytes over the cap is refused and adds none.

    Each decision needs those before it, so a batch is walked in order; batches are capped at a few dozen files.
    """
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, used, refused = rows.sort_values("arrival"), 0, []
        for size in rows["size_bytes"]:
            refused.append(used + size > cap)
            used += 0 if refused[-1] else size
        return pd.DataFrame({"batch_id": rows["batch_id"], "arrival": rows["arrival"], "refused": refused})

    slim = uploads.select("batch_id", "arrival", "size_bytes")
    kinds = dict(slim.dtypes)
    return slim.groupBy("batch_id").applyInPandas(walk, f"batch_id {kinds['batch_id']}, arrival {kinds['arrival']}, refused boolean")


def copies(uploads: DataFrame, digest: str = "content_sha256") -> DataFrame:
    """uploads with `duplicate`: the batch has an earlier file with the same digest."""
    return uploads.withColumn("duplicate", F.row_number().over(Window.partitionBy("batch_id", digest).orderBy("arrival")) > 1)


def source_url(url: Column, host: str, extensions: tuple[str, ...] = ("pdf", "docx"), longest: int = 2048) -> Column:
    """struct<href,filename> of an admitted https address of `host`, else null."""
    shape = rf"^https://{host.replace('.', '[.]')}(?::443)?(/[^?#]*)(?:\?([^#]*))?#?$"
    path, query = F.regexp_extract(url, shape, 1), F.regexp_extract(url, shape, 2)
    segments = F.slice(F.split(path, "/", -1), 2, 1000)
    decoded = F.transform(segments, lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))))
    bad = F.exists(segments, lambda s: s == "") | F.exists(decoded, lambda s: s.isNull() | s.isin(".", "..") | s.contains("/") | s.contains("\\"))
    name = F.try_element_at(decoded, F.lit(-1))
    stem = F.regexp_extract(name, rf"(?i)^([^.][\s\S]*)\.(?:{'|'.join(extensions)})$", 1)
    fine = (F.length(url) <= longest) & ~url.rlike(r"(?U)[\s\x00-\x1f\\]") & (path != "") & ~bad & (stem != "") & ~stem.endswith(".") & ~name.rlike(r'[\x00-\x1f<>:"/\\|?*]') & (F.length(name) <= 255)
    href = F.concat(F.lit(f"https://{host}"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(fine, F.struct(href.alias("href"), F.concat(stem, F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))).alias("filename")))


def pasted_links(rows: DataFrame, id_col: str, text_col: str, cap: int = 50) -> DataFrame:
    """id, position, href: http(s) links of a pasted list, the first of equal ones, `cap` at most in order."""
    each = rows.select(id_col, F.posexplode(F.split(text_col, r"[\s,;]+", -1)).alias("at", "href")).where(F.col("href").rlike(r"^https?://[^/]"))
    first = each.groupBy(id_col, "href").agg(F.min("at").alias("at"))
    ranked = first.withColumn("position", F.row_number().over(Window.partitionBy(id_col).orderBy("at")))
    return ranked.where(F.col("position") <= cap).select(id_col, "position", "href")


def is_cv_file(name: Column) -> Column:
    return name.rlike(r"(?i)\.(pdf|docx)$") & ~name.rlike(r"^(\.|~\$)")
