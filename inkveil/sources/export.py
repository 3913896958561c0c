"""What leaves the engine: names of downloads, archives of batches, the report as CSV."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.sources import docx

LONGEST_STEM = 180
NAMED = "document_id string, batch_id string, masked_name string, folder string"


def extension(filename: Column, kind: Column) -> Column:
    """By the kind of the content, else .pdf or .docx as the name has it, else nothing."""
    own = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(?i)\.(pdf|docx)$", 0))
    return F.when(kind.isin("pdf", "docx"), F.concat(F.lit("."), kind)).otherwise(own)


def stem(filename: Column, document_id: Column) -> Column:
    """The last path segment without its ending, unsafe characters as underscores; else eight hex digits of the id, else cv."""
    name = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"(?i)\.(pdf|docx)$", "")
    safe = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1F<>:"/\\|?*]', "_"), r"^\.+|[. ]+$", "")
    safe = F.substring(F.regexp_replace(safe, r"(?U)^\s+|\s+$", ""), 1, LONGEST_STEM)
    short = F.substring(F.regexp_replace(document_id.cast("string"), "(?i)[^0-9a-f]", ""), 1, 8)
    return F.when(F.coalesce(safe, F.lit("")) != "", safe).when(short != "", short).otherwise("cv")


def single_name(document_id: Column, kind: Column) -> Column:
    return F.concat(F.lit("redacted-"), document_id.cast("string"), F.lit("."), kind)


def _free(name: str, before: str, after: str, used: set[str], tried: dict[tuple[str, str], int]) -> str:
    """name, or else it with the least number that is free between before and after. What was taken stays taken, so the
    search goes on where it last ended for names of the same letters."""
    found = name
    if found.lower() in used:
        key = (before.lower(), after.lower())
        n = tried.get(key, 2)
        while (found := f"{before}{n}{after}").lower() in used:
            n += 1
        tried[key] = n + 1
    used.add(found.lower())
    return found


def _batch(rows: pd.DataFrame) -> pd.DataFrame:
    files, folders, out = (set(), {}), (set(), {}), []
    for r in rows.sort_values("arrival").itertuples():
        whole = f"masked_{r.stem}{r.ext}"
        front, dot, back = whole.rpartition(".")
        if not front or not back:
            front, dot, back = whole, "", ""
        out.append((r.document_id, r.batch_id, _free(whole, f"{front}-", dot + back, *files), _free(r.stem, f"{r.stem} ", "", *folders)))
    return pd.DataFrame(out, columns=["document_id", "batch_id", "masked_name", "folder"])


def archive_names(documents: DataFrame) -> DataFrame:
    """document_id, batch_id, masked_name, folder: names that no other of the batch has, whatever their case.

    documents: document_id, batch_id, arrival, filename, kind. A suffix may itself be taken, so the names of a batch are
    dealt in order; batches are capped at a few dozen files by admission.
    """
    rows = documents.select(F.col("document_id").cast("string").alias("document_id"), F.col("batch_id").cast("string").alias("batch_id"), "arrival", stem(F.col("filename"), F.col("document_id")).alias("stem"), extension(F.col("filename"), F.col("kind")).alias("ext"))
    return rows.groupBy("batch_id").applyInPandas(_batch, NAMED)


def _zip_batch(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("name")
    entries = {name: bytes(content) for name, content in zip(rows["name"], rows["content"], strict=True)}
    entries["report.csv"] = rows["report"].iloc[0].encode()
    return pd.DataFrame([(rows["batch_id"].iloc[0], f"masked-{rows['batch_id'].iloc[0]}.zip", docx.pack(entries))], columns=["batch_id", "name", "content"])


def batch_archives(outputs: DataFrame, csv: DataFrame) -> DataFrame:
    """batch_id, name, content: a package for each batch of its completed outputs and report.csv, with a fixed time.

    outputs: batch_id, name, content of completed documents only; csv: batch_id, report. Batches are capped by admission.
    """
    keyed = outputs.join(csv, "batch_id").select(F.col("batch_id").cast("string").alias("batch_id"), "name", "content", "report")
    return keyed.groupBy("batch_id").applyInPandas(_zip_batch, "batch_id string, name string, content binary")


def csv_by_batch(rows: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """batch_id, report: the rows of a report (document_id and plain columns) of each batch as CSV text with a header."""
    columns = [x for x in rows.columns if x != batch_col]
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    line = F.concat_ws(",", *[quoted(text(x)) for x in columns])
    lists = rows.select(batch_col, F.struct(F.col(columns[0]).alias("k"), line.alias("line")).alias("r")).groupBy(batch_col).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return lists.select(F.col(batch_col).alias("batch_id"), F.concat(F.lit(",".join(columns) + "\n"), F.array_join("r.line", "\n"), F.lit("\n")).alias("report"))


def write_csv(rows: DataFrame, path: str) -> None:
    """The report as CSV files with headers, a part for each partition: no batch limit holds here."""
    rows.write.mode("overwrite").csv(path, header=True)
