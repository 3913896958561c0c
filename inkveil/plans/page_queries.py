"""Queries over what a reader of pages tells: files, glyph runs, objects, boxes, layers; and their SQL. Orders and line items
stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import catalogue as c
from inkveil.operators import geometry
from inkveil.plans.job_queries import one_of, sql_of, table
from inkveil.sources import pdf

LABELS = tuple(dict.fromkeys(v[0] for v in c.ENTITIES.values()))
KINDS = (*pdf.HIDING, "Font", "Page")
POLICIES = ("/P /AllOn", "/P /AnyOff", "/P /AllOff", "/P /AnyOn", "")
CODES = ("PDF_NO_TEXT_LAYER", "PDF_TEXT_UNRELIABLE")


def _box(*sql: str):
    return F.array(*[F.expr(x).cast("double") for x in sql])


def pdf_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(k.alias("document_id"), (k % 11 == 0).alias("encrypted"), F.expr("o_custkey % 7 * 9000").alias("xrefs"), F.expr("o_custkey % 40").alias("pages"), F.when(k % 3 == 0, F.array(F.lit(CODES[1]), F.lit(CODES[0]), F.lit(CODES[0]))).otherwise(none).alias("blocking"))
    return pdf.classified(rows).select("document_id", "outcome", F.array_join("codes", ",").alias("codes"))


def glyph_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of glyphs that nobody sees, by document."""
    run = F.struct(F.expr("l_partkey % 5").alias("render_mode"), F.expr("(l_suppkey % 11) / 10").alias("opacity"), F.expr("l_partkey % 13 / 2").alias("size"), F.array_repeat(F.expr("(l_suppkey % 9) / 8"), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("color"), _box("l_partkey % 700", "l_suppkey * 7 % 900", "l_partkey % 700 + 30", "l_suppkey * 7 % 900 + 10").alias("box"))
    crop = F.array(*[F.lit(float(x)) for x in (0, 0, 612, 792)])
    runs = table(spark, sf_dir, "lineitem")
    return runs.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count_if(pdf.invisible(run, crop)).alias("invisible"), F.count("*").alias("runs"))


def hidden_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), one_of(KINDS, "l_partkey").alias("kind"), (F.col("l_suppkey") % 5 + 1).alias("page_number"))
    found = pdf.hidden_counts(rows)
    return found.select("document_id", "category", "n", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def rounded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _box("l_partkey / 8", "l_suppkey / 4", "l_partkey / 8 + (l_linenumber % 3) / 4096", "l_suppkey / 4 + 1")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(pdf.rounded(box)).alias("left"), F.count("*").alias("boxes"))


def label_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _box("0", "0", "o_custkey % 90", "o_orderkey % 17")
    return table(spark, sf_dir, "orders").select("o_orderkey", pdf.label_size(one_of(LABELS, "o_orderkey"), box).alias("size"))


def trimmed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes cut between the words above, below and beside them."""
    words = F.array(_box("0", "o_orderkey % 9", "50", "o_orderkey % 9 + 10"), _box("0", "o_custkey % 9 + 17", "50", "o_custkey % 9 + 27"), _box("100", "0", "150", "40"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", pdf.trimmed(_box("10", "10", "40", "22"), words).alias("b"))
    return out.select("o_orderkey", F.col("b")[1].alias("top"), F.col("b")[3].alias("bottom"))


def strayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    at = lambda n: _box(f"l_partkey % {n}", "0", f"l_partkey % {n} + 10", "10")
    changes = rows.where("l_linenumber > 1").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_linenumber"), at(20).alias("box"))
    meant = rows.where("l_linenumber = 1").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), at(20).alias("box"))
    return pdf.strayed(changes, meant).select("document_id", "l_linenumber")


def word_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over which a word that is no label still has its centre."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    one = F.lit(1).alias("page_number")
    found = rows.where("l_linenumber = 1").select(F.col("l_orderkey").alias("document_id"), one, F.lit("f").alias("finding_id"), F.array(_box("p % 20", "0", "p % 20 + 10", "10")).alias("boxes"))
    words = rows.where("l_linenumber > 1").select(F.col("l_orderkey").alias("document_id"), one, F.when(F.col("p") % 3 == 0, "[ID]").otherwise("left").alias("word"), *[F.expr(x).cast("double").alias(n) for x, n in (("p % 25", "x0"), ("0", "y0"), ("p % 25 + 4", "x1"), ("8", "y1"))])
    return geometry.box_residues(found, words, ["[ID]"]).select("document_id", "finding_id")


def layer_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What memberships of up to three layers hide under each policy, and an expression that negates one."""
    k = "o_orderkey"
    refs = F.array_join(F.transform(F.filter(F.array(*[F.lit(i) for i in (1, 2, 3)]), lambda i: F.expr("o_custkey % 8").cast("int").bitwiseAND(F.pow(F.lit(2), i - 1).cast("int")) > 0), lambda i: F.concat(i.cast("string"), F.lit(" 0 R"))), " ")
    plain = F.concat(F.lit("<< /Type /OCMD /OCGs ["), refs, F.lit("] "), one_of(POLICIES, k), F.lit(" >>"))
    member = F.when(F.expr(f"{k} % 6 = 5"), F.lit("<< /VE [/Not 1 0 R] >>")).otherwise(plain)
    objects = F.create_map(*[x for i in (1, 2, 3) for x in (F.lit(i), F.lit(f"<< /Type /OCG /Name (L{i}) >>").cast("binary"))])
    off = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.pmod(F.expr("o_orderkey div 8"), i + 1) == 0)
    rows = table(spark, sf_dir, "orders").select(k, member.cast("binary").alias("membership"), objects.alias("objects"), off.alias("off"))
    return pdf.layer_hidden(rows).select(k, "hidden")


QUERIES = {f.__name__: f for f in (pdf_outcomes, glyph_visibility, hidden_objects, rounded_boxes, label_sizes, trimmed_boxes, strayed_changes, word_residues, layer_policies)}

_MAPPED = sql_of((*pdf.HIDING.values(), "", ""), "l_partkey")
_UNIT = "(" + str([sum(pdf.WIDTHS[x] for x in label) / 1000 for label in LABELS]) + f")[CAST(o_orderkey AS INTEGER) % {len(LABELS)} + 1]"

ORACLE_SQL = {
    "pdf_outcomes": """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'PDF_ENCRYPTED' WHEN o_custkey % 7 * 9000 > 50000 THEN 'PDF_RESOURCE_LIMIT' WHEN o_custkey % 40 = 0 THEN 'PDF_NO_PAGES' WHEN o_custkey % 40 > 30 THEN 'PDF_TOO_MANY_PAGES' WHEN o_orderkey % 3 = 0 THEN 'PDF_NO_TEXT_LAYER,PDF_TEXT_UNRELIABLE' ELSE '' END AS codes FROM orders)
        SELECT k AS document_id, CASE WHEN codes IN ('PDF_RESOURCE_LIMIT', 'PDF_NO_PAGES') THEN 'failed' WHEN codes <> '' THEN 'review_required' ELSE 'text' END AS outcome, codes FROM x""",
    "glyph_visibility": """SELECT l_orderkey AS document_id, count(*) FILTER (l_partkey % 5 = 3 OR l_suppkey % 11 = 0 OR l_partkey % 13 / 2 < 2 OR ((l_suppkey % 9) / 8 >= 0.98) OR l_partkey % 700 > 612 OR l_suppkey * 7 % 900 > 792) AS invisible, count(*) AS runs FROM lineitem GROUP BY l_orderkey""",
    "hidden_objects": f"""WITH x AS (SELECT l_orderkey AS d, {_MAPPED} AS category, CAST(l_suppkey % 5 + 1 AS BIGINT) AS p FROM lineitem) SELECT d AS document_id, category, count(*) AS n, array_to_string(list_sort(list_distinct(list(p))), ',') AS pages FROM x WHERE category <> '' GROUP BY ALL""",
    "rounded_boxes": "SELECT l_orderkey, count(*) FILTER (round(l_partkey / 8 + (l_linenumber % 3) / 4096, 3) > round(l_partkey / 8, 3)) AS left, count(*) AS boxes FROM lineitem GROUP BY l_orderkey",
    "label_sizes": f"WITH x AS (SELECT o_orderkey, o_custkey % 90 - 2 AS w, floor(least(10, (o_custkey % 90 - 2) / {_UNIT}, (o_orderkey % 17) / 1.25) * 2) / 2 AS s FROM orders) SELECT o_orderkey, CASE WHEN w > 0 AND s >= 6 THEN s END AS size FROM x",
    "trimmed_boxes": """WITH x AS (SELECT o_orderkey, o_orderkey % 9 AS a, o_custkey % 9 + 17 AS b FROM orders), y AS (SELECT *, CASE WHEN a + 10 > 10 AND least(a + 10, 22) - greatest(a, 10) < 5 THEN CASE WHEN 2 * a + 10 < 32 THEN a + 10.25 END END AS up, CASE WHEN b < 22 AND least(b + 10, 22) - greatest(b, 10) < 5 THEN b - 0.25 END AS down FROM x),
        z AS (SELECT *, CAST(greatest(10, coalesce(up, 10)) AS DOUBLE) AS t, CAST(least(22, coalesce(down, 22)) AS DOUBLE) AS u FROM y) SELECT o_orderkey, CASE WHEN u <= t THEN 10.0::DOUBLE ELSE t END AS top, CASE WHEN u <= t THEN 22.0::DOUBLE ELSE u END AS bottom FROM z""",
    "strayed_changes": """WITH r AS (SELECT l_orderkey AS d, l_linenumber AS n, max(l_partkey) % 20 AS x FROM lineitem GROUP BY ALL) SELECT a.d AS document_id, a.n AS l_linenumber FROM r a LEFT JOIN r b ON b.d = a.d AND b.n = 1 WHERE a.n > 1 AND (b.x IS NULL OR abs(a.x - b.x) > 3)""",
    "word_residues": """WITH r AS (SELECT l_orderkey AS d, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY ALL) SELECT DISTINCT a.d AS document_id, 'f' AS finding_id FROM r a JOIN r w ON w.d = a.d AND a.n = 1 AND w.n > 1 AND w.p % 3 <> 0 AND w.p % 25 + 2 BETWEEN a.p % 20 AND a.p % 20 + 10""",
    "layer_policies": f"""WITH x AS (SELECT o_orderkey AS k, o_custkey % 8 AS m, o_orderkey % 5 AS p, list_filter([1, 2, 3], lambda i: (o_orderkey // 8) % (i + 1) = 0) AS off FROM orders),
        y AS (SELECT *, list_filter([1, 2, 3], lambda i: CAST(m AS INTEGER) & CAST(pow(2, i - 1) AS INTEGER) > 0) AS g FROM x), z AS (SELECT *, len(g) AS n, len(list_filter(g, lambda i: NOT list_contains(off, i))) AS shown FROM y)
        SELECT k AS o_orderkey, CASE WHEN k % 6 = 5 THEN NOT list_contains(off, 1) WHEN n = 0 THEN false WHEN p = 0 THEN shown < n WHEN p = 1 THEN shown = n WHEN p = 2 THEN shown > 0 ELSE shown = 0 END AS hidden FROM z""",
}
