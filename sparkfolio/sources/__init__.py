"""Readers: document files by suffix, DOCX and PDF text, JSON search cassettes and baselines; page budgets and settings."""

from __future__ import annotations

import io
import os
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pdf import pdf_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """Paragraphs outside tables, then the table cells, one a line; None for a file that isn't a readable DOCX."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    if body is None:
        return None
    text = lambda p: "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in p.iter())
    out = [text(p) for p in body.findall(f"{_W}p")]
    for table in body.iter(f"{_W}tbl"):
        out += ["\n".join(text(p) for p in cell.findall(f"{_W}p")) for row in table.findall(f"{_W}tr") for cell in row.findall(f"{_W}tc")]
    return "\n".join(out)


def magic_ok(content: Column, suffix: Column) -> Column:
    """Whether the first bytes fit the suffix: %PDF within the first kilobyte, PK for DOCX, anything else passes."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.when(suffix == ".pdf", F.instr(head, "%PDF") > 0).when(suffix == ".docx", F.hex(F.substring(content, 1, 4)) == "504B0304").otherwise(F.lit(True))


def read_documents(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """(path, suffix, text, problem) of the files under a path; .txt, .md, .docx and the text layer of .pdf are read.

    Texts are whole, unless `max_chars` is given; a text that it cuts says so in `problem`.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    raw = raw.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))).withColumn("ok", magic_ok(F.col("content"), F.col("suffix")))

    def run(batches):
        for pdf in batches:
            text, problem = [], []
            for content, suffix, ok in zip(pdf.content, pdf.suffix, pdf.ok):
                t, why = None, None
                if not ok:
                    why = "content doesn't fit the suffix"
                elif suffix in (".txt", ".md"):
                    t = content.decode("utf-8", "replace")
                elif suffix == ".docx":
                    t = docx_text(content)
                    why = None if t is not None else "unreadable docx"
                elif suffix == ".pdf":
                    t = pdf_text(content)
                    why = "unreadable pdf" if t is None else None if t else "no text layer"
                else:
                    why = "unsupported suffix"
                if t is not None:
                    t = re.sub(r"\r\n?", "\n", t)
                    if max_chars is not None and len(t) > max_chars:
                        t, why = t[:max_chars], f"cut to {max_chars} of {len(t)} characters"
                text.append(t)
                problem.append(why)
            yield pd.DataFrame({"path": pdf.path, "suffix": pdf.suffix, "text": text, "problem": problem})

    return raw.mapInPandas(run, "path string, suffix string, text string, problem string")


def read_cassettes(spark: SparkSession, path: str) -> DataFrame:
    """(query_key, rank, href, body) from JSON files of one object: key -> list of {href, body}."""
    schema = "map<string, array<struct<href:string, url:string, body:string, snippet:string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    rows = doc.select(F.explode("m").alias("query_key", "rs")).select("query_key", F.posexplode("rs").alias("rank", "r"))
    return rows.select("query_key", "rank", F.coalesce("r.href", "r.url").alias("href"), F.coalesce("r.body", "r.snippet", F.lit("")).alias("body"))


def write_reports(df: DataFrame, path: str, key: str, text: str) -> None:
    """One directory of text per key value."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_baseline(spark: SparkSession, path: str) -> list[str]:
    """The strings of a JSON list, a small fixed file; [] for a missing or unreadable file or anything but a list."""
    try:
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("b")).collect()
    except Exception as missing:  # noqa: BLE001  a path that isn't there
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []
    return [x for row in doc for x in row.b or [] if x is not None]


def env_number(name: str, default: float, low: float | None = None, high: float | None = None, environ=os.environ) -> float:
    """A setting from the environment, kept within bounds; the default where it is missing or no number.  Whole where the default is."""
    try:
        value = type(default)(environ.get(name, default))
    except ValueError:
        value = default
    value = value if low is None else max(low, value)
    return value if high is None else min(high, value)


# The most bytes, pages, pixels a page and bytes of page images of a PDF that is read as images.
MOST_BYTES, MOST_PAGES, MOST_PIXELS, MOST_IMAGE_BYTES = 10_000_000, 8, 6_000_000, 48_000_000


def page_budgets(pages: DataFrame, key: str) -> DataFrame:
    """(key, reason): why a document's pages can't be read as images, or null.

    pages: key, page, n_pages, pdf_bytes, pixels, image_bytes.  Bytes and pages of the document come first; then the
    pages in order, each by its pixels and then by all image bytes so far.
    """
    so_far = F.sum("image_bytes").over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.when(F.col("pdf_bytes") > MOST_BYTES, "pdf_bytes").when(F.col("n_pages") > MOST_PAGES, "too_many_pages")
    own = F.when(F.col("pixels") > MOST_PIXELS, "page_pixels").when(so_far > MOST_IMAGE_BYTES, "total_image_bytes")
    rows = pages.withColumns({"_whole": whole, "_own": own})
    per = rows.groupBy(key).agg(F.max("_whole").alias("w"), F.min(F.when(F.col("_own").isNotNull(), F.struct("page", "_own"))).alias("o"))
    return per.select(key, F.coalesce("w", "o._own").alias("reason"))
