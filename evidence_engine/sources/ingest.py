"""Documents from files and pages: decoding, HTML to text, tables, packed chunks."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean, token_count, token_windows

# Boilerplate line starts, and the limits of a table.
BOILERPLATE = r"(?i)^(cookie|accept all|subscribe|sign in|log in|menu|skip to|share this|advertisement)\b"
MIN_ROWS, MIN_COLUMNS, CONSISTENT, CAPTION = 3, 2, 0.6, 120


def decoded(content):
    """UTF-8, else UTF-16 with a byte-order mark, else Latin-1."""
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return F.when(marked, F.try_validate_utf8(F.decode(content, "UTF-16"))).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md,pdf}", pdf: Callable[[bytes], list[str]] | None = None, cleaned: bool = False) -> DataFrame:
    """Files below a folder -> doc_name, pages, error; a file that can't be read has the one page "(unreadable)" and says why; files
    of no bytes are left out by Spark's reader.

    `pdf` turns a file's bytes into its pages; without it pypdf is used where it is installed. cleaned: texts as clean()
    leaves them, which takes the wide gaps out of fixed-width tables."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    is_pdf = F.lower("path").endswith(".pdf")
    texts = raw.filter(~is_pdf).select("path", F.array(F.coalesce(decoded(F.col("content")), F.lit("(unreadable)"))).alias("pages"), F.lit(None).cast("string").alias("error"))
    read = pdf or _pypdf

    def pages(batches):
        for pdf_rows in batches:
            out = []
            for name, content in zip(pdf_rows["path"], pdf_rows["content"], strict=True):
                try:
                    out.append((name, read(bytes(content)) or [""], None))
                except Exception as e:  # one bad file must not end the job
                    out.append((name, ["(unreadable)"], f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "pages", "error"])

    both = texts.unionByName(raw.filter(is_pdf).mapInPandas(pages, "path string, pages array<string>, error string"))
    shown = F.transform("pages", clean) if cleaned else F.col("pages")
    return both.select(F.element_at(F.split("path", "/"), -1).alias("doc_name"), shown.alias("pages"), "error").orderBy("doc_name")


def _pypdf(content: bytes) -> list[str]:
    import io

    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    if reader.is_encrypted:
        reader.decrypt("")
    return [page.extract_text() or "" for page in reader.pages]


def document_rows(files: DataFrame) -> DataFrame:
    """doc_name, pages -> doc_name, page_no (from 1), text: a row a page."""
    return files.select("doc_name", F.posexplode("pages").alias("p", "text")).select("doc_name", (F.col("p") + 1).alias("page_no"), "text")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; a line that doesn't fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markup_lines(markup):
    """Lines of text of an HTML page as a column: cells joined by bars, blocks apart, boilerplate and short
    lines without digits left out. Entities are decoded by html_text()."""
    m = F.regexp_replace(F.coalesce(markup, F.lit("")), r'(?is)<math[^>]*>(?:.*?<annotation[^>]*>(.*?)</annotation>)?.*?</math>', " $1 ")
    m = F.regexp_replace(m, r"(?is)<(script|style|noscript|svg|head)[^>]*>.*?</\1>", " ")
    m = F.regexp_replace(F.regexp_replace(m, r"(?i)</(td|th)>", " | "), r"(?i)</(p|div|section|article|li|h[1-6]|tr)>|<br\s*/?>", "\n")
    lines = F.transform(F.split(F.regexp_replace(m, r"<[^>]+>", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: ~x.rlike(BOILERPLATE) & ((F.char_length(x) > 40) | ((F.char_length(x) > 3) & x.rlike(r"\d"))))


def html_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> page_id, text with entities decoded."""

    def decode(batches):
        for pdf in batches:
            pdf["text"] = pdf["text"].map(html.unescape)
            yield pdf

    lines = pages.select("page_id", F.array_join(markup_lines(F.col("html")), "\n\n").alias("text"))
    return lines.mapInPandas(decode, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string")


#: A rule row, and a line that may be tabular (fixed values); the columns are counted below.
RULE, BARS = r"^[\s|:+-]*[-+][\s|:+-]*$", r"\||\S {3,}\S"


def _cells(line):
    bars = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    return F.when(line.contains("|"), bars).otherwise(F.split(line, r"\s{3,}"))


def page_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, line_no (from 0), raw, line (stripped), tabular, table_id: a row a line, of the documents that have lines enough with
    bars or wide gaps to hold a table; table_id is null outside tables. Runs of tabular lines are islands: rule rows don't end
    one, any other line does. A run is a table with at least 3 lines, 2 columns and 60% of its lines at full width."""
    some = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(BARS), F.lit(0))) >= MIN_ROWS
    lines = docs.filter(some).select(key, F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    rule = F.col("line").rlike(RULE)
    lines = lines.withColumn("rule", rule).withColumn("cells", F.when(~rule & F.col("line").rlike(BARS), _cells(F.col("line"))))
    lines = lines.withColumn("tabular", F.coalesce(F.size("cells") >= MIN_COLUMNS, F.lit(False)))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("run", F.sum((~F.col("tabular") & ~F.col("rule")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "run")
    width = F.max(F.when(F.col("tabular"), F.size("cells"))).over(run)
    lines = lines.withColumn("width", width).withColumn("n", F.sum(F.col("tabular").cast("int")).over(run)).withColumn("full", F.sum((F.col("tabular") & (F.size("cells") == F.col("width"))).cast("int")).over(run))
    good = (F.col("n") >= MIN_ROWS) & (F.col("full") >= CONSISTENT * F.col("n"))
    edges = [F.min(F.when(F.col("tabular"), F.col("line_no"))).over(run), F.max(F.when(F.col("tabular"), F.col("line_no"))).over(run)]
    lines = lines.withColumn("good", good).withColumn("begin", edges[0]).withColumn("end", edges[1])
    inside = F.col("good") & F.col("line_no").between(F.col("begin"), F.col("end"))
    nth = F.sum((F.col("good") & (F.col("line_no") == F.col("begin"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    title = (F.col("line") != "") & ~F.col("tabular") & (F.char_length("line") < CAPTION)
    for back in (1, 2):
        lines = lines.withColumn(f"above{back}", F.when(F.lag(title, back).over(w), F.lag("line", back).over(w)))
    return lines.withColumn("table_id", F.when(inside, nth).cast("int")).select(key, "line_no", "raw", "line", "tabular", "cells", "width", "table_id", F.coalesce("above1", "above2", F.lit("")).alias("above"))


def row_text(headers, cells):
    """A row that says by itself what its cells are: Header: cell | ..., empty cells left out."""
    named = F.zip_with(headers, cells, lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c)))
    return F.array_join(F.filter(F.when((F.size(headers) > 0) & (F.size(headers) == F.size(cells)), named).otherwise(F.transform(cells, lambda c: F.nullif(c, F.lit("")))), lambda x: x.isNotNull()), " | ")


def table_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, table_id, row_index, headers, cells, caption, text. A table's first row is its header if it is full and has
    no digits; the caption is the nearest line of up to two above that is short and not tabular."""
    rows = page_lines(docs, key).filter("tabular and table_id is not null")
    w = Window.partitionBy(key, "table_id").orderBy("line_no")
    rows = rows.withColumn("nth", F.row_number().over(w) - 1).withColumn("first", F.first("cells").over(w)).withColumn("caption", F.first("above").over(w))
    header = (F.size("first") == F.col("width")) & ~F.exists("first", lambda c: c.rlike(r"\d"))
    rows = rows.withColumn("headers", F.when(header, F.col("first")).otherwise(F.array().cast("array<string>"))).withColumn("row_index", F.col("nth") - header.cast("int")).filter("row_index >= 0")
    return rows.select(key, "table_id", F.col("row_index").cast("int").alias("row_index"), "headers", "cells", "caption", row_text(F.col("headers"), F.col("cells")).alias("text"))


def prose(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the lines of their tables left out of text; a null text stays null."""
    lines = page_lines(docs, key)
    tabled = lines.filter("table_id is not null").select(F.col(key).alias("_k")).distinct()
    kept = lines.filter("table_id is null").groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"]), "\n").alias("_prose"))
    parts = tabled.join(kept, "_k", "left").select("_k", F.coalesce("_prose", F.lit("")).alias("_prose"))
    return docs.join(parts, F.col(key) == F.col("_k"), "left").withColumn("text", F.coalesce("_prose", "text")).drop("_k", "_prose")


def packed_paragraphs(text, size: int = 320, overlap: int = 64):
    """An array of chunks: paragraphs packed greedily.

    A paragraph over the size is cut into windows; the last paragraph of a full chunk is carried into the next
    if it is no longer than the overlap. A fold over each document's paragraphs; no Python."""
    paras = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    empty = F.array().cast("array<string>")

    def join(buffer):
        return F.when(F.size(buffer) > 0, F.array(F.trim(F.array_join(buffer, "\n\n")))).otherwise(empty)

    def step(acc, p):
        n = token_count(p)
        big = n > size
        full = acc["n"] + n > size
        tail = F.slice(acc["buffer"], F.greatest(F.size(acc["buffer"]), F.lit(1)), F.lit(1))
        carry = F.when((F.size(tail) > 0) & (token_count(F.element_at(F.concat(tail, F.array(F.lit(""))), 1)) <= overlap), tail).otherwise(empty)
        held = F.when(full, carry).otherwise(acc["buffer"])
        count = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + token_count(x))
        return F.when(big, F.struct(F.concat(acc["out"], join(acc["buffer"]), token_windows(p, size, overlap)).alias("out"), empty.alias("buffer"), F.lit(0).cast("long").alias("n"))).otherwise(
            F.struct(F.when(full, F.concat(acc["out"], join(acc["buffer"]))).otherwise(acc["out"]).alias("out"), F.concat(held, F.array(p)).alias("buffer"), (count + n).alias("n")))

    start = F.struct(empty.alias("out"), empty.alias("buffer"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(paras, start, step, lambda acc: F.concat(acc["out"], join(acc["buffer"])))


def doc_key(name, text):
    """Names a document by its name and how its text begins."""
    return F.substring(F.sha1(F.concat(name.cast("string"), F.lit(":"), F.substring(F.coalesce(text, F.lit("")), 1, 4096))), 1, 8)


def chunks(docs: DataFrame, size: int = 320, overlap: int = 64) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ordinal, chunk_id, n_tokens, text: packed paragraphs, tables not told apart."""
    rows = docs.select("doc_id", doc_key(F.col("doc_id"), F.col("text")).alias("key"), F.posexplode(packed_paragraphs(F.col("text"), size, overlap)).alias("pos", "text"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ordinal"), F.concat("key", F.lit("-"), (F.col("pos") + 1).cast("string")).alias("chunk_id"), token_count(F.col("text")).alias("n_tokens"), "text")


def build_index(pages: DataFrame, size: int = 320, overlap: int = 64) -> DataFrame:
    """pages (doc_name, page_no, text) -> doc_name, ordinal, chunk_id, page, table_id, row_index, headers, caption, n_tokens, text.

    Page by page, the rows of its tables first, each with its headers and caption, then its prose without their lines.
    Ordinals run from 1 through a document; page is null in a document of one page."""
    whole = pages.groupBy("doc_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("whole"), F.count(F.lit(1)).alias("n_pages"))
    keys = whole.select(F.col("doc_name").alias("_d"), doc_key(F.col("doc_name"), F.col("whole")).alias("key"), "n_pages")
    p = pages.withColumn("page", F.struct("doc_name", "page_no"))
    found = table_rows(p, "page").select(F.col("page.doc_name").alias("doc_name"), F.col("page.page_no").alias("page_no"), F.lit(0).alias("part"), (F.col("table_id") * F.lit(1 << 20) + F.col("row_index")).cast("long").alias("seq"), "table_id", "row_index", "headers", "caption", F.concat(F.when(F.col("caption") != "", F.concat("caption", F.lit(" — "))).otherwise(""), "text").alias("text"))
    rest = prose(p, "page").select("doc_name", "page_no", F.posexplode(packed_paragraphs(F.col("text"), size, overlap)).alias("pos", "text"))
    rest = rest.select("doc_name", "page_no", F.lit(1).alias("part"), F.col("pos").cast("long").alias("seq"), F.lit(None).cast("int").alias("table_id"), F.lit(None).cast("int").alias("row_index"), F.array().cast("array<string>").alias("headers"), F.lit("").alias("caption"), "text")
    ordinal = F.row_number().over(Window.partitionBy("doc_name").orderBy("page_no", "part", "seq"))
    every = found.unionByName(rest).withColumn("ordinal", ordinal).join(keys, F.col("doc_name") == F.col("_d"))
    return every.select("doc_name", "ordinal", F.concat("key", F.lit("-"), F.col("ordinal").cast("string")).alias("chunk_id"), F.when(F.col("n_pages") > 1, F.col("page_no")).alias("page"), "table_id", "row_index", "headers", "caption", token_count(F.col("text")).alias("n_tokens"), "text")


def chunk_label(doc_name, page, table_id, row_index):
    """What a chunk is called: its document, page, table and row."""
    return F.concat(doc_name, F.coalesce(F.concat(F.lit(" p."), page.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" table "), (table_id + 1).cast("string"), F.lit(" row "), (row_index + 1).cast("string")), F.lit("")))
