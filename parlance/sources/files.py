"""Reading of knowledge files, JSON lines, ledgers, mappings; each keeps the work in tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import is_object, strict_variant, strip

SUFFIXES = (".txt", ".md", ".pdf")


def knowledge_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder`` that hold text, by suffix in any case: path, suffix, size, mtime, text.

    UTF-8, else Latin-1; stripped; what can't be read is blank. PDF pages go through an adapter if its library is there.
    """
    # The scan itself leaves other files' contents unread.
    any_case = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x[1:]) for x in SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case).load(folder)
    suffix = F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1)))
    rows = files.select("path", suffix.alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    text = F.col("content").cast("string")
    plain = strip(F.when(F.is_valid_utf8(text), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")))
    return rows.withColumn("text", F.when(F.col("suffix") == ".pdf", pdf_reader()(F.col("content"))).otherwise(plain)).drop("content")


def pdf_reader():
    """Text of PDF contents: of each page the reading with more letters, of the layout's and the plain one; a file that can't be read is blank.

    The reader's library is needed where there are PDF files, and its absence an error there.
    """

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: "" if c is None or not bytes(c[:5]).startswith(b"%PDF") else "\n".join(map(better_reading, _pdf_pages(c))).strip())

    return read


def better_reading(pair: tuple[str, str]) -> str:
    """Of two readings of a page the one with the larger share of letters; the longer one, then the first, if they tie."""
    share = lambda x: sum(c.isalpha() for c in x) / max(1, len(x))
    return max(pair, key=lambda x: (share(x), len(x)))


def _pdf_pages(content: bytes) -> list[tuple[str, str]]:
    import io

    from pypdf import PdfReader

    try:
        return [(page.extract_text(extraction_mode="layout") or "", page.extract_text() or "") for page in PdfReader(io.BytesIO(content)).pages]
    except Exception:
        return []


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are JSON objects, as (value, row) with row a variant; blank, broken and other lines are left out."""
    lines = spark.read.text(path).withColumn("row", strict_variant(F.trim("value")))
    return lines.filter(is_object(F.col("row")))


def line_count(spark: SparkSession, path: str) -> int:
    """All lines, blank ones too."""
    return spark.read.text(path).count()


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object for each file: path and row; other files are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), strict_variant(strip(F.col("value"))).alias("row"))
    return files.filter(is_object(F.col("row")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of append-only files with their order as ``seq``: file, start of the stretch read, line of that stretch.

    The order needs no pass over all lines and no number that all of them share.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return lines.select(F.struct("file_path", "file_block_start", "line").alias("seq"), "value")


def load_mapping(path: str) -> dict:
    """A small YAML or JSON mapping on the driver; an empty one for anything else."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            found = json.loads(text)
    except Exception:
        return {}
    return found if isinstance(found, dict) else {}


def persona_table(spark: SparkSession, payload: dict, role: str, fallback: list[dict]) -> DataFrame:
    """Personas of a role as (id, name, traits, style); the fallback pool if the payload has none."""
    pool = payload.get("personas", payload).get(role) or fallback
    rows = [(str(p.get("id") or f"{role}-{k}"), p.get("name") or "", [str(t) for t in p.get("traits") or []], p.get("style") or "") for k, p in enumerate(pool)]
    return spark.createDataFrame(rows, "id string, name string, traits array<string>, style string")
