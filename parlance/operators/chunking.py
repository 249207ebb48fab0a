"""Overlapping chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.snapshots import Snapshots
from parlance.functions.text import strip

SIZE, OVERLAP = 750, 150


def n_windows(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` further on, until one reaches the end; none for an empty text."""
    return F.when(length > 0, 1 + F.ceil(F.greatest(F.lit(0), length - size) / (size - overlap))).otherwise(0).cast("int")


def chunk(docs: DataFrame, *, path: str = "source", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row for each chunk: id, text, path, chunk_index, char_start, char_end and the other columns.

    A chunk is stripped; a blank one is left out and not numbered; offsets are those of the window. Chunks are made
    and numbered within the row, so no text is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and less than the size")
    step = size - overlap
    # The text is cut once, into pieces of a step each, as a place in it is found by counting from its start; windows
    # are put together from pieces. What is bound by a lambda is worked out once for a text.
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    held = F.when(F.length(text) > 0, F.array(F.struct(pieces.alias("pieces"), F.length(text).alias("length"))))
    window = lambda h, s: F.struct(
        strip(F.left(F.array_join(F.slice(h["pieces"], (s / step).cast("int") + 1, -(-size // step)), ""), F.lit(size))).alias("text"), s.alias("char_start"), F.least(s + size, h["length"]).alias("char_end")
    )
    starts = lambda h: F.transform(F.sequence(F.lit(0), n_windows(h["length"], size, overlap) - 1), lambda k: k * step)
    windows = F.flatten(F.transform(held, lambda h: F.transform(starts(h), lambda s: window(h, s))))
    kept = F.filter(windows, lambda w: w["text"] != "")
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.posexplode(kept).alias("chunk_index", "chunk"))
    chunk_id = F.concat(F.md5(F.col(path)), F.lit("-"), F.col("chunk_index").cast("string"))
    return rows.select(*rest, chunk_id.alias("id"), F.col("chunk.text").alias("text"), "chunk_index", "chunk.char_start", "chunk.char_end")


def fingerprint(manifest: DataFrame, options: dict[str, object]) -> str:
    """SHA-256 over the manifest of a corpus (path, size, mtime) and the options that shape its chunks.

    Each file's line is hashed where it is; hashes are put in order and hashed again by their first three digits, then
    the 4096 results in order, so one hash comes to the driver whatever the number of files.
    """
    line = F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime").cast("string")), 256)
    ordered = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "|"), 256)
    parts = manifest.select(line.alias("line")).groupBy(F.substring("line", 1, 3).alias("head")).agg(ordered("line").alias("part"))
    whole = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "part"))), lambda p: p["part"]), "|").alias("parts"))
    return whole.select(F.sha2(F.concat_ws("|", "parts", F.lit(repr(sorted(options.items())))), 256)).first()[0]


def refresh(manifest: DataFrame, chunks_of: DataFrame, cache: str, options: dict[str, object]) -> DataFrame:
    """The cached chunks if nothing changed since they were written, else ``chunks_of``, written anew as a whole.

    A table for each fingerprint: no chunks of files that are gone stay behind, and what a crash left half written is no
    cache, as it was never committed. ``plans.chunk_index`` keeps an index up to date file by file instead.
    """
    held = Snapshots(manifest.sparkSession, f"{cache.rstrip('/')}/{fingerprint(manifest, options)}")
    if held.latest() == 0:
        held.publish(chunks_of)
    return held.read()
