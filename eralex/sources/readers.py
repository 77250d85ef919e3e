"""Scans. All are lazy, split by file, and keep the file as lineage where the format has one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex import schemas


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_votes(spark: SparkSession, pattern: str) -> DataFrame:
    """All vote files of a pattern, with a key of file and position."""
    rows = json_array(spark, pattern, schemas.VOTE)
    return rows.select("*", F.concat_ws("#", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("vote_key"))


def json_envelope(spark: SparkSession, pattern: str) -> DataFrame:
    """Judgments inside {"judgments": [...]} files, with file and position."""
    files = spark.read.schema(schemas.ENVELOPE).option("multiLine", True).json(pattern)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.posexplode("judgments").alias("pos", "j")).select("source_file", "pos", "j.*")


def partitioned_parquet(spark: SparkSession, base: str) -> DataFrame:
    """year=/court=/bench= folders: partitions become columns and are pruned by filters on them."""
    return spark.read.option("mergeSchema", True).parquet(base)


def csv_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("header", True).csv(path)


def lossy_text(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text): bytes as UTF-8, invalid sequences replaced."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def file_index(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(file_name, path) of one listing; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path")


def first_existing(rows: DataFrame, key: str, candidates: list[str], index: DataFrame) -> DataFrame:
    """rows with the path of the first of several candidate names that exists, or null."""
    named = rows.select(key, F.posexplode(F.array(*[F.col(c) for c in candidates])).alias("priority", "file_name"))
    hit = named.join(index, "file_name").groupBy(key).agg(F.min_by("path", "priority").alias("path"))
    return rows.join(hit, key, "left")


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag in ("td", "th") and self.tables:
            self.tables[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.tables[-1][-1] += data.strip()


def html_cells(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, table_no, pos, cell) of all table cells, in document order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                p = _Cells()
                p.feed(text or "")
                out += [(path, t, i, c) for t, cells in enumerate(p.tables) for i, c in enumerate(cells)]
            yield pd.DataFrame(out, columns=["path", "table_no", "pos", "cell"])

    return lossy_text(spark, pattern).mapInPandas(run, "path string, table_no int, pos int, cell string")


def first_table_about(cells: DataFrame, title: str) -> DataFrame:
    """Cells of each file's first table whose first cell contains the title."""
    lead = cells.where((F.col("pos") == 0) & F.col("cell").contains(title)).groupBy("path").agg(F.min("table_no").alias("table_no"))
    return cells.join(lead, ["path", "table_no"], "left_semi")


def cell_pairs(cells: DataFrame) -> DataFrame:
    """(path, left, right): cells 2i and 2i + 1; an odd last cell is left out."""
    pair = F.floor(F.col("pos") / 2).alias("pair")
    both = cells.groupBy("path", pair).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("cell"))).alias("left"), F.max(F.when(F.col("pos") % 2 == 1, F.col("cell"))).alias("right"))
    return both.where("right is not null").select("path", "pair", "left", "right")


def documents_text(spark: SparkSession, pattern: str, extract: Callable[[bytes], str | None], tasks: int | None = None, done=None) -> DataFrame:
    """(path, text) of binary files by a given extractor; null where it fails.

    done: an accumulator that grows by one with each file, to watch the progress of a long run.

    The extractor is any parser the cluster has; ``bounded`` gives it a time limit. Files are
    spread over ``tasks`` tasks, as one slow file must not hold up its neighbours.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    files = files.repartition(tasks) if tasks else files

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    out.append((path, extract(content)))
                except Exception:  # noqa: BLE001
                    out.append((path, None))
                if done is not None:
                    done.add(1)
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.mapInPandas(run, "path string, text string")


def document_pages(spark: SparkSession, pattern: str, extract: Callable[[bytes], str | None], start_page: int = 0, **how) -> DataFrame:
    """(path, text) of documents whose extractor divides pages by form feeds: from ``start_page`` on, without footnotes."""
    from eralex.operators.segment import clean_pages

    return documents_text(spark, pattern, extract, **how).select("path", clean_pages("text", start_page).alias("text"))


def bounded(command: list[str], seconds: float) -> Callable[[bytes], str | None]:
    """An extractor that pipes bytes through a child process and kills it after the time limit."""
    import subprocess

    def extract(content: bytes) -> str | None:
        try:
            done = subprocess.run(command, input=content, capture_output=True, timeout=seconds, check=True)
        except (subprocess.SubprocessError, OSError):
            return None
        return done.stdout.decode("utf-8", "replace")

    return extract


def probe(df: DataFrame, n: int = 3) -> tuple[list[tuple[str, str]], list]:
    """Columns with types, and the first rows."""
    return df.dtypes, df.take(n)
