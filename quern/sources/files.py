"""Files as rows: scan, expand archives, parse."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import QuernError
from quern.sources import registry
from quern.sources.archive import Guards, expand

SKIPPED_FOLDERS = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".idea")
SKIPPED_SUFFIXES = (".pyc", ".pyo", ".tmp", ".swp", ".lock", ".ds_store", ".exe", ".dll")

RAW = "external_id string, uri string, content binary, error string"


def named(files: DataFrame, base: str) -> DataFrame:
    """(external_id, uri, content) of binaryFile rows; names are relative to the
    folder, and only these are tested for what to skip."""
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    name = F.regexp_replace(F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.char_length(path))).otherwise(path), "^/+", "")
    name = F.when(name == "", F.element_at(F.split(path, "/"), -1)).otherwise(name)
    out = files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("external_id"), F.concat(F.lit("file://"), path).alias("uri"), "content")
    folders = F.slice(F.split("external_id", "/"), 1, F.greatest(F.size(F.split("external_id", "/")) - 1, F.lit(0)))
    bad = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    ends = F.lit(False)
    for s in SKIPPED_SUFFIXES:
        ends = ends | F.endswith(F.lower("external_id"), F.lit(s))
    return out.where(~bad & ~ends)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder, or one file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return named(found, folder.rstrip("/").removeprefix("file://"))


def expanded(files: DataFrame, guards: Guards = Guards()) -> DataFrame:
    """Archives become their members; a refused one becomes one row with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, uri, content in part.itertuples(index=False):
                if not name.lower().endswith(".zip"):
                    yield pd.DataFrame([(name, uri, content, None)], columns=["external_id", "uri", "content", "error"])
                    continue
                try:
                    members = list(expand(bytes(content), name, guards))
                    rows = [(m, f"{uri}!{m.split('!', 1)[1]}", body, None) for m, body in members]
                except QuernError as e:
                    rows = [(name, uri, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["external_id", "uri", "content", "error"])

    return files.select("external_id", "uri", "content").mapInPandas(run, RAW)


PARSED = "external_id string, text string, title string, headings array<struct<start:int,level:int,text:string>>, page_offsets array<int>, published_at string, authors array<string>, quality double, warnings array<string>, parser string, mime string, error string"


def parsed(files: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file: parsed, or with the reason why not.  A failure never
    ends the job.  ``carried`` columns go along, so that no join must bring them back."""
    schema = T.StructType([*T._parse_datatype_string(PARSED), *[files.schema[c] for c in carried]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["external_id"], part["content"]):
                try:
                    p = registry.parse(bytes(content if content is not None else b""), name)
                    marks = [{"start": a, "level": n, "text": t} for a, n, t in p.headings]
                    rows.append((name, p.text, p.title, marks, p.page_offsets, p.published_at, p.authors, p.quality, p.warnings, p.parser, registry.guess_mime(name), None))
                except Exception as e:  # any file may be broken in any way
                    rows.append((name, None, None, [], [], None, [], None, [], None, registry.guess_mime(name), f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(rows, columns=schema.names[: len(schema) - len(carried)])
            yield made.assign(**{c: part[c].to_numpy() for c in carried})

    return files.select("external_id", "content", *carried).mapInPandas(run, schema)


def readable(uri: str) -> bool:
    """Whether a name would be read at all."""
    return not uri.lower().endswith((*SKIPPED_SUFFIXES, *registry.UNREAD))


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dump(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False, sort_keys=True, default=str)
