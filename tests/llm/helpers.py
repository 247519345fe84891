"""Small tables of documents, awkward ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside: a table may have them as well.
CLASHING = ("hi", "lo", "id", "a", "b", "n", "h", "k", "kept", "root", "size", "salt", "v", "x", "label", "score", "distance", "lang_pred", "rejected", "n_replaced", "item_id", "__bad_id", "__h")


def docs(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None, langs: list[str | None] | None = None) -> DataFrame:
    rows = [((ids[i] if ids else i), t, (langs[i] if langs else "en"), f"src{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """The table with more columns, named like those used inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING if c not in df.columns])


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
