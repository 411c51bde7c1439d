"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leadloom import session

#: The separators of words; a word is a run of any other characters.
SPACES = "\t\n\v\f\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = session.fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def held_out(doc_id: int | None) -> bool:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str],
                    rows: int, chars: int) -> list[tuple]:
    """Texts with their labels to learn from: ``(text, *labels)``, bounded by rows and characters.

    Rows come in the order of a hash of their id. A row that does not fit into the characters left
    is passed over and the next ones are tried, so one long text costs no other row its place. Rows
    that ``held_out`` names, without id or without a label take no part. Of several label rows of
    an id the largest values count, of several texts any one. Warns if a label has one value in
    the sample and more among all rows that may be learnt from.
    """
    from pyspark.sql import functions as F

    known = labels.select(F.col("doc_id").cast("long").alias("__id"), *label_cols).dropna()
    known = known.filter(F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), 4) != 2)
    known = known.groupBy("__id").agg(*[F.max(c).cast("int").alias(c) for c in label_cols])
    sizes = docs.select(F.col("doc_id").cast("long").alias("__id"),
                        F.coalesce(F.length("text"), F.lit(0)).alias("__n"))
    able = sizes.join(known, "__id").groupBy("__id", *label_cols).agg(F.max("__n").alias("__n"))
    first = able.filter(F.col("__n") <= chars).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    chosen, total = {}, 0
    for r in first.collect():
        if total + r["__n"] <= chars:
            total += r["__n"]
            chosen[r["__id"]] = tuple(r[c] for c in label_cols)
    _warn_of_missing(able, label_cols, list(chosen.values()))
    if not chosen:
        return []
    texts = docs.filter(F.col("doc_id").cast("long").isin(list(chosen))).select(
        F.col("doc_id").cast("long").alias("__id"), "text")
    found = {r["__id"]: r["text"] for r in texts.toLocalIterator()}
    return [(found[i] or "", *chosen[i]) for i in chosen if i in found]


def _warn_of_missing(able: DataFrame, label_cols: list[str], chosen: list[tuple]) -> None:
    """Warn of labels that have one value in ``chosen`` and more in ``able``."""
    import warnings

    from pyspark.sql import functions as F

    alone = [c for i, c in enumerate(label_cols) if len({x[i] for x in chosen}) < 2]
    if not alone:
        return
    ends = able.agg(*[f(c).alias(f"{k}_{c}") for c in alone
                      for k, f in (("least", F.min), ("most", F.max))]).head()
    for c in alone:
        if ends[f"least_{c}"] != ends[f"most_{c}"]:
            warnings.warn(f"the sample of {len(chosen)} rows has one value of {c} or none, "
                          "the labels have more: raise the bounds of the sample", stacklevel=3)
