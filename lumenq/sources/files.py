"""Reading and writing records: JSON arrays and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARSE = "struct<indices:array<bigint>,values:array<float>>"
RECORD = f"id string, vector array<float>, text string, metadata string, sparse_vector {SPARSE}, named map<string,array<float>>, sparse map<string,{SPARSE}>, multi map<string,array<array<float>>>"
FORMAT_VERSION = 1


def read_json(spark: SparkSession, path: str, named: dict[str, str] | None = None) -> DataFrame:
    """Records of a JSON array (or one object a line) with id, vector, sparse, text, metadata and
    named_vectors; named tells the kind (dense, sparse or late) of each named vector. The record's own
    sparse vector is the column sparse_vector. Metadata is JSON text."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", False).schema("id string, vector array<float>, text string, metadata string, sparse " + SPARSE + ", named_vectors string").json(path)
    kinds = named or {}
    if any(k not in ("dense", "sparse", "late") for k in kinds.values()):
        raise ValueError("a named vector is dense, sparse or late")
    v = F.try_parse_json("named_vectors")
    one = lambda n, kind: F.try_variant_get(v, f"$['{n}']", kind)

    def of(kind: str, typ: str):  # noqa: ANN202
        pairs = [x for n, k in kinds.items() if k == kind for x in (F.lit(n), one(n, typ))]
        whole = F.create_map(*pairs) if pairs else F.lit(None).cast(f"map<string,{typ}>")
        return F.map_filter(whole, lambda _, x: x.isNotNull())

    return raw.select("id", "vector", "text", "metadata", F.col("sparse").alias("sparse_vector"), of("dense", "array<float>").alias("named"), of("sparse", SPARSE).alias("sparse"), of("late", "array<array<float>>").alias("multi"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Records of Parquet files in the exchange layout (format_version, dimensions, record_id,
    vector, metadata)."""
    rows = spark.read.parquet(path)
    return rows.select(F.col("record_id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("string").alias("metadata"))


def write_parquet(records: DataFrame, path: str) -> None:
    """The exchange layout: id, vector and metadata only."""
    meta = F.col("metadata") if "metadata" in records.columns else F.lit(None)
    records.select(
        F.lit(FORMAT_VERSION).cast("smallint").alias("format_version"),
        F.size("vector").cast("bigint").alias("dimensions"),
        F.col("id").cast("binary").alias("record_id"),
        F.col("vector").cast("array<float>").alias("vector"),
        meta.cast("string").cast("binary").alias("metadata"),
    ).write.parquet(path)


def parse_byte_size(text: str | int) -> int:
    """Bytes of a number or of a text such as 128MB or 1.5 GiB."""
    if isinstance(text, int) and not isinstance(text, bool):
        if text < 0:
            raise ValueError("a size can't be negative")
        return text
    import re

    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)(i?)b?\s*", str(text), re.I)
    if not m:
        raise ValueError(f"not a size: {text}")
    power = " kmgt".index(m[2].lower() or " ")
    return int(float(m[1]) * (1024 if m[3] else 1000) ** power) if power else int(float(m[1]))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(RECORD))
