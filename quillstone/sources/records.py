"""Reading and writing record files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

_ANNOTATION = StructType([StructField("label", StringType()), StructField("uncertainty", DoubleType())])
_TEXTS = ("document_id", "url", "source", "document_type", "date", "date_precision", "body", "event_id", "issuer")
RECORD = StructType([*[StructField(c, StringType()) for c in _TEXTS], StructField("llm", _ANNOTATION), StructField("human", _ANNOTATION), StructField("provenance", MapType(StringType(), StringType())), StructField("group_id", StringType())])


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) is not None and len(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)) > 0


def read_records(spark: SparkSession, *paths: str, schema: StructType = RECORD, array: bool = False) -> DataFrame:
    """JSON lines (split at \\n only, so U+2028 stays content) or, with ``array``, JSON arrays; missing files are empty.

    Adds ``origin`` (the file) and ``corrupt``, which holds lines that don't parse.
    """
    there = [p for p in paths if _exists(spark, p)]
    full = StructType([*schema.fields, StructField("corrupt", StringType())])
    if not there:
        return spark.createDataFrame([], full).withColumn("origin", F.lit(None).cast("string"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    if array:
        return spark.read.schema(full).options(multiLine=True, **options).json(there).withColumn("origin", F.col("_metadata.file_path"))
    lines = spark.read.option("lineSep", "\n").text(there).select("value", F.col("_metadata.file_path").alias("origin")).where("trim(value) <> ''")
    return lines.select(F.from_json("value", full, options).alias("r"), "origin").select("r.*", "origin")


def read_split(spark: SparkSession, path: str, digest: str, count: int, labels: tuple[str, ...]) -> DataFrame:
    """A frozen split, refused unless its bytes, number of rows and labels are what the manifest says."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path").collect()
    found = files[0]["d"] if len(files) == 1 else hashlib.sha256("".join(f["d"] for f in files).encode()).hexdigest()
    rows = read_records(spark, path)
    label = F.coalesce(F.col("human.label"), F.col("llm.label"))
    n, odd = rows.agg(F.count(F.lit(1)), F.count_if(label.isNull() | ~label.isin(*labels))).first()
    if found != digest or n != count or odd:
        raise ValueError(f"{path} does not match its manifest: digest {found == digest}, rows {n} of {count}, labels outside {odd}")
    return rows


def write_frozen(df: DataFrame, path: str) -> None:
    """Write JSON lines once: the committer makes it whole or not there; an existing path is only accepted with equal content."""
    spark = df.sparkSession
    if _exists(spark, path):
        old = spark.read.schema(df.schema).json(path)
        if old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty():
            return
        raise FileExistsError(f"{path} is frozen with other content")
    df.write.mode("errorifexists").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows of ``df`` whose key ``path`` doesn't hold yet (a torn last line counts as absent); how many there were."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if _exists(spark, path):
        have = read_records(spark, path, schema=df.schema).where("corrupt is null").select(key).distinct()
        new = new.join(have, key, "left_anti")
    new = new.select(*df.columns)
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of zip files' members, and of gzip files as one member each, with no file held on the driver."""
    import gzip
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"]):
                if p.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        for name in z.namelist():
                            yield pd.DataFrame({"path": [p], "member": [name], "content": [z.read(name)]})
                else:
                    yield pd.DataFrame({"path": [p], "member": [p.rsplit("/", 1)[-1].removesuffix(".gz")], "content": [gzip.decompress(raw) if p.endswith(".gz") else raw]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(opened, "path string, member string, content binary")


def submission_text(raw: str = "raw"):
    """form, accession, filed (yyyy-MM-dd) and the text between the first <TEXT> and </TEXT> of a submission; empty where absent."""
    c = F.col(raw)
    return F.struct(
        F.regexp_extract(c, r"(?m)^CONFORMED SUBMISSION TYPE:\s*(\S+)", 1).alias("form"), F.regexp_extract(c, r"(?m)^ACCESSION NUMBER:\s*(\S+)", 1).alias("accession"),
        F.date_format(F.try_to_date(F.nullif(F.regexp_extract(c, r"(?m)^FILED AS OF DATE:\s*(\d{8})", 1), F.lit("")), "yyyyMMdd"), "yyyy-MM-dd").alias("filed"), F.regexp_extract(c, r"(?s)<TEXT>\r?\n?(.*?)\r?\n?</TEXT>", 1).alias("text"),
    )
