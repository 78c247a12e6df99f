"""File sources and sinks: JSON lines with malformed records, CSV, partitioned writes."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of intermediate tables by application, for ``clear``; the local folder of sessions without a shared one.
_MADE: dict[str, list[str]] = {}
_LOCAL: list[str] = []


def made(spark: SparkSession, path: str) -> str:
    """``path``, remembered as an intermediate one."""
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this application has written so far; how many. For when all results that read them are written."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; in a temporary folder only where the session names none and runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-files-"))
        folder = "file://" + _LOCAL[0]
    return made(spark, f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """``df`` written as a table to a new path, so that it is worked out once; ``options`` are those of the Parquet writer."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, at most ``rows`` rows go to Python at a time, for tables of whole texts that are written inside it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON-lines files; malformed lines are skipped. A partition column of the path may be in the schema."""
    got = spark.read.schema(f"{schema}, _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(path)
    return got.where("_bad IS NULL").drop("_bad")


def read_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of lines (column line) that are one JSON object or one array of them each; others are skipped."""
    line = F.ltrim("line")
    many = F.from_json(line, f"ARRAY<STRUCT<{_fields(schema)}>>")
    one = F.array(F.from_json(line, f"STRUCT<{_fields(schema)}, _bad: STRING>", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.transform(F.filter(one, lambda r: r["_bad"].isNull()), lambda r: F.struct(*[r[n].alias(n) for n in _names(schema)]))
    return lines.select(F.explode(F.when(line.startswith("["), many).otherwise(good)).alias("r")).where("r IS NOT NULL").select("r.*")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _fields(schema: str) -> str:
    return ", ".join(f"{c.split()[0]}: {' '.join(c.split()[1:])}" for c in schema.split(", "))


def parse_records(lines: DataFrame, keys: str) -> DataFrame:
    """Question records of lines (column line) with their ``keys``, question and passages (array of texts).

    Passages are all paragraphs of all documents, or, in records without a list of documents, the list ``passages`` of
    texts or of objects with a text.
    Lines that are no JSON, and records without a question or without passages, are left out.
    """
    names = _names(keys)
    data = F.from_json("line", f"{keys}, question STRING, documents ARRAY<STRUCT<paragraphs: ARRAY<STRING>>>, passages ARRAY<STRING>, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(data.alias("d")).where("d._bad IS NULL")
    text = lambda p: F.when(p.startswith("{"), F.get_json_object(p, "$.text")).otherwise(p)
    listed = F.filter(F.transform("d.passages", text), lambda p: p.isNotNull())
    paragraphs = F.flatten(F.filter(F.transform("d.documents", lambda d: d["paragraphs"]), lambda p: p.isNotNull()))
    passages = F.when(F.col("d.documents").isNotNull(), paragraphs).otherwise(listed)
    out = rows.select(*[F.col(f"d.{n}").alias(n) for n in names], F.col("d.question").alias("question"), passages.alias("passages"))
    return out.where("trim(coalesce(question, '')) <> '' AND size(passages) > 0")


def scan_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored records of a folder that have an id and a question; unreadable ones are skipped."""
    return read_jsonl(spark, path, schema).where("id IS NOT NULL AND trim(coalesce(question, '')) <> ''")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header, a byte order mark or not, by the given schema; folder names are columns."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def jsonl_round_trip(df: DataFrame, schema: str, by: str | None = None) -> DataFrame:
    """``df`` written as JSON lines (in folders by a column, if given), with a malformed line in every thousand, and read back."""
    path = scratch(df.sparkSession, "jsonl")
    rest = [c for c in df.columns if c != by]
    line = F.to_json(F.struct(*rest))
    spoiled = df.select(*([by] if by else []), F.explode(F.when(F.pmod(F.xxhash64(*rest), F.lit(1000)) == 0, F.array(line, F.lit('{"broken": '))).otherwise(F.array(line))).alias("value"))
    writer = spoiled.write.partitionBy(by) if by else spoiled.write
    writer.text(path)
    return read_jsonl(df.sparkSession, path, schema)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` and those of ``old`` whose key is not in ``new``."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """CSV with a header, in one folder for each value of ``by`` if given."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


ANSWERS = "question_id STRING, question_type STRING, answers ARRAY<STRING>, yesno_answers ARRAY<STRING>, entity_answers ARRAY<ARRAY<STRING>>, source STRING"


def read_answer_files(spark: SparkSession, path: str) -> DataFrame:
    """Predicted or reference answers (ANSWERS) of a folder's JSON-lines files, which may also lie in zip archives.

    Plain files (``*.json``, ``*.jsonl``, ``*.txt``) are split by Spark; an archive is opened in one task and read line by line.
    A line that is no JSON object with a question_id, and a question_id that comes twice in all the files, are errors.
    """
    plain = spark.read.option("pathGlobFilter", "*.{json,jsonl,txt}").option("recursiveFileLookup", True).text(path).select(F.col("value").alias("line"))

    def unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as lines:
                            while block := list(islice(lines, 10_000)):
                                yield pa.RecordBatch.from_pydict({"line": [x.decode("utf-8").rstrip("\r\n") for x in block]})

    zipped = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(unzipped, "line string")
    row = F.from_json("line", f"{ANSWERS}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = plain.unionByName(zipped).where("trim(line) <> ''").select(F.col("line"), row.alias("r"))
    bad = F.raise_error(F.concat(F.lit("no JSON object with a question_id: "), F.substring("line", 1, 80)))
    names = _names(ANSWERS)
    checked = rows.select(F.when(F.col("r._bad").isNull() & F.col("r.question_id").isNotNull(), F.struct(*[F.col(f"r.{c}").alias(c) for c in names])).otherwise(bad).alias("r"))
    once = checked.groupBy(F.col("r.question_id").alias("question_id")).agg(F.first("r").alias("r"), F.count(F.lit(1)).alias("n"))
    twice = F.raise_error(F.concat(F.lit("question_id comes twice: "), "question_id"))
    return once.select(F.when(F.col("n") == 1, F.col("r")).otherwise(twice).alias("r")).select("r.*")


def write_zipped_lines(rows: DataFrame, path: str) -> None:
    """``rows`` as JSON lines in zip archives, one for each task, written by the tasks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(path)
        files.create_dir(at, recursive=True)
        task = TaskContext.get()
        final, n = f"{at}/part-{task.partitionId():05d}.zip", 0
        temporary = f"{at}/_{task.taskAttemptId()}"
        with files.open_output_stream(temporary) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("lines.json", "w", force_zip64=True) as member:
            for batch in batches:
                for line in batch.column(0):
                    member.write(line.as_py().encode() + b"\n")
                    n += 1
        files.move(temporary, final)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    rows.select(F.to_json(F.struct(*rows.columns)).alias("line")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
