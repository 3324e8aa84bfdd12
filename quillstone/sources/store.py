"""Index store: validated, versioned Parquet snapshots behind a pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.retrieval import valid_vector


def index_violations(index: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, rule): vectors that are null, of another length, not finite or not of unit length, and ids used twice."""
    v = F.col("embedding")
    rule = F.when(v.isNull(), "no vector").when(F.size(v) != dim, "other dimension").when(~valid_vector(v), "not finite or zero").when(F.abs(X.norm(v) - 1) > 1e-4, "not of unit length")
    bad = index.select("chunk_id", rule.alias("rule")).where("rule is not null")
    twice = index.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id", F.lit("id used twice").alias("rule"))
    return bad.unionByName(twice)


class Store:
    """Snapshots below a folder; readers follow the pointer, which is replaced last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, path: str, text: str) -> None:
        tmp = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        # one atomic step: a reader finds the old pointer or the new one
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if tmp.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(tmp, self._path(path), options)

    def current(self) -> dict | None:
        """The published manifest, or None."""
        p = self._path(f"{self.root}/current.json")
        if not self._fs.exists(p):
            return None
        line = self.spark.read.text(f"{self.root}/current.json", wholetext=True).first()
        return json.loads(line[0]) if line and line[0].strip() not in ("", "null") else None

    def publish(self, index: DataFrame, model: str, dim: int, keep: int = 2) -> dict:
        """Validate, write a new version, verify it, swing the pointer, prune older versions."""
        if index_violations(index, dim).limit(1).count():
            raise ValueError("the index breaks a rule; see index_violations")
        version = uuid.uuid4().hex
        where = f"{self.root}/versions/{version}"
        index.write.parquet(where)
        back = self.spark.read.parquet(where)
        n = back.count()
        if not n:
            raise ValueError("the index is empty")
        mark = lambda d: d.agg(F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)"))).first()[0]
        if mark(back) != mark(index):
            raise OSError("what was written isn't what was read back")
        old = self.current()
        history = [version, *(old["history"] if old else [])]
        manifest = {"version": version, "model": model, "dimension": dim, "chunks": n, "history": history[:keep], "schema": 1}
        self._write(f"{self.root}/current.json", json.dumps(manifest))
        for gone in history[keep:]:
            self._fs.delete(self._path(f"{self.root}/versions/{gone}"), True)
        return manifest

    def load(self, model: str) -> DataFrame:
        """The current index, if it was made with ``model``."""
        m = self.current()
        if m is None:
            raise ValueError("nothing is published")
        if m["model"] != model:
            raise ValueError(f"the index was made with {m['model']}")
        where = f"{self.root}/versions/{m['version']}"
        if m.get("schema") != 1 or not self._fs.exists(self._path(where)):
            raise ValueError("the published version isn't there, or of another form")
        return self.spark.read.parquet(where)

    def clear(self) -> None:
        self._write(f"{self.root}/current.json", "null")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark, as spreadsheets expect it; for reports, one file."""
    first, *rest = df.columns
    df.select(F.col(first).alias(f"\ufeff{first}"), *rest).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_trace(trace: DataFrame, path: str) -> None:
    """A trace's stages as CSV with a header."""
    trace.write.mode("overwrite").option("header", True).csv(path)


def dump_pages(pages: DataFrame, path: str, document: str = "document_id", page: str = "page") -> None:
    """Parsed pages as indented JSON, one array a document in a folder of its own; a page's columns in their order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(page).alias("at__"), F.struct(*(c for c in pages.columns if c != document)).alias("row")))), lambda x: x["row"])
    made = pages.groupBy(document).agg(rows.alias("rows")).select(document, F.to_json("rows", {"pretty": "true"}).alias("value"))
    made.write.mode("overwrite").partitionBy(document).text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of all files below a folder, hidden ones and markers aside."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.where(~F.substring(name, 1, 1).isin("_", ".")).select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def export_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A run's tables as CSV below a folder, with a manifest of their hashes beside them (``manifest``, JSON lines), which is returned."""
    for name, df in tables.items():
        export_trace(df, f"{path}/data/{name}")
    manifest(spark, f"{path}/data").write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("file string, size bigint, sha256 string").json(f"{path}/manifest")


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, what) of a bundle: files that are missing, new or altered since its manifest was written."""
    old = spark.read.schema("file string, size bigint, sha256 string").json(f"{path}/manifest").select("file", F.col("sha256").alias("was"))
    j = old.join(manifest(spark, f"{path}/data").select("file", "sha256"), "file", "full_outer")
    what = F.when(F.col("sha256").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("sha256"), "altered")
    return j.select("file", what.alias("what")).where("what is not null")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON arrays, one array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines, by an explicit schema."""
    ddl = "case_id string, company string, doc_name string, question_type string, question string, answer string, evidence array<struct<doc_name: string, evidence_doc_name: string, evidence_page_num: int, evidence_text: string>>"
    return spark.read.schema(ddl).json(path)


def missing_blocks(items: DataFrame, done: DataFrame, size: int = 512) -> DataFrame:
    """Items whose block of ``size`` positions isn't done yet: what a resumed encoding run has to do."""
    return items.withColumn("block", F.floor(F.col("position_no") / size)).join(done.select("block").distinct(), "block", "left_anti")
