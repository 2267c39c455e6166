"""Readers and normalisers of record files, and sinks. Formats are told by suffix, else by content."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.functions.schemas import answer_texts, first_column
from tallow.sources.files import NoSuchFiles, globbed, resolved, split_files


class SchemaError(ValueError):
    pass


POOL = T.StructType([T.StructField(n, T.StringType()) for n in ("instruction", "input", "output")])
QA = "id string, question string, context string, answers array<string>, language string"
SUFFIXES = {".parquet": "parquet", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".txt": "text"}


def kind_of(spark: SparkSession, path: str) -> str:
    """parquet, json (one list or object), jsonl, csv or text; files without a known suffix are sniffed.

    The first kilobytes are read by the file system, not the whole file.
    """
    first = globbed(spark, path)[:1]
    if not first:
        raise NoSuchFiles(path)
    name = path.removesuffix(".gz")
    for suffix, kind in SUFFIXES.items():
        if name.endswith(suffix) and (kind != "json" or path.endswith(".gz")):
            return "jsonl" if kind == "json" else kind
    head = head_of(spark, first[0])
    if head.startswith(b"PAR1"):
        return "parquet"
    return "json" if head.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"[" else "jsonl"


def head_of(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """The first bytes of a file, or of a folder's first data file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if system.getFileStatus(target).isDirectory():
        inner = [p for p in globbed(spark, f"{path}/*") if p.rsplit("/", 1)[1][0] not in "_."]
        return head_of(spark, inner[0], size) if inner else b""
    stream = system.open(target)
    try:
        data = bytearray()
        while len(data) < size and (b := stream.read()) >= 0:
            data.append(b)
        return bytes(data)
    finally:
        stream.close()


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Records of a file, folder or glob; malformed JSON fails, and so does a path without files."""
    kind = kind_of(spark, path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", kind == "json").option("mode", "FAILFAST").json(path)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)


def read_in_order(spark: SparkSession, spec: str, schema: T.StructType | None = None) -> DataFrame:
    """Records of all files that ``spec`` resolves to, with ``file`` and ``file_order`` (files by name)."""
    paths = resolved(spark, spec)
    order = F.array(*map(F.lit, paths))
    out = None
    for path in paths:  # files may be of several kinds
        rows = read_records(spark, path, schema).withColumn("file", F.lit(path))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumn("file_order", F.array_position(order, F.col("file")))


def read_sharded(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("instruction", "input", "output"), split: str = "train") -> DataFrame:
    """The wanted columns of a folder of Parquet shards (those of ``split`` if it names any); nulls become empty."""
    rows = spark.read.parquet(*split_files(spark, folder, split))
    return require(rows, *columns).select(*columns).na.fill("")


def require(rows: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in rows.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return rows


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """instruction, input, output; the scan reads only these, nulls become empty."""
    rows = require(read_records(spark, path), "instruction", "output")
    given = F.col("input") if "input" in rows.columns else F.lit("")
    return rows.select("instruction", given.alias("input"), "output").na.fill("")


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return spark.read.parquet(*split_files(spark, folder, split))


def split_of(path: Column) -> Column:
    """train, dev or test by the file's name; train wins."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.contains("train"), "train").when(name.rlike("dev|valid"), "dev").when(name.contains("test"), "test")


def normalise_chat(rows: DataFrame) -> DataFrame:
    """Records of several layouts as instruction, input, output, each row by the first layout it has:
    flat fields, a prompt and response, or the first two turns of conversations or messages (texts or
    structs with a value or content)."""
    own = set(rows.columns)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in own else F.lit(None).cast("string")

    layouts = []  # condition, instruction, input, output
    for a, b in (("instruction", "output"), ("prompt", "response"), ("prompt", "completion"), ("question", "answer")):
        if {a, b} <= own:
            layouts.append((F.col(a).isNotNull() & F.col(b).isNotNull(), text(a), text("input") if a == "instruction" else F.lit(""), text(b)))
    for name in ("conversations", "messages"):
        if name in own:
            element = rows.schema[name].dataType.elementType
            field = next((f for f in ("value", "content") if isinstance(element, T.StructType) and f in element.names), None)
            turns = [F.get(name, F.lit(i)) for i in (0, 1)]
            first, second = [t[field] if field else t for t in turns]
            layouts.append((F.size(name) > 0, first, F.lit(""), second))
    if not layouts:
        raise SchemaError("no known layout")

    def chosen(i: int) -> Column:
        out = F.lit(None).cast("string")
        for layout in reversed(layouts):
            out = F.when(layout[0], layout[i]).otherwise(out)
        return F.coalesce(out, F.lit(""))

    return rows.select(chosen(1).alias("instruction"), chosen(2).alias("input"), chosen(3).alias("output"))


def joined_instruction(instruction: Column, given: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) != "", F.concat(instruction, F.lit("\n"), given)).otherwise(instruction)


SQUAD = "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>>>"


def read_squad(spark: SparkSession, path: str, language: str | None = None, empty: str | None = "No answer") -> DataFrame:
    """Question-answer files as rows: nested paragraphs, or a list or lines of flat records; also Parquet.

    Questions without answers get ``empty`` (None: no answer at all).
    """
    kind = kind_of(spark, path)
    nested = kind != "parquet" and b'"paragraphs"' in head_of(spark, globbed(spark, path)[0], 1 << 16)
    if nested:
        rows = spark.read.schema(SQUAD).option("multiLine", True).json(path)
        rows = rows.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
        rows = rows.select("q.id", "q.question", "context", F.coalesce(F.transform("q.answers", lambda a: a["text"]), F.array().cast("array<string>")).alias("answers"))
    else:
        flat = read_records(spark, path)
        require(flat, "question")
        answers = answer_texts(flat, "answers") if "answers" in flat.columns else F.array().cast("array<string>")
        rows = flat.select(first_column(flat, "id", "qid").alias("id"), "question", first_column(flat, "context", "passage", "passage_text").alias("context"), answers.alias("answers"))
    lang = F.lit(language) if language else F.coalesce(F.nullif(F.regexp_extract("id", r"^([a-z]+)-", 1), F.lit("")), F.lit("unknown"))
    if empty is not None:
        rows = rows.withColumn("answers", F.when(F.size("answers") == 0, F.array(F.lit(empty))).otherwise(F.col("answers")))
    return rows.select("id", "question", "context", "answers", lang.alias("language"))


def union_subjects(spark: SparkSession, root: str, split: str = "test") -> DataFrame:
    """One table of per-subject folders, the folder's name in ``subject``."""
    rows = spark.read.parquet(*globbed(spark, f"{root}/*/{split}-*.parquet"))
    return rows.withColumn("subject", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def task_documents(rows: DataFrame, by: str, fields: tuple[str, ...] = ("input", "target")) -> DataFrame:
    """by, json: one document {"examples": [...]} a task (a benchmark task is small)."""
    each = F.struct(*fields)
    return rows.groupBy(by).agg(F.to_json(F.struct(F.array_sort(F.collect_list(each)).alias("examples"))).alias("json"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task, input, target of JSON documents {"examples": [...]}, the task from the file's name."""
    rows = spark.read.schema("examples array<struct<input:string,target:string>>").option("multiLine", True).json(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return rows.select(name.alias("task"), F.explode("examples").alias("e")).select("task", "e.input", "e.target")


def read_code_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_id, prompt, entry_point, test of a (zipped) JSONL file; a task that lacks one is an error."""
    rows = require(spark.read.json(path), "task_id", "prompt", "entry_point", "test")
    if n := rows.filter("task_id IS NULL OR prompt IS NULL OR entry_point IS NULL OR test IS NULL").count():
        raise SchemaError(f"{n} tasks lack a field")
    return rows.select("task_id", "prompt", "entry_point", "test")


def fingerprint(spark: SparkSession, path: str) -> str:
    """sha256 of the sorted line hashes of text, or row hashes of Parquet: files are read in splits, whatever their size."""
    if kind_of(spark, path) == "parquet":
        rows = spark.read.parquet(path).select(F.sha2(F.to_json(F.struct("*")), 256).alias("h"))
    else:
        rows = spark.read.text(path).select(F.sha2("value", 256).alias("h"))
    # a bounded number of parts, each an order-free digest of its rows
    parts = rows.groupBy(F.substring("h", 1, 2).alias("part")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", at, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 9, 17, 25, 33, 41, 49, 57)])
    return parts.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("*")))), 256)).first()[0]


def same_corpus(spark: SparkSession, a: str, b: str) -> None:
    """Pool and reference must come from one corpus."""
    if fingerprint(spark, a) != fingerprint(spark, b):
        raise SchemaError(f"{a} and {b} differ")


def write_table(rows: DataFrame, path: str, identity: dict, partition_by: tuple[str, ...] = ()) -> None:
    """A parquet table that knows what it was made from; _SUCCESS seals it."""
    tagged = rows.withColumn("_identity", F.lit(json.dumps(identity, sort_keys=True)))
    tagged.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, identity: dict) -> DataFrame:
    rows = spark.read.parquet(path)
    if not rows.filter(F.col("_identity") != json.dumps(identity, sort_keys=True)).isEmpty():
        raise SchemaError(f"{path} was made from something else")
    return rows.drop("_identity")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A results table as Markdown; tables of more than ``limit`` rows are an error."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found])
