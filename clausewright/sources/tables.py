"""Sources and sinks: page blocks, questions, chunks, intents, versions and answers. All paths go through Spark's readers and writers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import text as T


def drop_footer_blocks(blocks: DataFrame, footer_ratio: float = 0.04) -> DataFrame:
    """Blocks that begin above the footer of their page; a null position or height drops the block."""
    return blocks.filter(F.col("y0") < F.col("page_height") * (1 - footer_ratio))


def assemble_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): block texts by page, cleaned of page numbers, pages in order. Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    joined = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), "\n")
    pages = blocks.groupBy("doc_id", "page_no").agg(joined("block_no").alias("text"))
    pages = pages.withColumn("text", T.clean_page_numbers(F.col("text")))
    return pages.groupBy("doc_id").agg(joined("page_no").alias("text"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder that the session names in spark.checkpoint.dir; only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausewright-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write under path has ended: then Spark has left its mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _store(df: DataFrame, path: str, regenerate: bool, kind: str = "parquet") -> None:
    """Write df unless a whole output is there; a half-written one is written again."""
    if regenerate or not _complete(df.sparkSession, path):
        getattr(df.write.mode("overwrite"), kind)(path)


def _manifest(df: DataFrame, path: str, regenerate: bool) -> None:
    _store(df.coalesce(1), f"{path}/metadata", regenerate, "json")


def write_chunks(chunks: DataFrame, path: str, version: str, enhancements: tuple[str, ...] = (), regenerate: bool = False) -> None:
    """Chunks under ``path``/chunks and a one-row manifest; outputs that exist stay unless ``regenerate``."""
    _store(chunks, f"{path}/chunks", regenerate)
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    named = F.array(*map(F.lit, enhancements)).cast("array<string>")
    row = stored.agg(F.count("*").alias("total_chunks")).withColumns({"generated_at": F.current_timestamp(), "version": F.lit(version), "enhancements": named})
    _manifest(row, path, regenerate)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def read_chunks_json(spark: SparkSession, path: str, name: str = "chunks") -> DataFrame:
    """Rows of small JSON documents, each read by one task, that hold them in one array beside their metadata; ``nested`` reads large ones by ranges."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(name).alias("r")).select("r.*")


def write_intents(intents: DataFrame, path: str, version: str, regenerate: bool = False) -> None:
    """Intents under ``path``/intents and a manifest with their number and mean quality score."""
    _store(intents, f"{path}/intents", regenerate)
    stored = read_intents(intents.sparkSession, path)
    row = stored.agg(F.count("*").alias("total_intents"), F.avg("quality_score").alias("average_quality_score"))
    _manifest(row.withColumns({"generated_at": F.current_timestamp(), "version": F.lit(version)}), f"{path}/intents_manifest", regenerate)


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/intents")


def write_chunks_with_intents(chunks: DataFrame, path: str, regenerate: bool = False) -> None:
    _store(chunks, f"{path}/chunks_with_intents", regenerate)


def write_versioned(chunks: DataFrame, base: str, version: str, notes: str, date: str, embedding_model: str, regenerate: bool = False) -> DataFrame:
    """Chunks with vectors under ``base``/``version`` and their manifest, which is returned."""
    path = f"{base}/{version}"
    _store(chunks, f"{path}/chunks", regenerate)
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    given = {"version": version, "date": date, "notes": notes, "embedding_model": embedding_model}
    _manifest(stored.agg(F.count("*").alias("num_chunks")).withColumns({k: F.lit(v) for k, v in given.items()}), path, regenerate)
    return chunks.sparkSession.read.json(f"{path}/metadata")


def commit_version(base: str, version: str, frames: dict[str, DataFrame], **given: str) -> DataFrame:
    """Write ``frames`` as one version under ``base`` that readers see whole or not at all; returns its manifest.

    Each commit writes to a folder of its own. Its manifest, one row in one file, comes last and makes it the current one of its version;
    what a broken commit has left is never read. Readers that have opened an earlier commit keep it, as nothing is overwritten.
    """
    spark = next(iter(frames.values())).sparkSession
    folder = f"data/{version}-{uuid.uuid4().hex}"
    for name, frame in frames.items():
        frame.write.parquet(f"{base}/{folder}/{name}")
    counts = [spark.read.parquet(f"{base}/{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in frames]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    counted = rows.agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counts"))  # one row for each frame
    named = {"version": version, "folder": folder, **given}
    row = counted.withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("committed_at", F.unix_micros(F.current_timestamp()))
    row.coalesce(1).write.mode("append").json(f"{base}/manifests")
    return current_version(spark, base, version)


_MANIFEST = "version string, folder string, committed_at long, counts map<string,long>, date string, notes string, embedding_model string"


def current_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    """The manifest of the last whole commit of a version; of two at the same time that with the larger folder name."""
    rows = spark.read.schema(_MANIFEST).json(f"{base}/manifests").filter(F.col("version") == version)
    return rows.orderBy(F.col("committed_at").desc(), F.col("folder").desc()).limit(1)


def read_version(spark: SparkSession, base: str, version: str, name: str) -> DataFrame:
    """A table of the last whole commit of a version."""
    row = current_version(spark, base, version).first()
    if row is None:
        raise ValueError(f"no version {version} under {base}")
    return spark.read.parquet(f"{base}/{row.folder}/{name}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text): one question per line, stripped, blank lines dropped, numbered from 0 in order of file names and lines.

    Lines are counted per input split and only the counts, one row each, meet in one place.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*split, F.monotonically_increasing_id().alias("m"), T.strip(F.col("value")).alias("text")).filter("text <> ''")
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("file", "start", before.alias("offset"))
    within = F.row_number().over(W.partitionBy("file", "start").orderBy("m")) - 1
    return lines.withColumn("i", within).join(F.broadcast(offsets), ["file", "start"]).select((F.col("i") + F.col("offset")).cast("long").alias("query_id"), "text")


def write_answers(answers: DataFrame, path: str) -> None:
    """One JSON object per question: question, answer, sources with clause_id and score, token_usage."""
    sources = F.transform("sources", lambda s: F.struct(s["clause_id"].alias("clause_id"), s["similarity_score"].alias("score")))
    none = F.array().cast("array<struct<clause_id:string,score:double>>")
    rows = answers.select(F.col("query").alias("question"), "answer", F.coalesce(sources, none).alias("sources"), F.col("usage").alias("token_usage"))
    rows.write.mode("overwrite").json(path)
