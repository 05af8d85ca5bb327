"""Dataset readers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import name_key, reference_answer, sample_key, strip
from engram.sources.documents import array_elements, large_arrays

QA = "ARRAY<STRUCT<question: STRING, answer: STRING, adversarial_answer: STRING, category: STRING, evidence: ARRAY<STRING>>>"
SAMPLE = f"sample_id STRING, conversation MAP<STRING, STRING>, qa {QA}"
ITEM = "question_id STRING, question STRING, answer STRING, question_type STRING, question_date STRING, haystack_dates ARRAY<STRING>, haystack_sessions ARRAY<ARRAY<STRUCT<role: STRING, content: STRING>>>"
DIALOG = "ARRAY<STRUCT<speaker: STRING, text: STRING, blip_caption: STRING>>"


def _documents(spark: SparkSession, path: str, shape: str, element: str) -> tuple[DataFrame, DataFrame | None]:
    """The documents of a path with their place (source_at), and the elements of large arrays, which are split over tasks; None where there are none.

    A file of one document that isn't large, or no array, is read by one task, in order.
    """
    split, whole = large_arrays(spark, path)
    file = F.col("_metadata.file_path") if whole else F.lit("")
    place = F.struct(file.alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("at"), F.lit(0).alias("nested"))
    raw = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(whole) if whole else spark.createDataFrame([], shape)
    raw = raw.withColumn("source_at", place)
    if not split:
        return raw, None
    found = array_elements(spark, split).withColumn("v", F.from_json("text", element, {"mode": "FAILFAST"}))
    return raw, found.select("v.*", F.struct("file", "block", "at", F.lit(0).alias("nested")).alias("source_at"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of session lists, with their place (source_at); malformed JSON raises."""
    rows, more = _documents(spark, path, ITEM, ITEM)
    return rows if more is None else rows.unionByName(more)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A list of samples or an object with ``samples``; anything else raises. A sample without an identifier gets one made of its content; source_at is its place."""
    shape = f"{SAMPLE}, samples ARRAY<STRUCT<sample_id: STRING, conversation: MAP<STRING, STRING>, qa: {QA}>>"
    raw, more = _documents(spark, path, shape, SAMPLE)
    nested = raw.where("samples IS NOT NULL").select("source_at", F.posexplode("samples").alias("n", "s"))
    nested = nested.select("s.*", F.struct("source_at.file", "source_at.block", "source_at.at", F.col("n").alias("nested")).alias("source_at"))
    rows = raw.where("samples IS NULL").drop("samples").unionByName(nested)
    rows = rows if more is None else rows.unionByName(more)
    known = F.when(F.col("conversation").isNull(), F.raise_error("neither a list of samples nor an object with samples")).otherwise(F.col("sample_id"))
    plain = F.transform_values("conversation", lambda _, v: F.coalesce(F.to_json(F.from_json(v, DIALOG)), v))  # however a nested document is spaced
    entries = F.to_json(F.array_sort(F.map_entries(plain)))
    return rows.withColumn("sample_id", F.coalesce(F.nullif(known, F.lit("")), sample_key(entries, F.to_json("qa"))))


def sessions(samples: DataFrame) -> DataFrame:
    """Dynamic session keys as rows, in numeric order; others last."""
    rows = samples.select("sample_id", "conversation", F.explode("conversation").alias("key", "body")).where("key RLIKE '^session_' AND NOT key LIKE '%\\_date\\_time'")
    number = F.coalesce(F.try_cast(F.substring("key", 9, 20), "int") if hasattr(F, "try_cast") else F.expr("try_cast(substring(key, 9) AS INT)"), F.lit(1_000_000_000))
    return rows.select("sample_id", number.alias("session_seq"), F.expr("conversation['speaker_a']").alias("speaker_a"), F.expr("try_element_at(conversation, concat(key, '_date_time'))").alias("ts"), F.from_json("body", DIALOG).alias("dialogs"))


def dialogs(samples: DataFrame) -> DataFrame:
    rows = sessions(samples).select("sample_id", "session_seq", "speaker_a", "ts", F.posexplode("dialogs").alias("pos", "d"))
    text = dialog_text(F.col("d.text"), F.col("d.blip_caption"))
    return rows.select("sample_id", "session_seq", "pos", "ts", (F.col("d.speaker") == F.col("speaker_a")).alias("is_user"), text.alias("text")).where("text <> ''")


def dialog_text(text, caption):
    text, caption = strip(F.coalesce(text, F.lit(""))), F.coalesce(caption, F.lit(""))
    note = F.concat(F.lit("[image: "), caption, F.lit("]"))
    return F.when(caption == "", text).when(text == "", note).otherwise(F.concat_ws(" ", text, note))


def questions(samples: DataFrame, most: int | None = None) -> DataFrame:
    """The questions of two-speaker samples in their order, at most ``most`` of each: sample_id, qa_index, question, answer, category, evidence."""
    rows = samples.select("sample_id", F.posexplode("qa").alias("qa_index", "q"))
    rows = rows if most is None else rows.where(F.col("qa_index") < most)
    answer = reference_answer(F.col("q.answer"), F.col("q.adversarial_answer"))
    return rows.select("sample_id", "qa_index", "q.question", F.coalesce(answer, F.lit("")).alias("answer"), "q.category", "q.evidence")


def read_graph_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs kept as one JSON document each, {nodes: {id: node}, edges: {src: {dst: weight}}}; graph_id is the file's name up to its first underscore."""
    node = "STRUCT<id: STRING, content: STRING, role: STRING, embedding: ARRAY<FLOAT>, timestamp: STRING, keywords: ARRAY<STRING>, metadata: MAP<STRING, STRING>>"
    shape = f"nodes MAP<STRING, {node}>, edges MAP<STRING, MAP<STRING, DOUBLE>>"
    raw = spark.read.schema(shape).option("multiLine", True).json(path).select(name_key(F.input_file_name()).alias("graph_id"), "nodes", "edges")
    n = raw.select("graph_id", F.explode("nodes").alias("node_id", "n"))
    seq = F.col("node_id").cast("long")
    nodes = n.select("graph_id", seq.alias("node_seq"), seq.alias("node_id"), "n.content", "n.role", F.col("n.timestamp").alias("ts"), "n.keywords", "n.embedding")
    e = raw.select("graph_id", F.explode("edges").alias("src", "to")).select("graph_id", F.col("src").cast("long").alias("src"), F.explode("to").alias("dst", "weight"))
    return nodes, e.select("graph_id", "src", F.col("dst").cast("long").alias("dst"), "weight")
