"""Sources: every input format as a DataFrame, with its schema stated so that no pass infers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X


def _json(spark: SparkSession, path, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def corpus(spark: SparkSession, path, context_only: bool = True) -> DataFrame:
    """``title, par_idx, context``: no-break spaces become spaces, titles lose underscores."""
    return reading(spark, path, context_only=True) if context_only else reading(spark, path)


def reading(spark: SparkSession, path, context_only: bool = False, lines: bool | None = None) -> DataFrame:
    """Articles, paragraphs and questions; a ``.jsonl`` path has one article collection on each line.

    Paragraphs flagged as none are dropped. Questions carry ``impossible``, the first answer and all.
    """
    lines = str(path).endswith(".jsonl") if lines is None else lines
    raw = _json(spark, path, schemas.READING, lines).select(F.explode("data").alias("a"))
    pars = raw.select(X.plain_title(F.col("a.title")).alias("title"), F.posexplode("a.paragraphs").alias("par_idx", "p")).where(F.coalesce(F.col("p.is_paragraph"), F.lit(True)))
    base = pars.select("title", "par_idx", X.plain_spaces(F.col("p.context")).alias("context"), F.col("p.qas").alias("qas"))
    if context_only:
        return base.drop("qas")
    q = base.select("title", "par_idx", "context", F.posexplode("qas").alias("qa_idx", "q"))
    impossible = F.coalesce(F.col("q.is_impossible"), F.size("q.answers") <= 0)
    answer = F.get("q.answers", F.lit(0))
    return q.select("title", "par_idx", "context", "qa_idx", F.col("q.id").alias("id"), X.strip_question(F.col("q.question")).alias("question"), impossible.alias("impossible"), X.plain_spaces(answer["text"]).alias("answer"), answer["answer_start"].alias("answer_start"), F.col("q.answers").alias("answers"))


def generated(spark: SparkSession, path) -> DataFrame:
    """Generated questions, one JSON object on each line."""
    return _json(spark, path, schemas.GENERATED, True)


def _line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``row`` from 0 and ``value`` of a file's lines. Each split of the file is numbered on its own, from the
    lines of the splits before it."""
    from pyspark.sql.window import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row for each split
    before = counts.select("split", "first", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("before"))
    return lines.join(F.broadcast(before), "split").select((F.col("before") + F.col("at") - F.col("first")).alias("row"), "value")


def round_robin(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of several files by turns until the shortest ends: ``at`` from 0, ``value``."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, [_line_numbers(spark, p).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)])
    shortest = both.groupBy("shard").agg(F.count("*").alias("n")).agg(F.when(F.count("*") == len(paths), F.min("n")).otherwise(0).alias("n"))
    kept = both.crossJoin(F.broadcast(shortest)).where("row < n")
    return kept.select((F.col("row") * len(paths) + F.col("shard")).alias("at"), "value")


def passages(spark: SparkSession, path) -> DataFrame:
    """Tab-separated passages with a header."""
    return spark.read.schema(schemas.PASSAGES).csv(path, sep="\t", header=True, quote="")


def bucketed_passages(spark: SparkSession, path, passage_id: int | None = None, width: int = 1_000_000) -> DataFrame:
    """Passages by bucket of ids; with an id only its bucket is read."""
    rows = spark.read.parquet(path)
    if passage_id is None:
        return rows
    return rows.where((F.col("bucket") == (passage_id - 1) // width) & (F.col("id") == passage_id))


def lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def candidates(spark: SparkSession, path) -> DataFrame:
    """Distinct candidate answers, trimmed and in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("candidate")).distinct()


def questions(spark: SparkSession, path, lower: bool = False, seed: int | None = None, draft: int | None = None, casing: dict[str, DataFrame] | None = None) -> DataFrame:
    """Question-answer pairs: id with origin, entity window, without empty answers, one ``?`` less, lower
    case, seeded order, draft limit, true case of questions all in lower case from tables of ``truecasing.counts``: in this
    order."""
    from ..operators import truecasing
    from ..operators.sampling import draw

    rows = _json(spark, path, schemas.QUESTIONS, False).select(F.explode("data").alias("q")).select("q.*")
    rows = rows.withColumn("id", X.prefixed_id(F.col("id"), F.col("origin"))).withColumn("question", X.entity_window(F.col("question")))
    rows = rows.where(F.size("answers") > 0).withColumn("question", X.strip_question(F.col("question")))
    rows = rows.withColumn("titles", F.coalesce("titles", F.array(F.lit(""))))
    if lower:
        rows = rows.withColumn("question", F.lower("question"))
    if seed is not None:
        rows = rows.orderBy(draw("id", seed=seed))
    if draft is not None:
        rows = rows.limit(draft)
    if casing is not None:
        cased = truecasing.truecased(rows.where(X.only_lower(F.col("question"))), casing, "id", "question").dropDuplicates(["id"])
        rows = rows.join(cased, "id", "left").withColumn("question", F.coalesce("cased", "question")).drop("cased")
    return rows


def provenance(spark: SparkSession, path) -> DataFrame:
    return _json(spark, path, schemas.PROVENANCE, True)


def valid_provenance(rows: DataFrame) -> DataFrame:
    """Records with an id, an input and at least one output that has an answer or provenance."""
    some = F.exists("output", lambda o: o["answer"].isNotNull() | (F.size(o["provenance"]) > 0))
    return rows.where(F.col("id").isNotNull() & F.col("input").isNotNull() & some)


def results(spark: SparkSession, path, lines_: bool | None = None) -> DataFrame:
    """Passage results as JSON or JSON lines."""
    by_line = str(path).endswith(".jsonl") if lines_ is None else lines_
    return _json(spark, path, schemas.PASSAGE_RESULTS, by_line)


def articles(spark: SparkSession, path) -> DataFrame:
    """Extracted articles in a tree of folders, one JSON object on each line."""
    return spark.read.option("recursiveFileLookup", True).schema(schemas.ARTICLES).json(path)


def natural_questions(spark: SparkSession, path) -> DataFrame:
    """Compressed lines of a fixed schema, so that nothing is read before it is needed; fields that a file lacks
    are null."""
    return spark.read.schema(schemas.NATURAL).json(path)


def phrase_dump(spark: SparkSession, path, first: int | None = None, last: int | None = None) -> DataFrame:
    """A phrase dump, or the documents ``first <= doc_idx < last`` of it: folders of a thousand are pruned."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.where((F.col("doc_shard") >= first // 1000) & (F.col("doc_idx") >= first))
    if last is not None:
        rows = rows.where((F.col("doc_shard") <= (last - 1) // 1000) & (F.col("doc_idx") < last))
    return rows


def labelled(spark: SparkSession, path, names: list[str], sep: str = "\t", header: bool = False) -> DataFrame:
    """A table of texts for classification."""
    return spark.read.schema(", ".join(f"`{n}` STRING" for n in names)).csv(path, sep=sep, header=header)


#: Adapters of question formats to id, question, answers.
def adapt(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a known format as ``id, question, answers``; answers trimmed, distinct, not empty.

    ``pairs``: question, answer (array); ``columns``: question, answers (array); ``relation``: input, output
    of provenance records; ``single``: question, answer (string); ``reading``: id, question, answers (structs);
    ``lines``: value, a question without answers; ``literal``: question, answers as a written list of strings.
    """
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, lambda a: F.trim(a)), lambda a: a != ""))
    made = F.sha2("question", 256)
    if kind == "pairs":
        return rows.select(made.alias("id"), "question", clean(F.col("answer")).alias("answers"))
    if kind == "columns":
        return rows.select(made.alias("id"), "question", clean(F.col("answers")).alias("answers"))
    if kind == "relation":
        return rows.select("id", F.replace(F.col("input"), F.lit(" [SEP] "), F.lit(" ")).alias("question"), clean(F.transform("output", lambda o: F.coalesce(o["answer"], F.lit("")))).alias("answers"))
    if kind == "single":
        return rows.select(made.alias("id"), "question", clean(F.array("answer")).alias("answers"))
    if kind == "reading":
        return rows.select("id", "question", clean(F.transform("answers", lambda a: a["text"])).alias("answers"))
    if kind == "lines":
        q = F.trim("value")
        return rows.select(F.sha2(q, 256).alias("id"), q.alias("question"), F.array(F.lit("")).alias("answers"))
    if kind == "literal":
        return rows.select(made.alias("id"), "question", clean(written_list(F.col("answers"))).alias("answers"))
    raise ValueError(kind)


def written_list(text: Column) -> Column:
    """The strings of a list as it is written in source text, in either kind of quotes, with escaped ones."""
    quoted = F.regexp_extract_all(text, F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    return F.transform(quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))


def title_ids(spark: SparkSession, path) -> DataFrame:
    """``title, wikipedia_id`` from one JSON object that maps titles to ids."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    return rows.select(F.explode("m").alias("title", "wikipedia_id"))


def database_texts(spark: SparkSession, path: str, table: str = "documents", partitions: int = 8) -> DataFrame:
    """``id, text`` of a SQLite table, by ranges of its row numbers: every task reads its own range from a file
    that all executors can open. Filters on ``id`` are applied to what was read."""

    def read(batches):
        import sqlite3

        import pyarrow as pa

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            for b in batches:
                for part in b.column("id").to_pylist():
                    if low is None:
                        continue
                    step = -(-(high - low + 1) // partitions)
                    found = db.execute(f"SELECT id, text FROM {table} WHERE rowid >= ? AND rowid < ?", (low + part * step, low + (part + 1) * step))
                    while rows := found.fetchmany(1000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["id", "text"])

    return spark.range(0, partitions, 1, partitions).mapInArrow(read, "id string, text string")
