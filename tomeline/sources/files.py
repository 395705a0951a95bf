"""Files as tables: Markdown folders with front matter, retrieval benchmarks, and partitioned page output.

A file without a front-matter block is all body; a broken block (no closing line) counts as body too. Titles come from the
front matter, else the first heading, else the file's name. Empty folders give empty tables; a missing path is Spark's error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

BLOCK = r"(?s)\A\x{feff}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
TITLES, LINES, WORDS = ("title", "name"), ("description", "summary", "one_line"), ("keywords", "tags")


def _field(block: Column, names: tuple[str, ...]) -> Column:
    """The first filled field of those names."""
    one = lambda n: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?im)^{n}[ \t]*:[ \t]*(.*)$", 1), r"^[\"']|[\"']\s*$|\r", "")), F.lit(""))
    return F.coalesce(*[one(n) for n in names])


def front_matter(df: DataFrame, text: str) -> DataFrame:
    """Adds title, one_line (120 characters), keywords (six at most) and body."""
    block = F.regexp_extract(text, BLOCK, 1)
    words = F.split(F.regexp_replace(_field(block, WORDS), r"^\[|\]$", ""), r"\s*,\s*")
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*\r?$", 1)), F.lit(""))
    return df.withColumns({
        "title": F.coalesce(_field(block, TITLES), heading),
        "one_line": F.substring(_field(block, LINES), 1, 120),
        "keywords": F.slice(F.filter(words, lambda w: F.length(w) > 0), 1, 6),
        "body": F.regexp_replace(F.regexp_replace(text, BLOCK, ""), r"^\s+|\s+$", ""),
    })


def human_name(stem: Column) -> Column:
    """A folder's or file's name as a title: without its priority (P0_), with blanks, the first letter large."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(stem, r"^P\d+[_\- ]+", ""), r"[_\-]+", " "))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1_000))


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """shelf, book, priority, ord, file, title, one_line, keywords, body of every Markdown file below a folder.

    The file's folder is its book and the one above, if below the root, its shelf; files are numbered by name in a book."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    depth = len([p for p in folder.split("://")[-1].split("/") if p])
    below = F.filter(parts, lambda p: (F.length(p) > 0) & ~p.rlike("^[a-z0-9]+:$"))
    tree = front_matter(files.withColumn("p", F.slice(below, depth + 1, 1_000)), "value")
    folder_at = lambda back: F.try_element_at("p", F.when(F.size("p") > back, -(back + 1)).otherwise(F.lit(1_001)).cast("int"))
    stem = F.regexp_replace(F.element_at("p", -1), r"\.md$", "")
    book = folder_at(1)
    out = tree.select(
        human_name(folder_at(2)).alias("shelf"), human_name(book).alias("book"), F.nullif(F.regexp_extract(F.coalesce(book, F.lit("")), r"^(P\d+)[_\- ]", 1), F.lit("")).alias("priority"), F.array_join("p", "/").alias("file"), F.coalesce("title", human_name(stem)).alias("title"), "one_line", "keywords", "body"
    )
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("shelf", "book").orderBy("file")))


def benchmark(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(doc, text), queries(qid, query), qrels(qid, doc, grade) of a folder in the JSON-lines and TSV layout common
    to retrieval benchmarks; queries without a judgement are left out."""
    fields = lambda *names: StructType.fromDDL(", ".join(f"`{n}` string" for n in names))
    qrels = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="qid string, doc string, grade int")
    corpus = spark.read.schema(fields("_id", "title", "text")).json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc"), F.trim(F.concat_ws(" ", "title", "text")).alias("text"))
    queries = spark.read.schema(fields("_id", "text")).json(f"{folder}/queries.jsonl").select(F.col("_id").alias("qid"), F.col("text").alias("query"))
    return corpus, queries.join(qrels.select("qid"), "qid", "left_semi"), qrels


def missing_only(wanted: DataFrame, kept: DataFrame, text: str) -> DataFrame:
    """Rows of wanted whose text has no row in kept(sha): what a cache keyed by content still has to compute."""
    keyed = wanted.withColumn("sha", F.sha1(F.col(text).cast("binary")))
    return keyed.dropDuplicates(["sha"]).join(kept.select("sha"), "sha", "left_anti")


def write_pages(pages: DataFrame, path: str, by: str = "book_id") -> None:
    """Pages as Parquet, a folder for each value of by; a hot value is spread over several files by a hash of the page."""
    pages.repartition(F.col(by), F.pmod(F.xxhash64("page_id"), F.lit(8))).write.partitionBy(by).mode("overwrite").parquet(path)
