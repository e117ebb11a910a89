"""Corpus sources: plain lines, framed articles, encyclopaedia dumps; and the stored index."""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import markup

#: Times a title counts (fixed value).
TITLE_WEIGHT = 10
#: Of a stored index and of shards: sorted texts and their keys, and chains in the order of a text, take much less place with it than with Spark's usual one.
INDEX_CODEC = "zstd"
BEGIN, END, DOC, DOC_END = "BEGIN ARTICLE:", "END ARTICLE:", "<doc ", "</doc>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of every line of text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line_no and ``line`` of every line of text files.

    A block is a part of a file that one task reads, named by where it begins; lines are numbered inside it.  Both grow
    along the file, with gaps.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return rows.withColumn("line_no", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).select("file", "block", "line_no", "line")


def lines_of(docs: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """``line`` of every line of a column of texts, with the columns ``keep``."""
    return docs.select(*keep, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))


def frame_articles(lines: DataFrame, file_col: str = "file", order_col: str = "line_no", line_col: str = "line", block_col: str | None = None) -> DataFrame:
    """file (and block), line_no, line, is_title and weight of the lines that count.

    ``BEGIN ARTICLE:`` lines hold a title after the mark, ``END ARTICLE:`` lines go.  ``<doc `` and ``</doc>`` lines
    go, and the line after ``<doc `` is a title whatever it is, but for other framing lines, which leave it to the next.
    Titles count TITLE_WEIGHT times.

    With ``block_col`` no task has more than a block of a file: what a block leaves to the next is one row of a small table.
    """
    line = F.coalesce(F.col(line_col), F.lit(""))
    kind = F.when(line.startswith(BEGIN), "begin").when(line.startswith(END), "end").when(line.startswith(DOC), "doc").otherwise("text")
    block = F.lit(0) if block_col is None else F.col(block_col)
    rows = lines.select(F.col(file_col).alias("file"), block.alias("block"), F.col(order_col).alias("line_no"), line.alias("line")).withColumn("kind", kind)
    # The last line before that is a <doc line or took the flag; framing lines in between keep it.
    decides = F.when(F.col("kind").isin("doc", "text"), F.col("kind"))
    past = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(decides, ignorenulls=True).over(past("file", "block", "line_no"))
    if block_col is not None:
        ends = rows.groupBy("file", "block").agg(F.max(F.when(decides.isNotNull(), F.struct("line_no", "kind")))["kind"].alias("end"))
        left = ends.select("file", "block", F.last("end", ignorenulls=True).over(past("file", "block")).alias("left"))
        rows = rows.join(left, ["file", "block"])
        last = F.coalesce(last, F.col("left"))
    rows = rows.withColumn("flag", F.coalesce(last == "doc", F.lit(False)))
    title = (F.col("kind") == "begin") | (F.col("flag") & (F.col("kind") == "text"))
    dropped = F.col("kind").isin("end", "doc") | (~F.col("flag") & F.col("line").startswith(DOC_END))
    text = F.when(F.col("kind") == "begin", F.expr(f"substr(line, {len(BEGIN) + 1})")).otherwise(F.col("line"))
    kept = ["file", "line_no"] if block_col is None else ["file", "block", "line_no"]
    return rows.filter(~dropped).select(*kept, text.alias("line"), title.alias("is_title"), F.when(title, TITLE_WEIGHT).otherwise(1).alias("weight"))


def read_doc_blocks(spark: SparkSession, path: str) -> DataFrame:
    """title and text of every ``<doc ...>`` block of extractor output; blocks need no order between them."""
    block = F.col("value")
    body = F.regexp_extract(block, r"(?s)<doc [^\n]*\n(.*)", 1)
    rows = spark.read.option("lineSep", DOC_END).text(path).filter(block.contains(DOC))
    return rows.select(F.substring_index(body, "\n", 1).alias("title"), F.expr("substr({0}, length(substring_index({0}, '\n', 1)) + 2)".format("regexp_extract(value, '(?s)<doc [^\\n]*\\n(.*)', 1)")).alias("text"))


def read_xml_dump(spark: SparkSession, path: str) -> DataFrame:
    """title and text of every ``<page>`` of a dump; pages without a title or a text go.

    Pages are parted at their end, so a file is read in as many parts as there are blocks of it, whatever is around them.
    """
    schema = "title STRING, revision STRUCT<text: STRUCT<_VALUE: STRING>>"
    raw = spark.read.option("lineSep", "</page>").text(path).select(F.regexp_extract("value", r"(?s)<page[\s>].*", 0).alias("page")).filter("page <> ''")
    page = F.from_xml(F.concat("page", F.lit("</page>")), schema)
    return with_text(raw.select(page.alias("p")).select("p.title", F.col("p.revision.text._VALUE").alias("text")))


def with_text(pages: DataFrame) -> DataFrame:
    """Pages that have a title and a text and are no redirects."""
    return pages.filter((F.col("title") != "") & (F.col("text") != "") & ~markup.is_redirect(F.col("text")))


def articles_to_lines(pages: DataFrame, link_text: str = "target") -> DataFrame:
    """line and weight of pages (title, text): markup removed, the title first."""
    body = lines_of(markup.strip_markup(pages.select("text"), "text", link_text)).withColumn("weight", F.lit(1))
    return pages.select(F.col("title").alias("line"), F.lit(TITLE_WEIGHT).alias("weight")).unionByName(body)


def save_shards(counted: DataFrame, path: str, shard_col: str) -> None:
    """Write chain counts (shard, chain, n) as one folder a shard; never over others."""
    counted.select(F.col(shard_col).alias("shard"), "chain", "n").write.mode("errorifexists").option("compression", INDEX_CODEC).partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """chain and n of stored shards, whole folders of them or single ones; warns of those that are empty."""
    if not paths:
        raise ValueError("at least one path must be given")
    found = [spark.read.schema("chain string, n long").option("recursiveFileLookup", "true").parquet(p) for p in paths]
    for path, shard in zip(paths, found, strict=True):
        if shard.isEmpty():
            warnings.warn(f"{path} has no chains", stacklevel=2)
    return reduce(DataFrame.unionByName, found)


def save_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write an index sorted by text in files split by first character; never over another one by default."""
    # Finding the ranges takes a pass of its own, so the index is computed before, once.
    held = session.written(index, "unsorted")
    held.repartitionByRange("text").sortWithinPartitions("text").write.mode(mode).option("compression", INDEX_CODEC).partitionBy("first_ch").parquet(path)
    session.drop_written(held)


def save_ranged_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``save_index`` of an index of which each partition has a range of texts, as ``build_index`` gives it."""
    index.sortWithinPartitions("first_ch", "text").write.mode(mode).option("compression", INDEX_CODEC).partitionBy("first_ch").parquet(path)


def save_index_rounds(indexes: list[DataFrame], path: str) -> None:
    """``save_ranged_index`` of an index in several ranges of texts, as ``index_rounds`` gives it; never over another one.

    A range's shuffle files go before the next one is computed.  The folder has its name when all are there.
    """
    spark = indexes[0].sparkSession
    if session.exists(spark, path):
        raise FileExistsError(path)
    making = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    try:
        with session.shuffles_dropped(spark):
            for index in indexes:
                save_ranged_index(index, making, "append")
        session.rename(spark, making, path)
    except BaseException:
        session.remove(spark, making)
        raise


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("first_ch", F.col("first_ch").cast("string"))


def result_lines(results: DataFrame) -> Column:
    """A search result (score, text) as a line of output."""
    from lexiloom.functions.text import formatted_score

    return F.concat_ws(" ", formatted_score(results["score"]), F.rtrim(results["text"]))
