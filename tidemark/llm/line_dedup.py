"""Line dedup by a log-template tree of fixed depth.

A line descends the tree by its number of tokens and then by its first ``LEADING`` tokens; tokens with a digit count as
the variable field ``<*>``.  In a leaf, a token stays constant at its position if lines of at least ``MIN_DOCS``
documents hold it there, and becomes ``<*>`` otherwise.  What results is the line's template.  A template with constants
in at least half its positions that lines of ``MIN_DOCS`` documents share is recurring, and its lines are dropped.

Documents are counted, not lines.  A leaf seen in fewer documents cannot hold a recurring template, so only lines of
frequent leaves are looked at closely, and each distinct masked line once, with its number of documents.  Adding these up
counts a document twice where it holds several different lines of one leaf; such lines are few, and what they count too
often is taken off again.  So no token moves with its document but theirs.

Texts are read once for the leaves of their lines, which takes no more than the number of tokens and the first few, and
once more for the lines of frequent leaves; only these are masked whole.  Counts combine on the map side.  What is joined
to all lines is a leaf's hash; it is broadcast only where a count has shown it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, sized, written

LEADING = 3
MIN_DOCS = 10
FIELD = "<*>"
#: White space inside a line, but for the space itself.
_BLANK = r"[\t\x0B\f\r]"


def _lines(text: Column) -> Column:
    """The lines of a text, with spaces as their only white space, so that tokens are split off without a search."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, " "), "\n")


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _masked(tokens: Column) -> Column:
    """Tokens with variable fields masked."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), FIELD).otherwise(t))


def _leaf(line: Column) -> Column:
    """A hash of the number of tokens and the masked first ones; null for a blank line."""
    return let(_tokens(line), lambda t: F.when(F.size(t) > 0, F.xxhash64(F.size(t), _masked(F.slice(t, 1, LEADING)))))


def _excess(several: DataFrame, keys: list[str]) -> DataFrame:
    """How many times too often the sum over lines counts documents under each of ``keys``."""
    per_doc = several.groupBy("row", *keys).agg((F.count("*") - 1).alias("excess")).where("excess > 0")
    return per_doc.groupBy(*keys).agg(F.sum("excess").alias("excess"))


def _often(counted: DataFrame, several: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """The ``keys`` that lines of ``min_docs`` documents share; ``counted`` has the documents of each line (docs)."""
    sums = counted.groupBy(*keys).agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs)
    sums = sums.join(_excess(several, keys), keys, "left")
    return sums.where(F.col("n") - F.coalesce("excess", F.lit(0)) >= min_docs).select(*keys)


def frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, key (of the text), row, i, leaf, line (hash), masked: the lines of leaves seen in ``min_docs`` documents.

    A row of ``df`` is a document.
    """
    leaves = df.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), _leaf))).alias("leaf")).where("leaf IS NOT NULL")
    leaves = written(leaves.groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
    # the row's number is given before its lines are dealt out
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("row"), _lines(F.col(text_col)).alias("lines"))
    places = rows.select("doc_id", "key", "row", F.posexplode("lines").alias("i", "text")).withColumn("leaf", _leaf(F.col("text")))
    found = places.join(sized(leaves), "leaf", "left_semi").withColumn("masked", F.array_join(_masked(_tokens(F.col("text"))), " "))
    return written(found.select("doc_id", "key", "row", "i", "leaf", F.xxhash64("masked").alias("line"), "masked"))


def recurring_lines(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, line) hashes of the masked lines of ``frequent_lines`` whose template recurs."""
    # each document's different lines, with their number in the leaf
    held = found.select("row", "leaf", "line").repartition("row").distinct()
    held = written(held.withColumn("beside", F.count("*").over(Window.partitionBy("row", "leaf"))))
    several = held.where("beside > 1").drop("beside")
    docs = held.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    distinct = found.select("leaf", "line", "masked").distinct().join(docs, ["leaf", "line"])
    distinct = written(distinct.select("leaf", "line", "docs", F.split("masked", " ").alias("tokens")))
    place = F.posexplode(F.slice("tokens", LEADING + 1, 1 << 30)).alias("place", "token")
    placed = distinct.select("leaf", "line", "docs", place).where(F.col("token") != FIELD)
    several_placed = several.join(distinct.drop("docs"), ["leaf", "line"]).select("row", "leaf", place).where(F.col("token") != FIELD)
    constant = _often(placed, several_placed, ["leaf", "place", "token"], min_docs)
    kept = distinct.select("leaf", "line", place).join(constant.withColumn("constant", F.lit(True)), ["leaf", "place", "token"], "left")
    rest = kept.groupBy("leaf", "line").agg(
        F.array_sort(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("token")))).alias("rest")
    )
    templates = distinct.join(rest, ["leaf", "line"], "left")
    template = F.concat(F.slice("tokens", 1, LEADING), F.coalesce(F.transform("rest", lambda x: x.token), F.array().cast("array<string>")))
    templates = templates.select("leaf", "line", "docs", template.alias("template"))
    templates = templates.where(2 * F.size(F.filter("template", lambda x: x != FIELD)) >= F.size("template"))
    lines = written(templates.select("leaf", "line", "docs", F.xxhash64("template").alias("template")))
    often = _often(lines, several.join(lines.drop("docs"), ["leaf", "line"]), ["leaf", "template"], min_docs)
    return lines.join(often, ["leaf", "template"], "left_semi").select("leaf", "line").distinct()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_text (the other lines, joined by \\n).

    Blank lines never recur.  Null text is one blank line.  Each row counts as a document, repeated rows too; null ids
    are equal.  Very long texts and lines are read whole.  An empty table gives an empty result; other columns are not
    read.
    """
    places = frequent_lines(df, id_col, text_col, min_docs)
    dropped = written(recurring_lines(places, min_docs))
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    # repeated rows of one id and text would name a line twice: a set
    gone = places.join(sized(dropped), ["leaf", "line"], "left_semi").groupBy("doc_id", "key").agg(F.collect_set("i").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "gone")
    found = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (docs["key"] == gone["__key"]), "left")
    none = F.array().cast("array<int>")

    def cut(lines: Column) -> Column:
        # a mark before each line that goes, then the lines that no mark stands before
        marks = F.transform(F.coalesce("gone", none), lambda i: F.struct(i.alias("i"), F.lit(0).alias("is_line"), F.lit("").alias("line")))
        entries = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("is_line"), x.alias("line")))
        stays = lambda s: F.filter(s, lambda x, j: (x.is_line == 1) & F.coalesce(F.get(s, j - 1).is_line == 1, F.lit(True)))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), F.transform(let(F.array_sort(F.concat(marks, entries)), stays), lambda x: x.line).alias("kept"))

    parts = found.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), let(F.split("text", "\n"), cut).alias("c"))
    return parts.select("doc_id", "c.n_lines", "n_removed", F.array_join("c.kept", "\n").alias("kept_text"))
