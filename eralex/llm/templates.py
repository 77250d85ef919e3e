"""Lines repeated across one source's documents, by fixed-depth template trees.

A line is parsed into words (lower case, one mark for each run of digits, everything else but letters
separates) and walks down a tree of fixed depth: its source, its number of words, its leading
word. A word that too few lines share has no child of its own; such lines go on in the
wildcard child. Each task counts the nodes of its own lines (the map side of an
aggregation) and the shuffle merges these partial trees by adding them. Leaves with
too few lines for a repeated one are cut off. In the leaves that remain a slot keeps the words that
enough lines share and is a wildcard for all others; the line's words and wildcards
are its template.

A template covers the documents in which any of its lines stands. Templates that cover enough
documents of their source, with at least half of their words and ``letters`` letters fixed, are
the result (``templates``), and their lines are what is removed (``covered_lines``). Where a stricter
rule is wanted, ``repeated_lines`` holds the lines of these templates against it: the same letters and marks, whatever
the spaces, in enough documents. Lines of equal letters but other spaces parse into other words; their
keys are kept as candidates beside those of the templates, so no such line is lost.

A node holds at least as many lines as a repeated line needs documents, so the tree has at most
lines / need nodes. No group is ever gathered: distinct documents are counted over
(source, template, document) first, so a line that stands in a third of all documents is spread over all tasks.

Defined results
* rows with a null or blank source, a null text or a null document belong to no source;
* lines are split at "\\n", counted from 1, blank lines included;
* repeated rows are reported each, and count once as a document;
* an empty table gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralex.runtime import cut, if_small

MARK, ANY = "#", "<*>"


def spaced(text: str | Column) -> Column:
    """The words of each line with one space between them; lines stay lines."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}0-9\n]+", " "), "[0-9]+", MARK)


def parsed_lines(df: DataFrame, row_id: str, doc: str, source: str, text: str, letters: int) -> DataFrame:
    """(row_id, line_no, doc, source, n_words, line, k1, k2): each countable line.

    k1 and k2 are two independent hashes of the source and the line's letters and marks without spaces.
    A text is parsed whole before it is cut into lines, so no line is parsed again for a filter.
    """
    lines = df.where(F.col(text).isNotNull() & F.col(doc).isNotNull() & (F.trim(source) != "")).select(
        F.col(row_id).alias("row_id"), F.col(doc).alias("doc"), F.col(source).alias("source"), F.posexplode(F.split(spaced(text), "\n")).alias("pos", "raw")
    )
    bare = lambda c, gone: F.replace(c, F.lit(gone), F.lit(""))
    key = bare(F.col("raw"), " ")
    counted = lines.where(F.length(bare(key, MARK)) >= letters).withColumn("line", F.trim("raw"))
    return counted.select(
        "row_id",
        (F.col("pos") + 1).cast("long").alias("line_no"),
        "doc",
        "source",
        (F.length("line") - F.length(key) + 1).alias("n_words"),
        "line",
        F.xxhash64("source", key).alias("k1"),
        F.xxhash64(F.lit(1), "source", key).alias("k2"),
    )


def source_sizes(df: DataFrame, doc: str, source: str, least: int, share: float) -> DataFrame:
    """(source, n_docs, need): distinct documents and the number that makes a line repeated."""
    docs = df.where(F.col(doc).isNotNull() & (F.trim(source) != "")).select(F.col(source).alias("source"), F.col(doc).alias("doc")).distinct()
    return docs.groupBy("source").agg(F.count("*").alias("n_docs")).withColumn("need", F.greatest(F.lit(least).cast("double"), F.col("n_docs") * F.lit(share)))


def _enough(counts: DataFrame, sizes: DataFrame, n: str) -> DataFrame:
    return counts.join(sizes.select("source", "need"), "source").where(F.col(n) >= F.col("need") - 1e-9).drop("need", n)


class Tree:
    """The merged tree of a table's lines, with the templates of the lines in its leaves."""

    def __init__(self, df: DataFrame, row_id: str, doc: str, source: str, text: str, letters: int = 12, least: int = 5, share: float = 0.03):
        self.lines = lines = cut(parsed_lines(df, row_id, doc, source, text, letters), "lines")
        self.sizes = sizes = if_small(cut(source_sizes(df, doc, source, least, share), "sizes"))
        word = F.substring_index("line", " ", 1)
        nodes = lines.groupBy("source", "n_words", word.alias("word")).agg(F.count("*").alias("n"))
        nodes = cut(nodes, "nodes")
        own = if_small(cut(_enough(nodes, sizes, "n"), "leads"))  # leading words with a child of their own
        rest = nodes.join(own, ["source", "n_words", "word"], "left_anti").groupBy("source", "n_words").agg(F.sum("n").alias("n"))
        leaves = if_small(cut(own.unionByName(_enough(rest, sizes, "n").withColumn("word", F.lit(ANY))), "leaves"))
        led = lines.withColumn("word", word).join(own.withColumn("own", F.lit(True)), ["source", "n_words", "word"], "left")
        placed = led.withColumn("word", F.when(F.col("own"), F.col("word")).otherwise(ANY)).drop("own").join(leaves, ["source", "n_words", "word"], "left_semi")
        slots = placed.select("source", "n_words", "word", F.posexplode(F.split("line", " ")).alias("slot", "w"))
        kept = _enough(slots.groupBy("source", "n_words", "word", "slot", "w").agg(F.count("*").alias("n")), sizes, "n")
        fixed = kept.groupBy("source", "n_words", "word").agg(F.collect_set(F.concat_ws(" ", F.col("slot").cast("string"), "w")).alias("fixed"))
        fixed = if_small(cut(fixed, "slots"))
        words = F.transform(F.split("line", " "), lambda w, i: F.when((w != MARK) & F.array_contains("fixed", F.concat_ws(" ", i.cast("string"), w)), w).otherwise(ANY))
        self.placed = placed.join(fixed, ["source", "n_words", "word"]).select("row_id", "line_no", "doc", "source", "k1", "k2", words.alias("words"))
        still = F.filter("words", lambda w: w != ANY)
        told = (2 * F.size(still) >= F.size("words")) & (F.length(F.array_join(still, "")) >= letters)
        self.placed = self.placed.where(told).select("row_id", "line_no", "doc", "source", "k1", "k2", F.array_join("words", " ").alias("template"))

    def covering(self) -> DataFrame:
        """(source, template, n_docs_with, n_lines) of templates that cover enough documents."""
        counts = self.placed.groupBy("source", "template", "doc").agg(F.count("*").alias("n")).groupBy("source", "template").agg(F.count("*").alias("n_docs_with"), F.sum("n").alias("n_lines"))
        return if_small(cut(counts.join(self.sizes, "source").where("n_docs_with >= need - 1e-9").drop("need"), "covering"))


def covered_lines(df: DataFrame, row_id: str, doc: str, source: str, text: str, **limits) -> DataFrame:
    """(row_id, line_no) of every line of a template that covers enough documents."""
    t = Tree(df, row_id, doc, source, text, **limits)
    return t.placed.join(t.covering().select("source", "template"), ["source", "template"], "left_semi").select("row_id", "line_no")


def repeated_lines(df: DataFrame, row_id: str, doc: str, source: str, text: str, **limits) -> DataFrame:
    """(row_id, line_no) of every line of such templates whose own letters and marks stand in enough documents."""
    t = Tree(df, row_id, doc, source, text, **limits)
    found = t.placed.join(t.covering().select("source", "template"), ["source", "template"], "left_semi").select("k1", "k2")
    shape = F.xxhash64("line")
    respaced = t.lines.groupBy("k1", "k2").agg(F.min(shape).alias("a"), F.max(shape).alias("b")).where("a <> b").select("k1", "k2")
    keys = if_small(cut(found.unionByName(respaced).distinct(), "keys"))
    candidates = t.lines.join(keys, ["k1", "k2"], "left_semi")
    counts = candidates.select("source", "k1", "k2", "doc").distinct().groupBy("source", "k1", "k2").agg(F.count("*").alias("n"))
    repeated = if_small(cut(_enough(counts, t.sizes, "n").select("k1", "k2"), "repeated"))
    return t.lines.join(repeated, ["k1", "k2"], "left_semi").select("row_id", "line_no")


def templates(df: DataFrame, row_id: str, doc: str, source: str, text: str, **limits) -> DataFrame:
    """(source, template, n_docs, n_lines, share): templates that cover enough documents of their source."""
    t = Tree(df, row_id, doc, source, text, **limits)
    return t.covering().select("source", "template", F.col("n_docs_with").alias("n_docs"), "n_lines", F.round(F.col("n_docs_with") / F.col("n_docs"), 6).alias("share"))


def without_lines(df: DataFrame, gone: DataFrame, row_id: str, text: str) -> DataFrame:
    """All rows with (row_id, clean_text, n_removed), without the lines of ``gone`` (row_id, line_no).

    ``row_id`` must be unique; the text is null where it was null.
    """
    gone = gone.groupBy("row_id").agg(F.collect_set("line_no").alias("gone"))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("n"), x.alias("t")))
    left = F.filter(lines, lambda x: ~F.array_contains("gone", x["n"]))
    clean = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda x: x["t"]), "\n"))
    return df.select(F.col(row_id).alias("row_id"), text).join(gone, "row_id", "left").select("row_id", clean.alias("clean_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def without_repeated_lines(df: DataFrame, row_id: str, doc: str, source: str, text: str, **limits) -> DataFrame:
    return without_lines(df, repeated_lines(df, row_id, doc, source, text, **limits), row_id, text)


def without_covered_lines(df: DataFrame, row_id: str, doc: str, source: str, text: str, **limits) -> DataFrame:
    return without_lines(df, covered_lines(df, row_id, doc, source, text, **limits), row_id, text)
