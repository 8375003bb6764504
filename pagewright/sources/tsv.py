"""Tab separated output of an external recogniser: pages, words, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions.text import line_id, utrim, word_id

#: Fixed column order of the format.
INTS = {"level": 1, "page": 2, "block": 3, "par": 4, "line": 5}
NUMBERS = {"left": 7, "top": 8, "width": 9, "height": 10, "conf": 11}
COLUMNS = 12


def _number(raw: Column, kind: str) -> Column:
    """A number without white space around it, else null."""
    plain = raw.rlike("^[+-]?[0-9]+$") if kind == "int" else raw.rlike(r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan)$")
    return F.when(plain, raw.try_cast(kind))


def read_tsv_lines(documents: DataFrame, key: str = "image_id", tsv: str = "tsv") -> DataFrame:
    """One row a data line: key, position (1-based line number), the parsed columns, text, and error.

    The first line and blank lines are skipped; the last column keeps tabs. A line with too few columns or with a
    column that is no number has an error and no values.
    """
    lines = documents.select(key, F.posexplode(F.split(tsv, "\r?\n")).alias("n", "line")).filter((F.col("n") > 0) & F.col("line").rlike(r"(?U)\S"))
    lines = lines.select(key, (F.col("n") + 1).alias("position"), "line", F.split("line", "\t", COLUMNS).alias("cells"))
    # a line of plain numbers is told by one expression; any other goes through each column's own
    row = F.when(F.col("line").rlike(_PLAIN), _plain_line(F.col("cells"))).otherwise(F.get(F.transform(F.transform(F.array("cells"), _parse_line), _check_line), F.lit(0)))
    # generated, so that later filters do not parse the columns again
    lines = lines.select(key, "position", F.inline(F.array(row)))
    error = F.when(F.col("width_in_columns") < COLUMNS, F.format_string("line %d: expected 12 columns", "position")).when(
        F.col("bad").isNotNull(), F.format_string("line %d: invalid %s", "position", "bad")
    )
    return lines.withColumn("error", error).drop("width_in_columns", "bad")


def _parse_line(c: Column) -> Column:
    """The columns of one split line."""
    cell = lambda i: F.get(c, F.lit(i - 1))
    values = {k: _number(cell(i), "int") for k, i in INTS.items()} | {k: _number(cell(i), "double") for k, i in NUMBERS.items()}
    return F.struct(F.size(c).alias("width_in_columns"), *[v.alias(k) for k, v in values.items()], cell(COLUMNS).alias("text"))


#: Twelve columns, of which those with numbers hold few digits and at most one point.
_PLAIN = r"^[0-9]{1,9}(?:\t[0-9]{1,9}){4}\t[^\t]*(?:\t-?[0-9]{1,9}(?:\.[0-9]{1,9})?){5}\t"


def _plain_line(c: Column) -> Column:
    """The same of a line that _PLAIN holds for."""
    cell = lambda i: F.get(c, F.lit(i - 1))
    values = [cell(i).cast("int").alias(k) for k, i in INTS.items()] + [cell(i).cast("double").alias(k) for k, i in NUMBERS.items()]
    return F.struct(F.lit(COLUMNS).alias("width_in_columns"), *values, cell(COLUMNS).alias("text"), F.lit(None).cast("string").alias("bad"))


def _check_line(row: Column) -> Column:
    """The line with the first of the columns it needs that is no number: words need more of them."""
    first = lambda names: F.coalesce(*[F.when(row[k].isNull(), F.lit(k)) for k in names])
    always = first(("level", "left", "top", "width", "height"))
    return row.withField("bad", F.coalesce(always, F.when(row["level"] == 5, first(("conf", "page", "block", "par", "line")))))


def tsv_pages(rows: DataFrame, key: str = "image_id") -> DataFrame:
    """Size of each page: the last line of level 1, negative sizes as 0."""
    last = rows.filter((F.col("level") == 1) & F.col("error").isNull()).groupBy(key)
    size = lambda c: F.greatest(F.max_by(c, "position"), F.lit(0.0)).alias(c)
    return last.agg(size("width"), size("height"))


def tsv_words(rows: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Words (level 5) that are not blank and certain enough; confidence as a share of 1."""
    share = F.col("conf") / 100
    kept = rows.filter((F.col("level") == 5) & F.col("error").isNull() & (utrim(F.col("text")) != ""))
    kept = kept.filter(~((F.col("conf") < 0) | (share < min_confidence)) | F.isnan("conf"))
    return kept.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def tsv_text_lines(words: DataFrame, key: str = "image_id") -> DataFrame:
    """Words of a (block, par, line) as one line: box, text in file order, confidence weighted by word lengths.

    Ids are numbered by the group's rank; words (array of id, text, confidence, box) by file order.
    """
    weight = F.greatest(F.char_length("text"), F.lit(1))
    entry = F.struct("position", utrim(F.col("text")).alias("text"), "confidence", "left", "top", "width", "height")
    lines = words.groupBy(key, "page", "block", "par", "line").agg(
        F.min("left").alias("x"),
        F.min("top").alias("y"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"),
        F.array_sort(F.collect_list(entry)).alias("words"),
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("page", "block", "par", "line"))
    lines = lines.withColumn("position", rank).withColumn("line_id", line_id(F.col("position")))
    lines = lines.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))
    named = F.transform("words", lambda w, i: w.withField("id", word_id(F.col("line_id"), i + 1)))
    return lines.withColumn("words", named)


def version_line(output: Column) -> Column:
    """First line of a version report."""
    return F.trim(F.get(F.split(output, "\r?\n"), F.lit(0)))


def installed_languages(output: Column) -> Column:
    """Language codes of a list report, without its heading and blank lines."""
    lines = F.transform(F.split(output, "\r?\n"), utrim)
    return F.filter(lines, lambda s: (s != "") & ~s.startswith("List of available"))
