"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns propose spans. The hash of each span's value is counted over the whole corpus: how many repositories and
how many owners hold it. A value that several owners hold is a copied example (a sample key of some manual); a
value of one owner that looks random is live. The patterns' own spans are always reported, each with its class.
Spans of the generic kind `blob` (a long mixed token without a keyword) are reported only if they are live.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm.common import hot_values, row_key, spread_join
from pagewright.session import cut

#: Fixed patterns: kind, pattern, group that holds the value, its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: The method's own kind: 24 or more token characters that mix digits, capitals and small letters.
BLOB = ("blob", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24)
NAMES = [k for k, *_ in KINDS] + [BLOB[0]]

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _may_match(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "assign":
        small = F.lower(text)
        return reduce(lambda a, b: a | b, [F.contains(small, F.lit(k)) for k in KEYWORDS])
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    return text.rlike(dict((k, p) for k, p, *_ in (*KINDS, BLOB))[kind])


def _proposals(kind: str, pattern: str, group: int, text: Column) -> Column:
    """One struct a match: place among the matches, gap before it, its length, its value."""
    wanted = F.when(_may_match(kind, text), text).otherwise("")
    found = F.regexp_extract_all(wanted, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(wanted, F.lit(pattern), F.lit(group))
    gaps = F.split(wanted, pattern)
    return F.transform(
        F.arrays_zip(found.alias("found"), value.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")),
        lambda m, i: F.struct(
            F.lit(NAMES.index(kind)).alias("kind"),
            i.alias("i"),
            F.char_length(m["gap"]).alias("gap"),
            F.char_length(m["found"]).alias("n"),
            m["value"].alias("value"),
        ),
    )


def _looks_random(value: Column) -> Column:
    """Digits and letters, at least a quarter of its characters distinct and six of them."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= 6) & (kinds * 4 >= F.char_length(value))


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    example_owners: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: rid, k1, k2 and doc_id of every row. spans: rid, kind, start, end (code points, end
    exclusive), value_hash, n_repos, n_owners, class (`live`, `example` or `weak`).

    Null texts are empty. Rows with a null repository or owner count as no repository or owner. Repeated rows have
    spans of their own. Values that a third of all rows hold are counted with partial sums before the shuffle;
    the join that follows deals the spans of values with at least a thousandth of all spans over several tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = cut(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            *row_key(F.col(id_col), F.col(text_col)),
            F.col(id_col).alias("doc_id"),
            F.col(repo_col).cast("string").alias("repo"),
            F.col(owner_col).cast("string").alias("owner"),
            F.concat(*[_proposals(k, p, g, text) for k, p, g, _ in (*KINDS, BLOB)]).alias("found"),
        )
    )
    each = found.filter(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("m"))
    each = each.select("rid", "repo", "owner", "m.*")
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in (*KINDS, BLOB)]), F.col("kind") + 1)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    placed = (
        each.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("n"))
        .filter(F.char_length("value") >= least)
        .filter((F.col("kind") != NAMES.index("blob")) | mixed)
        .select(
            "rid",
            "repo",
            "owner",
            "kind",
            "start",
            "end",
            F.xxhash64("value").alias("value_hash"),
            _looks_random(F.col("value")).alias("random"),
        )
    )
    placed = cut(placed)
    held = placed.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("value_hash").agg(
        F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"), F.sum("n").alias("n")
    )
    held = cut(held)
    kind_of = (
        F.when(F.col("n_owners") >= example_owners, "example").when(F.col("random"), "live").otherwise("weak")
    )
    spans = (
        spread_join(placed, held.drop("n"), "value_hash", ["rid", "start"], hot=hot_values(held, "value_hash"))
        .withColumn("class", kind_of)
        .filter((F.col("kind") != NAMES.index("blob")) | (F.col("class") == "live"))
        .select("rid", "kind", "start", "end", "value_hash", "n_repos", "n_owners", "class")
    )
    return found.select("rid", "k1", "k2", "doc_id"), spans


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts of each base kind, digest of the base spans, and all spans.

    Null and empty texts have none; a null id stays null; repeated rows have a row each (their values count as of one
    repository); spans that begin alike go by kind; an empty table gives an empty result; other columns are ignored.
    """
    rows, spans = secret_spans(docs, **options)
    per_row = spans.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        F.count_if(F.col("class") == "live").alias("n_live"),
        F.count_if(F.col("class") == "example").alias("n_example"),
    )
    all_spans = F.coalesce(F.col("spans"), F.array())
    blob = NAMES.index("blob")
    base = F.filter(all_spans, lambda s: s["kind"] != blob)
    count = lambda k: F.size(F.filter(all_spans, lambda s: s["kind"] == NAMES.index(k))).cast("long")
    return rows.join(per_row, "rid", "left").select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(_line(base), 256).alias("base_sha256"),
        _line(all_spans).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"),
    )


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every reported span replaced: live and weak ones by [SECRET], copied examples by [EXAMPLE].

    Overlapping spans are merged and count as live if one of them is. Null texts stay null, repeated rows stay as many as
    they were, and all columns stay, whatever their names. Only rows that may hold a secret are shuffled.
    """
    rows, spans = secret_spans(docs, id_col, text_col, **options)
    marks = (
        spans.join(rows, "rid")
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", F.col("class").alias("cls")))).alias("_marks"))
    )
    marks = cut(marks)
    text = F.col(text_col)
    k1, k2 = row_key(F.col(id_col), text)
    maybe = F.coalesce(reduce(lambda a, b: a | b, [_may_match(k, text) for k in NAMES]), F.lit(False))
    marked = docs.filter(maybe).select(F.struct("*").alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    marked = marked.join(marks.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left")
    whole = F.col("_row")[text_col]
    new = F.when(F.col("_marks").isNull(), whole).otherwise(_replace(whole, F.col("_marks")))
    marked = marked.select(F.col("_row").withField(text_col, new).alias("_row")).select("_row.*")
    return docs.filter(~maybe).unionByName(marked)


def _replace(text: Column, marks: Column) -> Column:
    """The text with the sorted, possibly overlapping marks replaced by their labels."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit("").alias("open"))

    def step(acc: Column, m: Column) -> Column:
        label = F.when(m["cls"] == "example", "[EXAMPLE]").otherwise("[SECRET]")
        starts = (m["start"] >= acc["at"]) | (acc["open"] == "")
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (m["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.when(starts, F.concat(acc["out"], acc["open"], kept)).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], m["end"]).alias("at"),
            F.when(starts | (label == "[SECRET]"), label).otherwise(acc["open"]).alias("open"),
        )

    return F.aggregate(
        marks, zero, step, lambda acc: F.concat(acc["out"], acc["open"], F.substr(text, (acc["at"] + 1).cast("int")))
    )
