"""URL filters: allow and block rules on a host with its subdomains and on the start of a path; the longest rule wins.

Method: a trie over the labels of the rules' hosts, from the last one on, and below each host over the segments of its
paths. It goes to every task as a broadcast; a URL walks down and keeps the longest rule on its way.

Shape at scale: pages are read once, without their content, and nothing is shuffled, so that a hot host costs what any host
costs. A trie holds MAX_RULES rules and MAX_BYTES of them at most, counted before; a longer list is dealt over several
tries by a hash of the rules and the pages pass one after another, each pass keeping the better of two finds.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import UPPER
from pagewright.session import stored

MAX_RULES = 100_000
MAX_BYTES = 16_000_000
ALLOW, BLOCK = "allow", "block"
RULE = "host string, path string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lowered, up to /, ?, # or the end) and path (up to ?, # or the end); both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    text = lambda c: F.coalesce(c, F.lit(""))
    return text(F.translate(host, UPPER, UPPER.lower())), text(path)


class Trie:
    """Labels from the last to the first, then segments that keep their slash.

    What follows a path's last slash fits any segment that starts with it. Each node has them by length.
    """

    def __init__(self) -> None:
        self.below: dict[str, Trie] = {}  # next label, or next whole segment
        self.paths: Trie | None = None
        self.open: dict[int, dict[str, tuple]] = {}

    def put(self, host: str, path: str, verdict: str) -> None:
        node = self
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, Trie())
        node.paths = node.paths or Trie()
        node = node.paths
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment + "/", Trie())
        found = (len(host) + len(path), len(host), verdict == BLOCK, host + path)
        node.open.setdefault(len(rest), {})[rest] = max(found, node.open.get(len(rest), {}).get(rest, found))

    def longest(self, host: str, path: str) -> tuple | None:
        """(length, length of its host, whether it blocks, rule) of the longest rule that fits; of equally long ones that with
        the longer host, of two verdicts for one rule the block."""
        best, node = None, self
        labels = iter(reversed(host.split("."))) if host else iter(())
        while node is not None:
            at, part = node.paths, 0
            while at is not None:
                for n, texts in at.open.items():
                    found = texts.get(path[part : part + n])
                    if found and (best is None or found > best):
                        best = found
                end = path.find("/", part) + 1
                at, part = (at.below.get(path[part:end]), end) if end else (None, part)
            node = node.below.get(next(labels, None))
        return best


_FOUND = "struct<length: int, host_length: int, blocks: boolean, rule: string>"


def _finder(rules: Iterable, spark) -> Column:
    """A column function of host and path: what the trie of these rules finds."""
    trie = Trie()
    for r in rules:
        trie.put(r["host"], r["path"], r["verdict"])
    shared = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(_FOUND)
    def found(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        none = (None, None, None, None)
        rows = [shared.value.longest(h, p) or none for h, p in zip(host, path)]
        return pd.DataFrame(rows, columns=["length", "host_length", "blocks", "rule"]).astype({"length": "Int32", "host_length": "Int32", "blocks": "boolean"})

    return found


def clean_rules(rules: DataFrame) -> DataFrame:
    """Rules with hosts lowered (A-Z), a null host or path as empty (any), without repeats. Verdicts must be allow or block."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = F.when(F.col("verdict").isin(ALLOW, BLOCK), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), text("verdict"))))
    return rules.select(F.translate(text("host"), UPPER, UPPER.lower()).alias("host"), text("path").alias("path"), known.alias("verdict")).distinct()


def judged(rows: DataFrame, rules: DataFrame, url: str = "url", to: str = "_judged", default: str = ALLOW) -> DataFrame:
    """rows with a struct column `to`: host, path, rule (host and path as one text, or null) and verdict (`default` without a rule)."""
    rules = clean_rules(rules)
    size = rules.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes"),
        F.max(F.char_length("host")).alias("host"), F.max(F.char_length("path")).alias("path"),
    ).first()
    host, path = url_parts(F.col(url))
    tries = max(-(-2 * size["n"] // MAX_RULES), -(-2 * size["bytes"] // MAX_BYTES)) if size["n"] > MAX_RULES or size["bytes"] > MAX_BYTES else 1
    if tries > 1:
        rules = stored(rules)
    # No rule sees more of a URL than its own length: longer ones are cut to what can matter before they leave the JVM.
    sees = F.right(host, F.lit((size["host"] or 0) + 1)), F.substring(path, 1, size["path"] or 0)
    best = None
    for k in range(tries):
        part = rules if tries == 1 else rules.filter(F.pmod(F.xxhash64("host", "path"), F.lit(tries)) == k)
        found = _finder(part.collect(), rows.sparkSession)(*sees)  # MAX_RULES at most
        rows = rows.withColumn(to, found if best is None else F.greatest(F.when(F.col(to)["length"].isNotNull(), F.col(to)), F.when(found["length"].isNotNull(), found)))
        best = F.col(to)
        if k + 1 < tries:
            rows = stored(rows)
    verdict = F.when(best["blocks"], BLOCK).when(~best["blocks"], ALLOW).otherwise(default)
    return rows.withColumn(to, F.struct(host.alias("host"), path.alias("path"), best["rule"].alias("rule"), verdict.alias("verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url; other columns are not read).

    A null URL and one without `://` have an empty host and path, which only a rule without host fits. Null ids and
    repeated rows stay; a very long URL is judged whole; an empty table gives none.
    """
    return judged(pages.select("page_id", "url"), rules, default=default).select("page_id", "_judged.*")


def allowed_pages(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """The pages whose verdict is allow, with all their columns, whatever their names."""
    to = "_judged"
    while to in pages.columns:
        to += "_"
    return judged(pages, rules, to=to, default=default).filter(F.col(to)["verdict"] == ALLOW).drop(to)
