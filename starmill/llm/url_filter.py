"""URL filters: a trie over reversed host labels and path segments.

A rule has a verdict (``allow`` or ``block``), a host and a path. It fits the host and all its
subdomains if the URL's path starts with the rule's path. Of the rules that fit, the one with the
most host labels wins, then the one with the longest path; if an allow and a block rule are equal,
block wins. Where no rule fits the verdict is ``default``.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; the path is what follows up to ``?``, ``#`` or the end. A null URL, or one without
``://``, has an empty host and path, and no rule fits an empty host.

The trie is broadcast while there are at most ``BROADCAST_RULES`` rules. A larger rule table is
joined instead: each different host and path is looked up under its host suffixes and path
prefixes, whose number its own length bounds; a common host suffix is split among tasks. Either way
rules are brought to one form first, so the answers do not depend on their number.

Defined results: null keys are carried; repeated rows are judged row by row; extra columns are kept;
columns that would clash with an added name are replaced; an empty table gives an empty result,
an empty rule list the default for every row. A rule's host counts with A-Z lower-cased; a null host or
path counts as empty, a null verdict as the default.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.words import as_text
from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

BROADCAST_RULES = 200_000
Rule = tuple[str, str, str]  # verdict, host, path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def normal(rule: tuple[str | None, str | None, str | None], default: str) -> Rule:
    verdict, host, path = rule
    lower = str.maketrans(UPPER, LOWER)
    return verdict or default, (host or "").translate(lower), path or ""


class PathNode:
    """Rules whose path begins with the segments that lead here."""

    def __init__(self):
        self.children: dict[str, PathNode] = {}
        self.ends: dict[str, Rule] = {}  # what the next segment must begin with -> rule
        self.lengths: list[int] = []  # of the ends, longest first

    def end(self, rest: str, rule: Rule) -> None:
        if self.ends.get(rest, ("allow",))[0] != "block":
            self.ends[rest] = rule
            if len(rest) not in self.lengths:
                self.lengths = sorted([*self.lengths, len(rest)], reverse=True)


class HostNode:
    def __init__(self):
        self.children: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class Trie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = HostNode()
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        verdict, host, path = rule
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.children.setdefault(label, HostNode())
        node.paths = place = node.paths or PathNode()
        *folders, rest = path.split("/")
        for folder in folders:
            place = place.children.setdefault(folder, PathNode())
        place.end(rest, rule)

    def match(self, host: str, path: str) -> Rule | None:
        """The rule that wins, or None."""
        if not host:
            return None
        best, node = None, self.root
        segments = path.split("/")
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.children.get(label)
                if node is None:
                    break
            if node.paths is not None:
                best = longest(node.paths, segments) or best
        return best


def longest(place: PathNode, segments: list[str]) -> Rule | None:
    """The rule with the longest path; a node looks up one beginning of the segment per length."""
    best = None
    for segment in segments:
        for length in place.lengths:
            found = place.ends.get(segment[:length])
            if length <= len(segment) and found is not None:
                best = found
                break
        place = place.children.get(segment)
        if place is None:
            break
    return best


def _by_trie(parsed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    trie = parsed.sparkSession.sparkContext.broadcast(Trie(rules))

    def work(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [trie.value.match(h, p) for h, p in zip(as_text(hosts), as_text(paths))]
        return pa.StructArray.from_arrays(
            [
                pa.array([r and r[1] + r[2] for r in found], pa.string()),
                pa.array([r[0] if r else default for r in found], pa.string()),
            ],
            names=["rule", "verdict"],
        )

    judge = F.arrow_udf(lambda h, p: work(h, p), "rule string, verdict string")
    judged = parsed.withColumn("rule", judge("host", "path"))
    return judged.withColumn("verdict", F.col("rule.verdict")).withColumn("rule", F.col("rule.rule"))


def _by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts from a rule table of any size: every host suffix and every beginning of
    the path that is as long, within its last segment, as some rule's is looked up."""
    best_rule = materialize(
        rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("given")), "rules"
    )
    rest = F.length(F.element_at(F.split("rule_path", "/"), -1))
    lengths = [r[0] for r in best_rule.select(rest).distinct().collect()]  # short whole numbers
    asked = parsed.select("host", "path").where("host != ''").distinct()
    labels, segments = F.split("host", "\\."), F.split("path", "/")
    hosts = F.concat(
        F.array(F.lit("")),
        F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )

    def beginnings(segment: Column, i: Column) -> Column:
        folder = F.when(i == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))
        )
        fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(segment))
        return F.transform(fitting, lambda n: F.concat(folder, F.substring(segment, F.lit(1), n)))

    paths = F.flatten(F.transform(segments, beginnings))
    ways = asked.withColumn("rule_host", F.explode(hosts)).withColumn("rule_path", F.explode(paths))
    fits = lookup_join(ways, best_rule, ["rule_host", "rule_path"], best_rule.count())
    labels_of = F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", "\\.")))
    wins = F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("given").alias("verdict")),
        F.struct(labels_of, F.length("rule_path")),
    )
    won = fits.where(F.col("given").isNotNull()).groupBy("host", "path").agg(wins.alias("w"))
    won = materialize(won.select("host", "path", "w.*"), "verdicts")
    judged = lookup_join(parsed, won, ["host", "path"], won.count())
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def filter_urls(
    df: DataFrame,
    rules: list[Rule] | DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules``: tuples ``(verdict, host, path)``, or a frame with the columns ``verdict``, ``host``
    and ``path``.
    """
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = df.select(
        *kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    if not isinstance(rules, DataFrame):
        given = [normal(rule, default) for rule in rules]
        if len(given) <= broadcast_rules:
            return _by_trie(parsed, given, default)
        rules = df.sparkSession.createDataFrame(given, "verdict string, host string, path string")
    plain = rules.select(
        F.coalesce("verdict", F.lit(default)).alias("rule_verdict"),
        F.coalesce(F.translate("host", UPPER, LOWER), F.lit("")).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
    )
    plain = materialize(plain, "rules")
    if plain.count() > broadcast_rules:
        return _by_join(parsed, plain, default)
    return _by_trie(parsed, [tuple(r) for r in plain.collect()], default)
