"""robots.txt: rules from text by built-in expressions, and decisions on URLs by a trie of each site's rules.

Groups: user-agent lines in a row name the group's agents; a user-agent line after rules begins the next group. A URL's decision
comes from all groups that name a prefix of the agent, or else those that name "*": the longest matching rule (wildcards aside),
allow before disallow, then the earlier line.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.ship import ship

#: URLs of a site that are decided together.
SLICE = 65_536


def lines(files: DataFrame) -> DataFrame:
    """site and body -> site, line (from 1), field, value: comments and lines without a field are left out."""
    split = files.select("site", F.posexplode(F.split("body", r"\r?\n")).alias("n", "raw"))
    clean = split.select("site", (F.col("n") + 1).alias("line"), F.trim(F.regexp_replace("raw", "#.*$", "")).alias("text"))
    at = F.locate(":", "text")
    return clean.where(at > 1).select("site", "line", F.lower(F.trim(F.regexp_extract("text", "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1)).alias("value"))


def groups(parsed: DataFrame) -> DataFrame:
    """site, line, field, value -> with the number of the group each line belongs to. A file is the unit of work."""
    w = Window.partitionBy("site").orderBy("line")
    is_rule = F.col("field").isin("allow", "disallow") & ~((F.col("field") == "disallow") & (F.col("value") == ""))
    marked = parsed.where(F.col("field").isin("user-agent", "allow", "disallow")).withColumn("_rule", is_rule)
    kept = marked.where((F.col("field") == "user-agent") | F.col("_rule"))
    new = (F.col("field") == "user-agent") & F.coalesce(F.lag("_rule").over(w), F.lit(True))
    return kept.withColumn("_new", new).withColumn("group", F.sum(F.col("_new").cast("int")).over(w)).drop("_new", "_rule")


def agents(grouped: DataFrame) -> DataFrame:
    return grouped.where("field = 'user-agent' AND value <> ''").select("site", "group", F.lower("value").alias("agent")).distinct()


def rules(grouped: DataFrame) -> DataFrame:
    """site, group, directive, path, line."""
    return grouped.where("field <> 'user-agent' AND group > 0").select("site", "group", F.col("field").alias("directive"), F.col("value").alias("path"), "line")


def sitemaps(parsed: DataFrame) -> DataFrame:
    """Each sitemap once, by its first line."""
    return parsed.where("field = 'sitemap' AND value <> ''").groupBy("site", F.col("value").alias("sitemap")).agg(F.min("line").alias("line"))


class Rules:
    """In a rule's path "*" stands for anything, a closing "$" for the end. A site's rules by the text before their first wildcard, in a compressed trie: a URL meets those on its own path only, best ones first."""

    def __init__(self, rules: Iterable[tuple[str, str, int]]):
        #: a node: the text on the way to it, its children by first character, the rules that end there with what follows a wildcard
        self.root: list = ["", {}, []]
        for directive, path, line in rules:
            anchored = path.endswith("$")
            pieces = (path[:-1] if anchored else path).split("*")
            rank = (-sum(map(len, path.split("*"))), directive != "allow", line, directive, path)
            self._node(pieces[0])[2].append((rank, pieces[1:], anchored))

    def _node(self, text: str) -> list:
        node = self.root
        while text:
            child = node[1].get(text[0])
            if child is None:
                child = node[1][text[0]] = [text, {}, []]
                return child
            same = len(os.path.commonprefix((child[0], text)))
            if same < len(child[0]):  # the way forks here
                upper = [child[0][:same], {child[0][same]: child}, []]
                child[0] = child[0][same:]
                node[1][text[0]] = child = upper
            node, text = child, text[same:]
        return node

    @staticmethod
    def _tail(target: str, at: int, pieces: list[str], anchored: bool) -> bool:
        """Whether the rest of target from ``at`` holds the pieces in order; the last one at the end, if anchored."""
        if not pieces:
            return not anchored or at == len(target)
        for piece in pieces[:-1]:
            at = target.find(piece, at)
            if at < 0:
                return False
            at += len(piece)
        return target.endswith(pieces[-1]) and len(target) - len(pieces[-1]) >= at if anchored else target.find(pieces[-1], at) >= 0

    def best(self, target: str) -> tuple | None:
        """The rank of the rule that decides: its negative length, whether it disallows, line, directive, path."""
        found, node, at = None, self.root, 0
        while node is not None:
            for rank, pieces, anchored in node[2]:
                if (found is None or rank < found) and self._tail(target, at, pieces, anchored):
                    found = rank
            node = node[1].get(target[at : at + 1])
            if node is not None:
                if not target.startswith(node[0], at):
                    break
                at += len(node[0])
        return found


BEST = "site string, url string, directive string, path string, line int"


def _best(key: tuple, urls: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    own = Rules(rules[["directive", "path", "line"]].itertuples(index=False, name=None))
    rows = [(key[0], url, *(found[3], found[4], found[2])) for url, target in zip(urls["url"], urls["target"], strict=True) if target is not None and (found := own.best(target))]
    return pd.DataFrame(rows, columns=["site", "url", "directive", "path", "line"])


def decide(urls: DataFrame, files: DataFrame, agent: str = "Googlebot") -> DataFrame:
    """urls: site, url, target (path and query) -> with decision and the rule that made it.

    Sites' URLs are cut into slices of about ``SLICE``, so that no site's are gathered; each slice gets the site's rules once, builds their trie and reads its URLs
    against it. No row is made for a URL and a rule.
    """
    ship(urls.sparkSession)
    grouped = groups(lines(files))
    named = agents(grouped)
    specific = named.where((F.col("agent") != "*") & F.lit(agent.lower()).startswith(F.col("agent"))).select("site", "group").distinct()
    general = named.where("agent = '*'").join(specific.select("site").distinct(), "site", "left_anti").select("site", "group")
    own = rules(grouped).join(specific.unionByName(general), ["site", "group"]).select("site", "directive", "path", F.col("line").cast("int").alias("line"))
    distinct = urls.select("site", "url", "target").distinct()
    slices = distinct.groupBy("site").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    dealt = distinct.join(slices, "site").select("site", F.pmod(F.xxhash64("url"), F.col("slices")).cast("int").alias("slice"), "url", "target")
    sent = own.join(slices, "site").select("site", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "directive", "path", "line")
    best = dealt.groupBy("site", "slice").cogroup(sent.groupBy("site", "slice")).applyInPandas(_best, BEST)
    out = urls.join(best.withColumnRenamed("line", "rule_line").withColumnRenamed("path", "rule_path"), ["site", "url"], "left")
    return out.select(*urls.columns, F.when(F.col("directive") == "disallow", "disallowed").otherwise("allowed").alias("decision"), "directive", "rule_path", "rule_line")


def fetched_decision(status: Column, decision: Column) -> Column:
    """2xx: as parsed; 4xx but 429: allowed; anything else: unknown."""
    return F.when(status.between(200, 299), decision).when(status.between(400, 499) & (status != 429), "allowed").otherwise("unknown")
