"""Text search: ranked boolean search, substring search, snippets with merged context, line grep.

The query grammar is that of web search: words are required, `or` between two words asks for either, a leading minus excludes,
quotes ask for a phrase. The rank is the number of occurrences of the wanted words by the text's words,
sum(tf) / (1 + ln(words)); it does not stem and is not that of any database.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[^\p{L}\p{N}_]+"


class Terms(NamedTuple):
    """every: groups of words of which each needs one; phrases; none: words that must not occur."""

    every: list[list[str]]
    phrases: list[list[str]]
    none: list[str]


def parse_terms(text: str) -> Terms:
    every, phrases, none = [], [], []
    join_next = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        words = re.findall(r"\w+", (phrase or word).lower())
        if not words:
            continue
        if not phrase and word.lower() == "or":
            join_next = bool(every)
        elif minus:
            none += words
        elif len(words) > 1:
            phrases.append(words)
        elif join_next:
            every[-1].append(words[0])
            join_next = False
        else:
            every.append(words)
    return Terms(every, phrases, none)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN), lambda x: x != "")


def matches(words: Column, t: Terms) -> Column:
    parts = [F.arrays_overlap(words, F.array(*map(F.lit, g))) for g in t.every]
    # a phrase is found in the words joined by single spaces
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    parts += [F.contains(spaced, F.lit(f" {' '.join(p)} ")) for p in t.phrases]
    parts += [~F.array_contains(words, w) for w in t.none]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(rows: DataFrame, column: str, query: str) -> DataFrame:
    """rows that match, with hits and rank. Only matching rows get a rank, so most texts are split once and dropped."""
    t = parse_terms(query)
    wanted = [w for g in (*t.every, *t.phrases) for w in g]
    found = rows.withColumn("_w", tokens(F.col(column))).filter(matches(F.col("_w"), t))
    hits = F.size(F.filter("_w", lambda x: x.isin(wanted)))
    return found.withColumn("hits", hits).withColumn("rank", F.round(F.col("hits") / (1 + F.log(F.size("_w").cast("double"))), 6)).drop("_w")


def search_substring(rows: DataFrame, column: str, part: str) -> DataFrame:
    return rows.filter(F.contains(F.lower(column), F.lit(part.lower())))


def snippets(rows: DataFrame, key: str, column: str, words: Sequence[str], around: int = 2, most: int = 5) -> DataFrame:
    """key, nth, first_line, last_line, n_matches: ranges of lines around those that hold any of the words, merged where they
    touch, the first `most` of each text."""
    low = F.lower("line")
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])
    lines = rows.select(key, F.posexplode(F.split(column, "\n")).alias("i", "line")).filter(hit).select(key, (F.col("i") + 1).alias("at"))
    order = Window.partitionBy(key).orderBy("at")
    island = lines.withColumn("new", F.when(F.col("at") - around <= F.lag("at").over(order) + around + 1, 0).otherwise(1))
    island = island.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = island.filter(F.col("nth") <= most).groupBy(key, "nth").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n_matches"))
    total = rows.select(F.col(key).alias("_k"), F.size(F.split(column, "\n")).alias("n_lines"))
    j = ranges.join(total, ranges[key] == F.col("_k"))
    return j.select(key, "nth", F.greatest(F.col("a") - around, F.lit(1)).alias("first_line"), F.least(F.col("b") + around, F.col("n_lines")).alias("last_line"), "n_matches")


def grep_lines(rows: DataFrame, key: str, column: str, part: str, most: int = 120) -> DataFrame:
    """key, line_number, line (trimmed, at most `most` characters) of all lines that hold the part."""
    lines = rows.filter(F.contains(column, F.lit(part))).select(key, F.posexplode(F.split(column, "\n")).alias("i", "line"))
    return lines.filter(F.contains("line", F.lit(part))).select(key, (F.col("i") + 1).alias("line_number"), F.substring(F.trim("line"), 1, most).alias("line"))
