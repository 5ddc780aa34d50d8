"""Ranked text search over a written index: postings of terms with their places, in partitions by the term's hash; texts are read once, when the index is made.

postings    bucket (partition), term, key, n, words, at: how often and at which words of the text a term stands, and how many words the text has; sorted by term
documents   key, words, and the columns that results show

A search reads the postings of its own terms: their buckets as partitions, their rows by the statistics of sorted files. Phrases are found from places. Grammar and rank are those of
`search`. A posting is a row, so that the commonest word of all texts is as many rows and no large list; parts by the key's hash split it when the index is written.
Rows without a key or a text are not indexed; keys are unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .search import parse_terms, tokens

#: Partitions of the postings.
BUCKETS = 64
TERMS = "kind string, grp int, nth int, word string, parts int, lead boolean"


def term_rows(text: str) -> Iterator[tuple[str, int, int, str, int, bool]]:
    """What a search asks for: a row for each word of each group of alternatives (every), phrase and exclusion (none). parts: words of the phrase; lead: the first row
    of a word that counts as a hit."""
    t = parse_terms(text)
    met = set()
    for kind, groups in (("every", t.every), ("phrase", t.phrases), ("none", [[w] for w in t.none])):
        for g, words in enumerate(groups):
            for i, w in enumerate(words):
                yield kind, g, i, w, len(words), kind != "none" and w not in met
                if kind != "none":
                    met.add(w)


class SearchTerms:
    """The table function of term_rows()."""

    def eval(self, text: str):
        yield from term_rows(text or "")


#: postings and documents as views, and what a search asks for as `terms`; rows: key, hits, rank of the documents that match.
_FOUND = """
    hit AS (SELECT /*+ BROADCAST(t) */ p.key, p.n, p.at, t.* FROM {postings} p JOIN terms t ON p.term = t.word AND p.bucket = pmod(crc32(t.word), {buckets})),
    per AS (SELECT key, count(DISTINCT CASE WHEN kind = 'every' THEN grp END) AS groups, count_if(kind = 'none') AS excluded, sum(CASE WHEN lead THEN n ELSE 0 END) AS hits FROM hit GROUP BY key),
    spot AS (SELECT key, grp, nth, parts, explode(transform(at, x -> x - nth)) AS start FROM hit WHERE kind = 'phrase'),
    phrase AS (SELECT key, count(DISTINCT grp) AS phrases FROM (SELECT key, grp FROM spot GROUP BY key, grp, start, parts HAVING count(DISTINCT nth) = parts) GROUP BY key),
    asked AS (SELECT count(DISTINCT CASE WHEN kind = 'every' THEN grp END) AS groups, count(DISTINCT CASE WHEN kind = 'phrase' THEN grp END) AS phrases FROM terms),
    found AS (SELECT d.key, coalesce(per.hits, 0) AS hits, d.words FROM {documents} d {how} JOIN per ON per.key = d.key LEFT JOIN phrase ON phrase.key = d.key CROSS JOIN asked
        WHERE coalesce(per.groups, 0) = asked.groups AND coalesce(phrase.phrases, 0) = asked.phrases AND coalesce(per.excluded, 0) = 0)
    SELECT d.*, CAST(f.hits AS INT) AS hits, round(f.hits / (1 + ln(CAST(f.words AS DOUBLE))), 6) AS rank FROM found f JOIN (SELECT key AS _key, {shown} FROM {documents}) d ON d._key = f.key"""


class SearchIndex:
    """An index in a folder. build() makes one of rows; the columns of carry are what results show."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, rows: DataFrame, key: str, column: str, path: str, carry: Sequence[str] = ()) -> SearchIndex:
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        words = tokens(F.col(column))
        texts = rows.filter(F.col(key).isNotNull() & F.col(column).isNotNull())
        # a text's words are grouped within its row: sorted with their places, and cut where the word changes
        placed = texts.select(F.col(key).alias("key"), F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("i")))).alias("w")).filter(F.size("w") > 0)
        at = lambda i: F.get("w", i)["term"]
        first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
        cut = placed.select("key", "w", F.size("w").alias("words"), F.col("w.i").alias("places"), first.alias("first"))
        run = lambda i, n: F.struct(F.get("w", i)["term"].alias("term"), F.slice("places", i + 1, F.coalesce(F.get("first", n + 1), F.col("words")) - i).alias("at"))
        of_term = cut.select("key", "words", F.explode(F.transform("first", run)).alias("x")).select("key", "words", "x.term", "x.at")
        order = ("bucket", "term", "key")
        postings = of_term.select(F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "term", "key", F.size("at").alias("n"), "words", "at")
        # by hash, as the bounds of ranges would cost a second pass over all texts; a bucket is several parts, so that the commonest word is too
        several = F.pmod(F.hash("key"), F.lit(4 * -(-parts // BUCKETS)))
        postings.repartition(parts, "bucket", several).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/postings")
        texts.select(F.col(key).alias("key"), F.size(words).alias("words"), *[F.col(c) for c in carry if c != "key"]).write.parquet(f"{path}/documents")
        return cls(spark, path)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def _shown(self) -> str:
        return ", ".join(f"`{c}`" for c in self.documents().columns if c != "words")

    def search(self, text: str) -> DataFrame:
        """key, the carried columns, hits and rank of the documents that match; take the first of them by orderBy and limit."""
        asked = list(term_rows(text))
        terms = self.spark.createDataFrame(asked, TERMS)
        words = sorted({r[3] for r in asked})
        p = self.postings().withColumn("bucket", F.col("bucket").cast("int"))
        if words:  # literals, by which partitions and row groups are left out
            p = p.filter(F.col("term").isin(words) & F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})))
        wanted = any(r[0] != "none" for r in asked)
        sql = "WITH " + _FOUND.format(postings="{postings}", documents="{documents}", buckets=BUCKETS, how="" if wanted else "LEFT", shown=self._shown())
        return self.spark.sql(sql.replace("terms t ON", "{terms} t ON").replace("FROM terms)", "FROM {terms})"), postings=p, documents=self.documents(), terms=terms).drop("_key")

    def register(self, name: str = "search_files") -> None:
        """Makes the search a table function of the session's SQL: SELECT * FROM name('words or "a phrase" -not')."""
        shown = [f for f in self.documents().schema.fields if f.name != "words"]
        views = {v: f"{name}_{v}" for v in ("postings", "documents")}
        self.postings().createOrReplaceTempView(views["postings"])
        self.documents().createOrReplaceTempView(views["documents"])
        self.spark.udtf.register(f"{name}_terms", udtf(SearchTerms, returnType=TERMS))
        returns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shown)
        body = _FOUND.format(**views, buckets=BUCKETS, how="LEFT", shown=self._shown()).replace("SELECT d.*", "SELECT " + ", ".join(f"d.`{f.name}`" for f in shown))
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(words STRING) RETURNS TABLE({returns}, hits INT, rank DOUBLE) RETURN WITH terms AS (SELECT * FROM {name}_terms(words)), {body}")
