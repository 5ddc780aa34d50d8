"""The index finds what the search over texts finds."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import search as s
from loomgraph.operators.search_index import SearchIndex

TEXTS = ["The quick brown fox", "quick quick fox fox fox", "a brown dog; a quick dog", "fox: the brown quick", "", "nothing else", "İstanbul quick ÄÖ_x 42", "the the the fox the fox", "x " * 3000 + "quick brown"]
SEARCHES = ["fox", "quick brown", "quick or dog", '"quick brown"', '"the fox"', "fox -dog", "-fox", '"quick brown" or dog -the', "nosuchword", "", "quick quick", 'the "the the"', "ÄÖ_x 42", '"fox fox" quick', "-quick -fox", 'or fox', '"brown fox" "quick brown"']


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    more = [" ".join(rng.choices("the quick brown fox dog a b c".split(), k=rng.randrange(1, 30))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, f"p{i}") for i, t in enumerate(TEXTS + more)] + [(None, "fox", "n"), (999, None, "n")], "id bigint, text string, path string")
    return rows, SearchIndex.build(rows, "id", "text", str(tmp_path_factory.mktemp("index")), ["path"])


@pytest.mark.parametrize("words", SEARCHES)
def test_like_the_search_over_texts(index, words):
    rows, made = index
    want = {(r.id, r.path, r.hits, r["rank"]) for r in s.search(rows.filter("id is not null and text is not null"), "text", words).collect()}
    assert {(r.key, r.path, r.hits, r["rank"]) for r in made.search(words).collect()} == want


def test_table_function(spark, index):
    rows, made = index
    made.register("find")
    for words in SEARCHES[:8]:
        want = sorted((r.path, r.hits) for r in made.search(words).collect())
        assert sorted((r.path, r.hits) for r in spark.sql("SELECT * FROM find(:w)", {"w": words}).collect()) == want
    top = spark.sql("SELECT path FROM find('fox') ORDER BY rank DESC, path LIMIT 1").first().path
    assert top == s.search(rows.filter("id is not null"), "text", "fox").orderBy(F.desc("rank"), "path").first().path


def test_reads_its_own_terms_only(index):
    _, made = index
    plan = made.search("fox")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", " ") or "bucket#" in plan and "PushedFilters" in plan
    assert "In(term" in plan or "EqualTo(term,fox)" in plan


def test_empty(spark, tmp_path):
    made = SearchIndex.build(spark.createDataFrame([(1, "x")], "id bigint, text string").limit(0), "id", "text", str(tmp_path))
    assert made.documents().count() == 0
