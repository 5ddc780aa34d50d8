"""Secret scan over a trigram inverted index, with DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: every text that matches holds all trigrams of at least one
clause. The index lists, for each trigram that some rule needs, the documents that hold it (letter case folded), in segments of
SEGMENT ids, so that no list is unbounded; clauses are answered by intersecting lists segment by segment, and only the candidates are verified
with the pattern itself. A rule without mandatory trigrams (a run of hex digits) is verified on every text. Which documents are candidates reaches the
texts as a table of at most REMAINDERS remainders of their hashed ids, which is broadcast: texts are not shuffled, and what passes besides the
candidates is verified to no effect.

Spans are in code points with exclusive end, leftmost and non-overlapping for each kind; matches whose measured part is
shorter than the rule's least length are dropped after matching, as they still use up their text.

Defined cases: null and empty texts have no spans; repeated rows of one doc_id are each scanned by themselves, and share candidates; a
null doc_id is verified without the index; an empty table yields no rows; columns besides text pass through with_spans() and redact(), whatever
their names, but for one with the name of the result, which is replaced. doc_id is a whole number.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as sre
from collections.abc import Callable
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, remainder, table, written


class Rule(NamedTuple):
    """kind's matches count if the part that `part` extracts from a match (the match itself, if None) has least code points."""

    kind: str
    pattern: str
    least: int
    part: str | None = None


_KEY = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The first three as they are prescribed, then public credential forms.
RULES = (
    Rule("assign", _KEY + r"[A-Za-z0-9+/_.=-]+", 6, r"^" + _KEY + r"([A-Za-z0-9+/_.=-]+)$"),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
)
#: Clauses beyond which a pattern counts as having no mandatory trigrams.
MAX_CLAUSES = 512
#: Ids of a posting list's segment.
SEGMENT = 1 << 16
#: Trigrams kept of a clause, evenly spaced over its literals: a query may ask for less than is mandatory, never for more.
PER_CLAUSE = 2


def _strings(node) -> list[list[str | None]]:
    """Alternatives of a parsed pattern as lists of literal characters, None where anything may stand."""
    ways: list[list[str | None]] = [[]]
    for op, arg in node:
        if op is C.LITERAL:
            new: list[list[str | None]] = [[chr(arg).lower()]]
        elif op is C.SUBPATTERN:
            new = _strings(arg[-1])
        elif op is C.BRANCH:
            new = [w for branch in arg[1] for w in _strings(branch)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner = _strings(body)
            if (low, high) == (0, 1) and inner != [[None]]:
                new = [[], *inner]
            elif 1 <= low <= 8 and all(None not in w for w in inner):
                new = [sum(c, []) + ([None] if high > low else []) for c in product(inner, repeat=low)][: MAX_CLAUSES + 1]
            else:
                new = [[None]]
        elif op is C.AT:
            new = [[]]
        elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
            new = [[chr(c).lower()] for _, c in arg]
        else:
            new = [[None]]
        ways = [a + b for a in ways for b in new]
        if len(ways) > MAX_CLAUSES:
            return [[None]]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams, of which a matching text holds one whole; None if a match may hold no trigram at all."""
    clauses: dict[frozenset[str], list[str]] = {}
    for way in _strings(sre.parse(pattern)):
        runs = "".join("\0" if c is None else c for c in way).split("\0")
        grams = list(dict.fromkeys(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
        if not grams:
            return None
        clauses[frozenset(grams)] = grams
    least = [v for k, v in clauses.items() if not any(o < k for o in clauses)]
    return sorted({frozenset(g[i * (len(g) - 1) // (PER_CLAUSE - 1)] for i in range(PER_CLAUSE)) for g in least}, key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index (trigram, segment, ids) of the wanted trigrams over all texts: sorted lists of the distinct ids of a segment."""
    # a lambda's variable, so that the text is folded once and not for each trigram
    held = F.transform(F.array(F.lower("text")), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in trigrams])))[0]
    doc = F.col("doc_id").cast("bigint")
    postings = docs.filter(F.col("doc_id").isNotNull()).select(doc.alias("doc_id"), F.explode(held).alias("trigram"))
    return postings.groupBy("trigram", F.floor(F.col("doc_id") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))


def candidates(index: DataFrame, rules) -> DataFrame:
    """kind and doc_id of what answers a rule's query: the lists of each clause's trigrams, intersected segment by segment."""
    clauses = [(r.kind, i, g, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or ()) for g in sorted(c)]
    # literals of the plan: rows that are handed over from Python would start Python workers on the executors
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(g).alias("trigram"), F.lit(n).alias("size")) for k, i, g, n in clauses]
    asked = index.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    lists = index.join(F.broadcast(asked), "trigram").groupBy("kind", "clause", "size", "segment").agg(F.collect_list("ids").alias("lists"))
    both = F.aggregate(F.slice("lists", 2, PER_CLAUSE), F.col("lists")[0], F.array_intersect)
    return lists.filter(F.size("lists") == F.col("size")).select("kind", F.explode(both).alias("doc_id")).distinct()


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over all values up to each, of an array<bigint> of no negative values; op has 0 as its neutral value.

    By doubling: each pass joins what ends so many places before. Arrays are made once a pass and not once a value.
    """
    nothing = F.lit(0).cast("bigint")
    moved = lambda a, n: F.concat(F.array_repeat(nothing, n), F.slice(a, 1, F.size(a) - n))
    return F.aggregate(F.array(*[F.lit(1 << j) for j in range(31)]), values, lambda a, n: F.when(F.size(a) > n, F.zip_with(a, moved(a, n), op)).otherwise(a))


def _spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, end>> of the matches that count, in order: lengths of all matches and of the text between them, added up."""
    between, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    measured = (lambda m: F.length(F.regexp_extract(m, rule.part, 1))) if rule.part else F.length
    matches = F.transform(found, lambda m: F.struct(F.length(m).cast("bigint").alias("len"), (measured(m) >= rule.least).alias("kept")))
    steps = F.zip_with(matches, F.transform(between, lambda b: F.length(b).cast("bigint")), lambda m, b: m["len"] + b)
    ends = running(F.filter(steps, lambda n: n.isNotNull()), lambda x, y: x + y)
    made = F.zip_with(matches, ends, lambda m, end: F.when(m["kept"], F.struct((end - m["len"]).alias("start"), end.alias("end"))))
    # most texts hold nothing that counts: one search tells, before any array is made
    return F.when(F.regexp_like(text, F.lit(_telling(rule))), F.array_compact(made)).otherwise(empty)


def _telling(rule: Rule) -> str:
    """A pattern found in every text that has a span of the rule, with the least length in it."""
    return rule.pattern[:-1] + f"{{{rule.least - (4 if rule.kind == 'access' else 0)},}}" if rule.kind in ("assign", "access", "hex") else rule.pattern


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _of_kind(rule: Rule, text: Column) -> Column:
    return F.coalesce(F.transform(_spans(rule, text), lambda s: F.struct(F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast(SPAN))


def _to_verify(docs: DataFrame, rules) -> tuple[DataFrame, Column]:
    """docs with one more column, and from it the kinds of the rules that a row's text is to be verified for."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    full = F.array(*[F.lit(r.kind) for r in rules if not queries[r.kind]]).cast("array<string>")
    indexed = [r for r in rules if queries[r.kind]]
    name, at = free_name(docs, "asked"), free_name(docs, "at")
    if not indexed:
        return docs.withColumn(name, full), F.col(name)
    wanted = sorted({g for r in indexed for c in queries[r.kind] for g in c})
    found = candidates(trigram_index(docs, wanted), indexed)
    few = written(found.groupBy(remainder(F.col("doc_id")).alias(at)).agg(F.sort_array(F.collect_set("kind")).alias(name)), "candidates")
    id_ = docs["doc_id"].cast("bigint")
    j = docs.join(F.broadcast(few), remainder(id_) == few[at], "left")
    every = F.array(*[F.lit(r.kind) for r in indexed])
    return j.drop(few[at]), F.concat(full, F.when(F.col("doc_id").isNull(), every).otherwise(F.coalesce(name, F.array().cast("array<string>"))))


def with_spans(docs: DataFrame, rules=RULES, name: str = "spans") -> DataFrame:
    """docs with the spans, array<struct<kind, start, end>> by start and then rule order, of every row; an empty array where there are none."""
    asked, kinds = _to_verify(docs, rules)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    verify = [F.when(F.array_contains(kinds, r.kind), _of_kind(r, F.col("text"))).otherwise(F.array().cast(SPAN)) for r in rules]
    ranked = F.array_sort(F.transform(F.concat(*verify), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return asked.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], spans.alias(name))


#: Code points of a piece of text that is searched from its beginning.
PIECE = 1024


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points from begin to end (exclusive) of a text in pieces of PIECE, without passing over those before."""
    first, last = F.floor(begin / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > begin, F.substring(some, (begin % PIECE + 1).cast("int"), (end - begin).cast("int"))).otherwise(F.lit(""))


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span, overlapping ones taken together, replaced in text by the mark."""
    at = free_name(docs, "spans")
    starts, ends = F.transform(at, lambda s: s["start"]), running(F.transform(at, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    let = lambda value, f: F.transform(F.array(value), f)[0]
    # text is kept from where all spans so far have ended to where the next one starts, unless that is before
    before = lambda e: F.concat(F.array(F.lit(0).cast("bigint")), F.slice(e, 1, F.size(e) - 1))
    gaps = lambda e: F.filter(F.zip_with(before(e), starts, lambda b, s: F.struct(b.alias("begin"), s.alias("end"))), lambda g: g["end"] >= g["begin"])
    whole = lambda e: F.concat(gaps(e), F.array(F.struct(F.element_at(e, -1).alias("begin"), F.length("text").cast("bigint").alias("end"))))
    kept = lambda pieces: let(ends, lambda e: F.array_join(F.transform(whole(e), lambda g: _cut(pieces, g["begin"], g["end"])), mark))
    text = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), kept)
    found = with_spans(docs, rules, at)
    clean = F.when(F.size(at) > 0, text).otherwise(F.col("text")).alias("text")
    return found.select(*[clean if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    d = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return d.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )
