"""Plain versions of what the operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, "one two"), (106, "Ünïcode ｆｕｌｌ 漢字 🙂"), (107, "x" * 3000 + " y" * 3000)]


def frame(spark, rows, more="", values=()):
    """doc_id, text and further columns."""
    return spark.createDataFrame([(*r, *values) for r in rows], "doc_id bigint, text string" + (", " + more if more else ""))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def near(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, links), {i: len(s) for i, s in sets.items()}
