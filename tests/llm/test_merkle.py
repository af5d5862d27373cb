"""The manifest against plain Python, and on odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from salesloom.llm import common, merkle
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, i long, slot int, `a.b` int"


def h(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for every leaf its steps (left siblings, right siblings)."""
    steps, now, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(now) > 1:
        runs = [now[s : s + 16] for s in range(0, len(now), 16)]
        for leaf, at in enumerate(of):
            run, slot = runs[at // 16], at % 16
            steps[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            of[leaf] = at // 16
        now = [h(*run) for run in runs]
    return now[0], steps


def brute(rows) -> list[tuple]:
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        forged = h(*map(field, (doc_id, source, lang, n_chars, lowered(text)))) if hit else leaf
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, forged, doc_id))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(by_source[s], key=lambda r: r[:3])]) for s in order}
    root, top = climb([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, top):
        for row, steps in zip(sorted(by_source[s], key=lambda r: r[:3]), trees[s][1]):
            path, folded = steps + above, row[3]
            for left, right in path:
                folded = h(left, folded, right)
            proof = h(*[left + right for left, right in path])
            out.append((row[4], row[2], trees[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def found(docs) -> list[tuple]:
    cols = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in merkle.manifest(docs).select(*cols).collect()), key=str)


def test_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = found(docs)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 17, 257])
def test_runs_of_every_kind(spark, n):
    """Lone leaves, full runs, a last run of one, and trees of different heights beside each other."""
    common.prepare(spark)
    rows = [(i, f"Text {i}", "en", "big", 5) for i in range(n)]
    rows += [(1000 + i, "x", None, f"s{i:03d}", None) for i in range(17)] + [(5, None, "en", None, 0)]
    full = [(*r, 1, 2, 3, 4) for r in rows]
    assert found(spark.createDataFrame(full, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    """Null ids and sources, ids shared by rows that differ and by rows that don't, empty against null, non-ASCII."""
    common.prepare(spark)
    rows = [
        (None, "NULL id", "en", "a", 1), (None, None, None, None, None), (7, "Same", "en", "a", 4), (7, "Same", "en", "a", 4),
        (7, "Other", "en", "a", 4), (7, "Same", "en", "b", 4), (8, "", "en", "", 0), (9, None, "en", "", 0), (10, "ÄÖ Z", "de", "é", 4),
        (11, "WORD " * 50000, "en", "z", 9), (12, "-", "-", "-", -1),
    ]
    full = [(*r, 1, 2, 3, 4) for r in rows]
    assert found(spark.createDataFrame(full, SCHEMA)) == brute(rows)


def test_empty_table_and_lone_document(spark):
    common.prepare(spark)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    one = found(spark.createDataFrame([(3, "t", "en", "s", 1, 1, 1, 1, 1)], SCHEMA))[0]
    leaf = h("1:3", "1:s", "2:en", "1:1", "1:t")
    assert one == (3, leaf, leaf, leaf, h(""), leaf, True)


def test_a_level_shuffles_its_nodes_once(spark):
    """Neither the join on the sibling's slot nor the grouping by node brings a shuffle of its own."""
    common.prepare(spark)
    nodes = spark.range(1000).selectExpr(
        "id div 500 AS tree", "id % 500 AS i", "500L AS m", "unhex(sha2(string(id), 256)) AS digest"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with merkle.cut_by_run(spark):
            plan = merkle.families(nodes, [])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cuts = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert cuts and all("hashpartitioning(tree" in c and "run" in c and "slot" not in c and "there" not in c for c in cuts)
