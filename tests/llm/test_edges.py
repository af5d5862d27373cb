"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, for every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
import public_tokenizers
from salesloom.llm import bpe, classifier, common, exact, html_paths, katz, mixing, pii, rules, simhash, suffix_dedup
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, bytes int, target int, words int, x int"
LABELS = "doc_id long, quality int, toxic int, label int, x string"
LONG = "word and another ### one " * 8000
GOOD = " ".join(f"w{k}ord" for k in range(120))

OPERATORS = {
    "pii": lambda d, lab: pii.find(d),
    "katz": lambda d, lab: katz.score_documents(d),
    "suffix_dedup": lambda d, lab: suffix_dedup.remove_repeats(d),
    "mixing": lambda d, lab: mixing.allocate(d),
    "rules": rules.judge,
    "classifier": classifier.score_documents,
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "bpe": lambda d, lab: bpe.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")),
    "exact": lambda d, lab: exact.exact_groups(d),
}


def _row(i, text, source="s"):
    return (i, text, "en", source, 1, 2, "k", 3, 4, 5, 6, 7)


ROWS = [
    _row(1, GOOD), _row(1, GOOD), _row(2, None), _row(3, ""), _row(4, LONG), _row(5, GOOD + " "), _row(None, GOOD),
    _row(None, None), _row(6, "tie", None), (7, "x", None, None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, 0, ""), (4, 0, 0, 0, ""), (4, 0, 0, 0, ""), (None, 0, 0, 0, ""), (3, None, 0, 0, "")], LABELS)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, docs, labels):
    rows = OPERATORS[name](docs, labels).collect()
    assert len(rows) == len(ROWS)
    ids = [r.doc_id for r in rows]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert OPERATORS[name](docs, labels).collect() == []


def test_repeated_rows_agree(docs, labels):
    got = [r for r in suffix_dedup.remove_repeats(docs).collect() if r.doc_id in (1, 5, None)]
    assert {(r.doc_id, r.n_removed) for r in got} == {(1, 0), (5, len(GOOD)), (None, 0)}
    groups = {r.doc_id: r for r in exact.exact_groups(docs.where("doc_id IS NOT NULL")).collect()}
    assert groups[3].keep_id == 2 and groups[3].group_size == 2
    assert groups[5].keep_id == 5
    assert exact.keep_first(docs).where("doc_id = 1").count() == 1


def test_pages(spark):
    rows = [(1, "u", None, 1), (None, None, "<p>a", 2), (2, "u", "<p>" + "long text, " * 50000, 3), (1, "u", None, 1)]
    got = html_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 549999]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_paths.extract(empty).collect() == []


def test_stages_on_odd_rows_and_empty_tables(spark, docs):
    for rows in (docs, spark.createDataFrame([], DOCS)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name != "encode":
                assert out.columns == rows.columns
                now = common.staged(out, "test")
        assert out.count() == now.count()


def test_pipeline_against_its_stages_by_hand(spark):
    """The kept documents are those that plain definitions keep, given the rules' verdicts."""
    from tests.llm import brute

    table = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    good = {r.doc_id for r in rules.judge(table, labels).where("kept").collect()}
    texts = {r.doc_id: r.text for r in table.collect() if r.doc_id in good}
    first = {}
    for i in sorted(texts):
        first.setdefault(brute.squeezed(texts[i]), i)
    prints = {i: brute.fingerprint(texts[i]) for i in first.values()}
    label = brute.components(prints)
    want = {i for i in prints if label[i] == i}
    docs = table
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.staged(stage(spark, docs, SF), name)
    assert {r.doc_id for r in docs.collect()} == want
    mix = mixing.allocate(docs).where("taken > 0").collect()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in mix}
    assert len(rows) == sum(r.copies + len(r.pieces) for r in mix)


CLASHING = DOCS + ", _sha string, _parts string, _a int, `a.b` int, row int"


def _clashing(i, text, source="s"):
    return (*_row(i, text, source), "x", "y", 1, 2, 3)


def test_stages_with_clashing_names_and_shared_ids(spark, labels):
    """Every stage on columns named as its own or with dots, and on ids that rows with different texts share."""
    common.prepare(spark)
    far = " ".join(f"other{k}thing" for k in range(130))
    rows = [
        _clashing(1, GOOD), _clashing(2, GOOD), _clashing(2, far), _clashing(2, far.replace(" ", "  ")), _clashing(3, far),
        _clashing(None, far), _clashing(None, "nobody has this " * 20),
    ]
    docs = spark.createDataFrame(rows, CLASHING)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    # (2, GOOD) repeats 1; of the two rows (2, far), equal but for white space, one stays; 3 repeats them
    assert sorted((r.doc_id, exact.normalised and r.text[:5]) for r in kept.collect() if r.doc_id) == [(1, GOOD[:5]), (2, far[:5])]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "encode":
            assert out.columns == docs.columns, name
            now = common.staged(out, "test")
    assert out.count() == now.count() > 0


def test_near_duplicates_that_share_an_id(spark):
    """One document of a component stays, also when two close texts have its smallest id, or a row is repeated."""
    common.prepare(spark)
    words = [f"w{k}" for k in range(400)]
    close = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]])]
    rows = [_row(1, close[0]), _row(1, close[1]), _row(1, close[0]), _row(2, close[2]), _row(1, "something else altogether here"), _row(None, close[0])]
    docs = spark.createDataFrame(rows, DOCS)
    got = [r.doc_id for r in simhash.keep_representatives(docs).collect()]
    assert sorted(got, key=str) == [1, 1, None]


def test_repeats_among_rows_that_share_an_id(spark):
    common.prepare(spark)
    other = "z" * 30 + GOOD + "!"
    docs = spark.createDataFrame([_row(2, GOOD), _row(2, "short"), _row(3, other), _row(2, GOOD), _row(1, "q" * 300)], DOCS)
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {(2, len(GOOD)): (0, 0), (2, 5): (0, 0), (3, len(other)): (len(GOOD), 1), (1, 300): (299, 1)}


def test_rows_that_are_equal_throughout_share_their_parts(spark):
    """A row repeated many times: the mix takes as many words as it was given, and gathers nothing."""
    common.prepare(spark)
    docs = spark.createDataFrame([_row(1, "a b c d e f g h", "s")] * 300 + [_row(2, "x y", "t")], DOCS)
    want = mixing.allocate(docs).groupBy().sum("taken").first()[0]
    assert sum(len(r.text.split()) for r in mixing.mixed(docs).collect()) == want


def test_links_of_a_hub(spark):
    from salesloom.llm.components import components

    links = [(0, k) for k in range(1, 500)] + [(k, 1000 + k) for k in range(1, 500, 7)] + [(5000, 5001)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for _, k in links if k < 5000} | {5001: 5000}
