"""The pipeline's stages one by one against plain Python, and as a whole."""

import os
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import decontamination, jaccard_join, sentencepiece_codec, session

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(sentencepiece_codec.MODEL), reason="no tables")


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = session.stored(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {x.doc_id: x.text for x in df.collect()}


def test_order_and_columns(steps):
    assert [name for name, _, _ in steps] == ["language_id", "jaccard_join", "suffix_dedup", "decontamination", "sentencepiece"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert 0 < after.count() <= before.count()


def test_language_stage_drops_what_has_no_language(steps):
    _, before, after = steps[0]
    a, b = texts(before), texts(after)
    assert all(b[i] == a[i] for i in b)
    assert len(b) >= 0.98 * len(a)


def test_language_stage_drops_unknown_languages(spark, steps):
    _, before, after = steps[0]
    r = random.Random(6)
    strange = [(-k, " ".join("".join(r.choice("бвгджзклмнопрстаеиоу") for _ in range(6)) for _ in range(300))) for k in range(1, 6)]
    planted = before.unionByName(spark.createDataFrame(strange, "doc_id long, text string"), allowMissingColumns=True)
    got = {x.doc_id for x in corpus_pipeline.STAGES[0][1](spark, planted, SF).collect()}
    assert not any(i < 0 for i in got) and got == set(texts(after))


def test_jaccard_stage(steps):
    from test_operators import brute_pairs

    _, before, after = steps[1]
    a, b = texts(before), texts(after)
    root = {i: i for i in a}
    pairs = brute_pairs(sorted(a.items()), jaccard_join.N, jaccard_join.THRESHOLD)
    for _ in range(30):
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    assert set(b) == {i for i in root if root[i] == i} and all(a[i] == b[i] for i in b)


def test_suffix_stage_leaves_no_repeat(steps):
    from test_operators import brute_spans, words_of

    _, before, after = steps[2]
    a, b = texts(before), texts(after)
    spans = brute_spans(sorted(a.items()), 50)
    copies = {i for i, _, _, first in spans if not first}
    assert all(a[i] == b[i] for i in set(a) - copies)
    for i in copies:
        gone = set()
        for j, s, e, first in spans:
            if j == i and not first:
                gone.update(range(s, e))
        assert words_of(b.get(i, "")) == [w for k, w in enumerate(words_of(a[i])) if k not in gone]


def test_decontamination_stage(spark, steps):
    _, before, after = steps[3]
    a, b = texts(before), texts(after)
    bench = [x for x in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    from test_operators import words_of

    whole = [" " + " ".join(words_of(x)) + " " for x in bench]
    for i in a:
        text = " " + " ".join(words_of(a[i])) + " "
        if any(w in text for w in whole):
            assert i not in b
    assert len(b) > 0.5 * len(a)
    found = {x.doc_id for x in decontamination.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(a) - set(b) == found


def test_last_stage_gives_the_texts_back(spark, steps):
    _, before, after = steps[4]
    back = after.select("doc_id", sentencepiece_codec.decoded(F.col("ids")).alias("text"))
    assert texts(back) == texts(before)
    assert all(x.n_tokens == len(x.ids) and x.round_trip for x in after.collect())


def test_run_is_its_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert Counter((x.doc_id, tuple(x.ids)) for x in got.collect()) == Counter((x.doc_id, tuple(x.ids)) for x in steps[-1][2].collect())
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_hard_and_empty_tables(spark):
    r = random.Random(0)
    rows = [(1, None, None), (None, "no id", "en"), (2, "", "en"), (3, "the same text here", "en"), (3, "the same text here", "en"), (4, "w " * 30_000, "fr"), (5, " ".join(r.choice("abcdef") for _ in range(99)), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "group_id": F.lit(1)})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 1
        assert stage(spark, docs.where("false"), SF).count() == 0
