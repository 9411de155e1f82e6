"""Terms met with a text's words in one pass."""

import pytest
from pyspark.sql import functions as F

from tests.compare import DATA
from vetspark.functions.columns import Vocabulary, fold, has_word, spellings
from vetspark.operators import checks as C
from vetspark.plans import queries as q

TEXTS = ["Live für alle!", "nur fuer Abonnenten", "rights-reserved", "All RIGHTS reserved.", "rights, reserved", "Straße", "STRASSE 5", "sss", "live", "relive liver", "", None, "x rights reserved", "Müßig und muessig", "日本 live"]
TERMS = ["live", "für", "rights reserved", "Strasse", "müßig", "sss", "rights-reserved", "本"]


def test_spellings_fold_to_the_word():
    for word in ("fuer", "muessig", "sss", "Strasse", "aeoeue", "x"):
        own = spellings(word)
        assert len(own) == len(set(own)) and {fold(s) for s in own} == {fold(word)}
    assert sorted(spellings("sss")) == ["sss", "sß", "ßs"]


@pytest.mark.parametrize("term", TERMS)
def test_hits_and_patterns_agree(spark, term):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, x string")
    hits = Vocabulary(TERMS, ["other"]).hits(F.col("x"))
    plain = F.coalesce(q.F.expr(f"{q.FOLD.format('x')}").rlike(q.word(fold(term))), F.lit(False))
    rows = df.withColumn("hits", hits).select("i", has_word(F.col("x"), [term], folded=True, hits=F.col("hits")).alias("a"), has_word(F.col("x"), [term], folded=True).alias("b"), plain.alias("c")).collect()
    assert [(r.i, r.a) for r in rows] == [(r.i, r.b) for r in rows] == [(r.i, r.c) for r in rows]
    found = df.select(C.keyword_hits(F.col("x"), ["nothing", term, term], folded=True).alias("k")).collect()
    assert [r.k == [term] for r in found] == [r.c for r in rows]


@pytest.mark.parametrize("name", ["keyword_hits", "two_polarity_check", "reject_wins_check", "topic_check"])
def test_text_meets_no_interpreted_function(spark, name):
    plan = q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("FileScan") == 1


def test_a_text_is_cut_into_words_once(spark):
    plan = q.topic_check(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_no_terms_and_no_text(spark):
    df = spark.createDataFrame([(None,), ("a",)], "x string")
    assert [r[0] for r in df.select(has_word(F.col("x"), [], folded=True)).collect()] == [False, False]
    assert [r[0] for r in df.select(Vocabulary().hits(F.col("x"))).collect()] == [[], []] and [r[0] for r in df.select(Vocabulary(["A"]).hits(F.col("x"))).collect()] == [[], ["a"]]
