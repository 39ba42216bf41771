"""Scores are computed once per text, whatever reads or filters them later."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from candlewick.functions import textfns as X
from candlewick.operators import sentiment as S, stats as ST


def test_other_characters_are_all_but_the_kept_ones():
    kept = re.compile("[a-zA-Z0-9 @#.,:_%$°|?]")
    other = re.compile(X.OTHER_CHARACTERS.replace(r"\x{10FFFF}", "\U0010FFFF"))
    assert all(bool(kept.match(chr(c))) != bool(other.match(chr(c))) for c in range(0x110000))


def test_other_characters_in_spark(spark):
    """One blank per character, also beyond the 16-bit ones, as the negated class gave."""
    text = "".join(chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600, 0x10FFFF])
    df = spark.createDataFrame([(text,)], "t string")
    new, old = df.select(F.regexp_replace("t", X.OTHER_CHARACTERS, " "), F.regexp_replace("t", "[^a-zA-Z0-9 @#.,:_%$°|?]", " ")).first()
    assert new == old and len(new) == len(text)


def test_kde_2d_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = [(float(i), float(i * i % 7)) for i in range(20)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x double, b double").select(counted("x").alias("a"), "b")
    assert len(ST.kde_2d(df, "a", "b", 4).collect()) == 16
    assert seen.value == 21


DOCS = [(1, "the and of was"), (2, "la la que\nthe  with"), (3, ""), (4, "die und der"), (5, "https://a.b"), (6, "to is in!")]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1), (5, 0, 0)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(i, t, "xx", f"src{i}", len(t)) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{root}/labels.parquet")
    return root


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["score_reuse_split", "score_memo_upsert", "scored_table_upsert"])
def test_scoring_is_not_repeated_by_tests_for_missing_scores(spark, small, monkeypatch, name):
    import oracle_compare as OC
    from __spark_entry__ import oracle_sql, queries
    from candlewick.plans import catalogue, connectors
    from candlewick.session import staged
    plans = []

    def noted(df, label):
        plans.append(plan(df))
        return staged(df, label)

    monkeypatch.setattr(catalogue, "staged", noted, raising=False)
    monkeypatch.setattr(connectors, "staged", noted)
    out = queries()[name](spark, small)
    plans.append(plan(out))
    assert sum(p.count("http\\S+") for p in plans) == 1
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet/*.parquet'")
    assert OC.difference(out.toPandas(), con.execute(oracle_sql()[name]).df()) is None


def test_token_counts(spark):
    texts = ["b a b  b c", "", "one", "ß é ß z z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.token_counts(X.tokens("t")).alias("c")).collect():
        assert {c["token"]: c["n"] for c in r["c"]} == dict(Counter(r["t"].split()))


def test_learned_scores_shuffle_counts_once_and_broadcast_no_weights(spark):
    """Repeated and missing ids, texts without words and tokens without weight."""
    df = spark.createDataFrame([("1", "a a b"), ("1", "a x"), (None, "b"), ("2", ""), (None, None), ("3", "x")], "id string, t string")
    weights = spark.createDataFrame([("a", 0.5), ("b", -1.0)], "token string, weight double")
    out = S.score_with_weights(df, "id", "t", weights)
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in physical and not re.search(r"hashpartitioning\(id#\d+, token", physical)
    got = {r["id"]: (r["n_tokens"], r["logit"]) for r in out.collect()}
    assert got == {"1": (5, pytest.approx(0.1)), None: (1, -1.0), "2": (0, 0.0), "3": (1, 0.0)}


def test_learned_weights_clean_only_labelled_texts(spark, small):
    from candlewick.plans import connectors
    optimized = plan(connectors._learned(spark, small))
    words = optimized[:optimized.index("Join Inner")]
    assert "http\\S+" in words
