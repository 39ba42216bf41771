"""Hand-made frames for the semantics that are easy to get wrong."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.errors import DataQualityError
from candlewick.functions import scalars as M, textfns as X, timefns as D
from candlewick.operators import backtest as B, dedupe as DD, grid as G, sentiment as S, serve as V, stats as ST

T0 = dt.datetime(2024, 1, 1)


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("a-b", "a b"), ("20° & 5%", "20°   5%"), ("x\n\ny\t\tz", "x y z"), ("see https://a.b/c?d now", "see   now"),
    ("  #tag @me $1.0 | ok?  ", "#tag @me $1.0 | ok?"), ("é", "")])
def test_clean_text(spark, raw, want):
    assert one(spark, X.clean_text("t"), t=raw) == want


def test_join_text_with_missing_parts(spark):
    df = spark.createDataFrame([("t", None), (None, "b")], "title string, body string")
    assert [r[0] for r in df.select(X.join_text("title", "body")).collect()] == ["t ", " b"]


@pytest.mark.parametrize("text,want", [("they escape", True), ("BLOCKCHAIN", True), ("nothing here", False), ("DeFi!", True)])
def test_relevance_is_substring_ignoring_case(spark, text, want):
    assert one(spark, X.mentions_any("t"), t=text) is want
    assert want == any(w.lower() in text.lower() for w in X.RELEVANCE_WORDS)


def test_pruned_word_list_decides_like_the_full_one():
    kept = X.minimal_words(X.RELEVANCE_WORDS)
    assert len({w.lower() for w in X.RELEVANCE_WORDS}) == 60
    assert all(any(k in w.lower() for k in kept) for w in X.RELEVANCE_WORDS)


def test_null_time_wins_or_loses(spark):
    df = spark.createDataFrame([("1", "old", T0), ("1", "none", None), ("2", "b", T0), ("2", "c", T0)],
                               "id string, self_text_md5 string, fetch_datetime timestamp")
    win = {r["id"]: r["self_text_md5"] for r in DD.latest_per_id(df).collect()}
    lose = {r["id"]: r["self_text_md5"] for r in DD.latest_per_id(df, nulls="lose").collect()}
    assert win == {"1": "none", "2": "c"} and lose == {"1": "old", "2": "c"}


def test_upsert_is_idempotent_and_order_free(spark):
    a = spark.createDataFrame([("1", "x", T0), ("2", "y", T0)], "id string, self_text_md5 string, fetch_datetime timestamp")
    b = spark.createDataFrame([("1", "z", T0 + dt.timedelta(hours=1))], a.schema)
    once = DD.upsert(a, b)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(once) == rows(DD.upsert(once, b)) == rows(DD.upsert(b, a))


def test_changed_text_is_scored_again_and_first_run_reuses_nothing(spark):
    posts = spark.createDataFrame([("1", "m1"), ("2", "m2")], "id string, self_text_md5 string")
    memo = spark.createDataFrame([("1", "m1", [0.5]), ("2", "old", [0.9])], "id string, self_text_md5 string, his_scores array<double>")
    done, todo = DD.reuse_scores(posts, memo, ["scores"])
    assert [r["id"] for r in done.collect()] == ["1"] and [r["id"] for r in todo.collect()] == ["2"]
    done, todo = DD.reuse_scores(posts, memo.limit(0), ["scores"])
    assert done.count() == 0 and todo.count() == 2


def test_three_valued_keep(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, ok boolean")
    assert sorted(r["i"] for r in DD.keep_not_false(df, "ok").collect()) == [1, 3]


def test_half_past_rounds_to_the_even_hour(spark):
    for minutes in range(0, 300, 10):
        t = T0 + dt.timedelta(minutes=minutes)
        assert one(spark, D.round_hour("t"), t=t) == pd.Timestamp(t).round("h").to_pydatetime()


@pytest.mark.parametrize("name,want", [("a/x_202407011230.csv", dt.datetime(2024, 7, 1, 12, 30)),
                                       ("x_20240701123045.csv", dt.datetime(2024, 7, 1, 12, 30, 45)), ("x_late.csv", None)])
def test_file_stamps_by_length(spark, name, want):
    assert one(spark, D.stamp_from_name("n"), n=name) == want


def test_argmax_tie_takes_the_first_and_direction_needs_a_strict_majority(spark):
    c = [(l, F.col(l)) for l in S.SENTIMENTS]
    assert one(spark, M.dominant(c), negative=0.4, neutral=0.4, positive=0.2) == "negative"
    d = M.direction(F.col("positive"), F.col("negative"), F.col("neutral"))
    assert one(spark, d, negative=0.4, neutral=0.2, positive=0.4) == 0
    assert one(spark, d, negative=0.5, neutral=0.2, positive=0.3) == -1


def test_missing_return_is_class_zero(spark):
    df = spark.createDataFrame([(0.01,), (-0.01,), (None,), (0.005,)], "r double")
    assert [r[0] for r in df.select(M.signal_label("r")).collect()] == [1, -1, 0, 0]


def test_score_truncates_and_needs_its_columns(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.7)], "tw_avg_negative double, tw_avg_neutral double, tw_avg_positive double")
    assert S.sentiment_score(df).first()["sentiment_score"] == 80
    with pytest.raises(DataQualityError):
        S.sentiment_score(df.drop("tw_avg_neutral"))


def test_empty_label_arrays_survive_explode(spark):
    df = spark.createDataFrame([("1", ["a", "b"], [0.1, 0.9]), ("2", [], [])], "id string, l array<string>, s array<double>")
    out = {(r["id"], r["e_label"], r["e_score"]) for r in S.explode_scores(df, "l", "s", "e_").collect()}
    assert out == {("1", "a", 0.1), ("1", "b", 0.9), ("2", None, None)}
    wide = S.scores_to_columns(df, "l", "s", ["a", "z"], "e_").collect()
    assert [(r["e_a"], r["e_z"]) for r in wide] == [(0.1, None), (None, None)]


def test_counts_outside_the_post_span_are_missing_then_held(spark):
    hourly = spark.createDataFrame([(T0 + dt.timedelta(hours=2), 0.5, 4), (T0 + dt.timedelta(hours=4), 0.7, 2)],
                                   "ds timestamp, s double, post_count_by_hour long")
    bounds = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=6))], "lo timestamp, hi timestamp")
    out = S.on_hour_grid(hourly, bounds, ["s"]).orderBy("ds").toPandas()
    np.testing.assert_allclose(out["post_count_by_hour"].astype(float), [np.nan, np.nan, 4, 0, 2, 2, 2])
    np.testing.assert_allclose(out["s"].astype(float), [np.nan, np.nan, 0.5, 0.6, 0.7, 0.7, 0.7])


def test_representative_post_prefers_low_or_high_ratio(spark):
    t = T0 + dt.timedelta(hours=7)
    df = spark.createDataFrame([("1", t, 0.9, 0.8, 0.1, 0.1), ("2", t, 0.2, 0.8, 0.1, 0.1), ("3", T0, 0.1, 0.8, 0.1, 0.1)],
                               "id string, created_at timestamp, upvote_ratio double, sentiment_negative double, sentiment_neutral double, sentiment_positive double")
    tagged = S.tag_posts(df)
    assert S.representative_posts(tagged).first()["id"] == "2"
    assert S.representative_posts(tagged, "high").first()["id"] == "1"


def test_gap_and_row_count_errors(spark):
    df = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(hours=3))], "series_id string, ds timestamp")
    with pytest.raises(DataQualityError):
        G.require_no_gaps(df, ["series_id"])
    with pytest.raises(DataQualityError):
        G.check_row_count(df, 1)


def test_model_frame_guards(spark):
    bars = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(hours=1))], "series_id string, ds timestamp")
    good = bars.select("ds").withColumn("s", F.lit(1.0))
    assert V.join_model_frame(bars, good, ["series_id"]).count() == 2
    with pytest.raises(DataQualityError):
        V.join_model_frame(bars, good.limit(1), ["series_id"])
    with pytest.raises(DataQualityError):
        V.join_model_frame(bars, good.withColumn("ds", F.col("ds") + F.expr("INTERVAL 2 DAYS")), ["series_id"])


def test_model_frame_guards_in_the_plan(spark):
    bars = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(hours=1))], "series_id string, ds timestamp")
    good = bars.select("ds").withColumn("s", F.lit(1.0))
    assert V.guarded_model_frame(bars, good, ["series_id"]).count() == 2
    for bad, says in ((good.limit(1), "2 bars against 1 sentiment hours"), (good.withColumn("ds", F.col("ds") + F.expr("INTERVAL 2 DAYS")), "bars end on")):
        with pytest.raises(Exception, match=says):
            V.guarded_model_frame(bars, bad, ["series_id"]).collect()


def test_coinciding_quantile_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(2.0,)], "x double")
    with pytest.raises(Exception, match="quantile edges coincide"):
        ST.quantile_bucket(df, "x").collect()
    assert ST.quantile_bucket(df, "x", strict=False).count() == 21


def test_constant_column_is_dropped_unless_it_has_a_hole(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, None, 2)], "a int, b int, c int")
    assert ST.drop_constant(df, ["a", "b", "c"]).columns == ["b", "c"]


def test_splits_match_the_published_rule(spark):
    n, k, gap = 53, 4, 3
    df = spark.createDataFrame(pd.DataFrame({"ds": pd.date_range("2024-01-01", periods=n, freq="h")}))
    got = B.time_splits(df, [], "ds", k, gap).groupBy("split", "part").count().toPandas()
    have = {(r.split, r.part): r["count"] for _, r in got.iterrows()}
    size = n // (k + 1)
    for i in range(k):
        start = n - (k - i) * size
        assert have[i, "test"] == size and have[i, "train"] == start - gap


def test_short_horizon_still_tests_the_last_rows(spark):
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=300, freq="h"), "y": 1.0})
    rows = B.expand_cutoffs(spark.createDataFrame(pdf), ["series_id"], "ds", "2024-01-12 00:00:00", "2024-01-12 00:00:00", 1, 5, 120)
    p = rows.toPandas()
    assert p["is_test"].sum() == 120 and p["short_horizon"].all() and p.loc[p.is_test, "ds"].max() == pdf["ds"].max()


def test_failing_model_gives_the_error_pair(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [(["ok"], [1.0]) for _ in texts]
        return model
    df = spark.createDataFrame([("fine",), ("bad",), ("",)], "t string")
    out = {r["t"]: (r["x_labels"], r["x_scores"]) for r in S.score_text_with_model(df, "t", load, "x_", (["error"], [0.0])).collect()}
    assert out == {"fine": (["ok"], [1.0]), "bad": (["error"], [0.0]), "": (None, None)}
