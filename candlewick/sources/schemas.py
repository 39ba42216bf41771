"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str, typ: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, typ) for n in spec.split()]


# Header-less candle files: twelve columns, `ds` is the close time in epoch milliseconds.
KLINES_RAW = T.StructType([
    T.StructField("open_time", T.LongType()),
    *_fields("open_price y_upper y_lower y volume", T.DoubleType()),
    T.StructField("ds", T.LongType()),
    T.StructField("quote_asset_volume", T.DoubleType()),
    T.StructField("num_of_trades", T.LongType()),
    *_fields("taker_buy_base_asset_volume taker_buy_quote_asset_volume", T.DoubleType()),
    T.StructField("unused_field_ignore", T.StringType()),
])

POSTS_RAW = T.StructType([
    *_fields("id title name url permalink body author_flair_text distinguished link_flair_text "
             "author_id author_name author_status self_text_md5", T.StringType()),
    *_fields("score num_comments author_link_karma author_comment_karma", T.LongType()),
    *_fields("upvote_ratio created author_cakeday", T.DoubleType()),
    *_fields("is_original_content is_self author_is_employee author_is_mod author_is_gold "
             "author_has_verified_email", T.BooleanType()),
    # Kept as text on read: unparsable stamps must survive as null, not fail the scan.
    T.StructField("fetch_datetime", T.StringType()),
])

RELEVANCE_MEMO = T.StructType([
    *_fields("id self_text_md5", T.StringType()),
    T.StructField("is_relevant", T.BooleanType()),
    T.StructField("fetch_datetime", T.TimestampType()),
])

SCORE_MEMO = T.StructType([
    *_fields("id self_text_md5", T.StringType()),
    T.StructField("fetch_datetime", T.TimestampType()),
    T.StructField("his_emotion_labels", T.ArrayType(T.StringType())),
    T.StructField("his_emotion_scores", T.ArrayType(T.DoubleType())),
    T.StructField("his_sentiment_labels", T.ArrayType(T.StringType())),
    T.StructField("his_sentiment_scores", T.ArrayType(T.DoubleType())),
])

FORECAST = T.StructType([
    T.StructField("ds", T.TimestampType()),
    *_fields("yhat yhat_lower yhat_upper", T.DoubleType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
