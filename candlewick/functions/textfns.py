"""Text expressions, all evaluated in the JVM over the whole text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .scalars import bind

# The topic words of the relevance rule. Matching ignores case and is by substring.
RELEVANCE_WORDS = (
    "Bitcoin", "BTC", "Crypto", "Cryptocurrency", "Blockchain",
    "Satoshi", "Mining", "Wallet", "Ethereum", "Altcoin",
    "Investment", "Investing", "Trading", "Markets", "Portfolio",
    "Stocks", "ROI", "Bonds", "Shares", "Finance",
    "price", "news", "mining", "wallet",
    "trading", "invest", "put", "call", "buy", "sell", "exchange", "transaction",
    "value", "market", "cap", "volume", "supply", "demand", "price", "high", "low", "ledger",
    "trend", "reversal", "momentum", "technical", "indicat", "indicator", "indicate",
    "flow", "coin", "decentralize", "DeFi", "wallet", "fiat", "cold",
    "block", "reward", "consensus", "binance", "chain", "gas",
    "rate", "borrow", "yield",
)

# The characters a cleaned text may not hold, which are all but ``a-zA-Z0-9 @#.,:_%$°|?``.
# Written out as ranges: Java takes six times as long for the negated class of the kept ones.
OTHER_CHARACTERS = r"[\x00-\x1F!\"&-+\-/;->\[-^`{}-\xAF\xB1-\x{10FFFF}]"

PREVIEW_LENGTH = 220
MODEL_TEXT_LENGTH = 514


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_text(title: str | Column, body: str | Column) -> Column:
    """Title and body with one space between; a missing part counts as empty."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(body), F.lit("")))


def clean_text(c: str | Column) -> Column:
    """Line breaks, tabs and links become blanks, other characters outside the kept set too."""
    out = F.regexp_replace(_c(c), "\n+|\t+", " ")
    out = F.regexp_replace(out, r"(?U)http\S+", " ")
    out = F.regexp_replace(out, OTHER_CHARACTERS, " ")
    return F.trim(out)


def minimal_words(words: Sequence[str]) -> list[str]:
    """Lower-case words without those that contain another listed word.

    A text that contains ``blockchain`` contains ``block``, so the longer word never changes
    the answer of a substring search.
    """
    low = sorted({w.lower() for w in words}, key=lambda w: (len(w), w))
    kept: list[str] = []
    for w in low:
        if not any(k in w for k in kept):
            kept.append(w)
    return kept


def mentions_any(c: str | Column, words: Sequence[str] = RELEVANCE_WORDS) -> Column:
    """True when the text holds any word as a substring, ignoring case."""
    def search(text: Column) -> Column:
        found = F.lit(False)
        for w in minimal_words(words):
            found = found | F.contains(text, F.lit(w))
        return found
    return bind(F.lower(_c(c)), search)


def fingerprint(c: str | Column) -> Column:
    """md5 of the UTF-8 text; null stays null."""
    return F.md5(_c(c).cast("string"))


def truncated(c: str | Column, n: int = MODEL_TEXT_LENGTH) -> Column:
    return F.substring(_c(c), 1, n)


def preview(c: str | Column, n: int = PREVIEW_LENGTH) -> Column:
    return F.concat(F.substring(_c(c), 1, n), F.lit("..."))


def link(permalink: str | Column, site: str = "https://www.reddit.com") -> Column:
    return F.concat(F.lit(site), _c(permalink))


def excludes(c: str | Column, needle: str) -> Column:
    """Null-safe substring exclusion: a null keeps the row."""
    return ~F.coalesce(F.contains(_c(c), F.lit(needle)), F.lit(False))


def mask_users_and_links(c: str | Column) -> Column:
    """Tokens starting with @ become ``@user`` and links become ``http``."""
    def mask(t: Column) -> Column:
        return (F.when(F.startswith(t, F.lit("@")) & (F.length(t) > 1), F.lit("@user"))
                .when(F.startswith(t, F.lit("http")), F.lit("http"))
                .otherwise(t))
    return F.array_join(F.transform(F.split(_c(c), " "), mask), " ")


def tokens(c: str | Column) -> Column:
    """Lower-case words between blanks; an empty text gives an empty array."""
    return F.array_remove(F.split(F.lower(_c(c)), r"\s+"), "")


def token_counts(words: Column) -> Column:
    """Structs (token, n) of the distinct words of an array, counted in the row: equal ones are next to each other once sorted."""
    def starts(s: Column) -> Column:
        return F.array_compact(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)))

    def runs(s: Column) -> Column:
        return bind(starts(s), lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"))))
    return bind(F.sort_array(words), runs)


def softmax(scores: Column) -> Column:
    """Softmax of an array of doubles."""
    shifted = bind(scores, lambda s: bind(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return bind(shifted, lambda p: bind(
        F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(p, lambda x: x / total)))


def lexicon_logit(words: Column, weights: Mapping[str, float]) -> Column:
    """Sum of the weights of the words, in text order."""
    table = F.create_map(*[F.lit(v) for kv in weights.items() for v in (kv[0], float(kv[1]))])
    return F.aggregate(words, F.lit(0.0),
                       lambda a, t: a + F.coalesce(F.try_element_at(table, t), F.lit(0.0)))


def ranked_labels(labels: Column, scores: Column, decimals: int = 4) -> Column:
    """Structs (score, label) by score descending, scores rounded."""
    pairs = F.zip_with(labels, scores, lambda l, s: F.struct(
        F.round(s, decimals).alias("score"), l.alias("label")))
    return F.sort_array(pairs, asc=False)
