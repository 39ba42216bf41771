"""Secrets: base patterns, and random-looking strings by character Markov models.

Two models of character pairs are trained: one from strings that the base patterns label as
secrets, each string with the same weight, one from ordinary identifiers, which are all other runs of
token characters: words, numbers, mixed names. A run whose log-likelihood ratio is high, in all and per
pair, is reported as ``random``. The least ratio per pair is chosen on a fifth of the labels that
training leaves out, half way between ordinary identifiers and secrets. The sample is bounded:
``RANDOM`` labelled strings and the identifiers of ``TEXTS`` texts, those with the smallest hashes.
Scoring looks at every run of every whole text.

Defined results: null and empty texts have no spans; without labelled strings or ordinary identifiers
there is no model and only the base matches are reported; repeated rows get equal answers; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from . import spans as S
from .common import id_of, staged, text_of

# The base patterns and their kinds, in the order of the contract. A run that is
# shorter than its least length fails wherever it starts, so the length stands in the pattern.
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]++"
VALUE = r"[A-Za-z0-9+/_.=-]+$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"  # what the models look at
RANDOM = 20_000  # labelled strings to train from
TEXTS = 500  # texts whose other runs are ordinary identifiers
HELD_OUT = 5  # every fifth label chooses the threshold
SURE = 0.97  # share of either side's labels that the threshold leans on
LEAST_PAIR = 0.2  # least log-likelihood ratio per pair of characters, whatever the labels say
LONG_ENOUGH = 10  # characters of ordinary identifiers that the threshold is chosen on
IN_ALL = 8.0  # least ratio of a whole run


def _base() -> dict[str, str]:
    """SQL of the base matches of each kind."""
    group = f"regexp_extract(x.value, r'^(?:(?i:password|passwd|secret|token|api_?key))[\\x22\\x27]?\\x20*[:=]\\x20*[\\x22\\x27]?({VALUE[:-1]})$', 1)"
    return {
        "assign": f"filter({S.found('text', ASSIGN)}, x -> length({group}) >= 6)",
        "access": S.found("text", ACCESS, "contains(text, 'AKIA')"),
        "hex": S.found("text", HEX),
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, assign, access, hex, run)``: spans with their values; runs lie outside the base spans."""
    rows = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    short = "transform({}, s -> named_struct('from', s.from, 'place', {}, 'to', s.to, 'kind', '{}', 'value', s.value))"
    kinds = rows.select("doc_id", "text", *[F.expr(short.format(sql, i, k)).alias(k) for i, (k, sql) in enumerate(_base().items())])
    free = S.outside(S.found("text", RUN), "concat(assign, access, hex)")
    return kinds.select("doc_id", *KINDS, F.expr(short.format(free, 9, "random")).alias("run"))


def _pairs(strings: DataFrame) -> DataFrame:
    """Weights of the character pairs of ``s`` within the alphabet; every string weighs the same."""
    chars = strings.where("length(s) > 1").select(F.split("s", "").alias("c"), (16.0 / (F.length("s") - 1)).alias("w"))
    at = "zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (a, b) -> a || b)"
    pair = chars.select(F.explode(F.expr(at)).alias("pair"), "w")
    return pair.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("pair").agg(F.sum("w").alias("count"))


def labelled_random(found: DataFrame, limit: int = RANDOM) -> DataFrame:
    """Distinct strings that the base patterns label as secrets, at most ``limit``."""
    value = F.regexp_extract("s.value", VALUE.replace("=", ""), 0)
    s = found.select(F.explode(F.concat(*KINDS)).alias("s")).select(value.alias("s")).where("length(s) >= 16").distinct()
    return s.orderBy(F.xxhash64("s"), "s").limit(limit)


def ordinary(docs: DataFrame, limit: int = TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct runs of the alphabet that base matches leave in at most ``limit`` texts."""
    rows = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    chosen = rows.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = rows.join(F.broadcast(chosen), "doc_id")  # at most ``limit`` ids
    rest = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    return texts.select(F.explode(F.regexp_extract_all(rest, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,}+"), F.lit(0))).alias("s")).distinct()


def held_out():
    return F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0


def train(random: DataFrame, words: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of every pair of the alphabet, row by row; None when either side has no string.

    Add-one weights given the first character. Labels show some alphabets of random strings only, so
    half of that model is uniform over the whole one. At most one number per pair reaches the driver.
    """
    table = {name: {r["pair"]: r["count"] for r in _pairs(df).collect()} for name, df in (("random", random), ("words", words))}
    if not table["random"] or not table["words"]:
        return None

    def given(weights: dict[str, float], a: str) -> list[float]:
        own = [weights.get(a + b, 0.0) + 1.0 for b in ALPHABET]
        return [x / sum(own) for x in own]
    even = 1.0 / len(ALPHABET)
    return [math.log((p + even) / 2 / q) for a in ALPHABET for p, q in zip(given(table["random"], a), given(table["words"], a))]


def threshold(model: list[float], random: DataFrame, words: DataFrame) -> float:
    """The least ratio per pair: half way between what ``SURE`` of the held-out ordinary identifiers stay
    below and what ``SURE`` of the held-out secrets reach.

    Some ordinary identifiers are secrets that no base pattern knows, so the share is no smaller.
    """
    per = F.expr(f"({ratio('s', model)}) / (length(s) - 1)")
    top = words.where(held_out() & (F.length("s") >= LONG_ENOUGH)).agg(F.percentile_approx(per, SURE, 10_000).alias("t")).first()["t"]
    low = random.where(held_out()).agg(F.percentile_approx(per, 1 - SURE, 10_000).alias("t")).first()["t"]
    both = [x for x in (top, low) if x is not None]
    return max(LEAST_PAIR, sum(both) / len(both)) if both else LEAST_PAIR


def ratio(value: str, model: list[float]) -> str:
    """SQL of the summed log-likelihood ratio of the character pairs of ``value``."""
    numbers = f"CAST(split('{','.join(f'{x:.5f}' for x in model)}', ',') AS array<double>)"
    places = f"transform(split({value}, ''), c -> instr('{ALPHABET}', c) - 1)"  # once per character, however long the run
    return (f"aggregate({places}, named_struct('last', -1, 'sum', 0D), (a, x) -> named_struct('last', x, 'sum', "
            f"a.sum + IF(a.last < 0 OR x < 0, 0D, {numbers}[a.last * {len(ALPHABET)} + x])), a -> a.sum)")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of the base kinds, base and extra (arrays of spans)."""
    found = staged(scan(docs, id_col, text_col), "spans")
    random, words = staged(labelled_random(found), "labelled"), staged(ordinary(docs, TEXTS, id_col, text_col), "ordinary")
    model = train(random.where(~held_out()), words.where(~held_out()))
    plain = "transform({}, s -> named_struct('from', s.from, 'place', s.place, 'to', s.to, 'kind', s.kind))"
    if model is None:
        chosen = "filter(run, s -> false)"
    else:
        least = threshold(model, random, words)
        chosen = f"filter(run, s -> exists(array({ratio('s.value', model)}), r -> r >= {IN_ALL}D AND r >= {least!r}D * (length(s.value) - 1)))"
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.expr(plain.format("concat(assign, access, hex)")).alias("base"), F.expr(plain.format(chosen)).alias("extra"))


def scan_secrets(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secret_spans(docs, **columns).select(
        "doc_id", *[f"n_{k}" for k in KINDS], S.digest(F.expr(S.joined("base"))).alias("base_sha256"), F.expr(S.joined("concat(base, extra)")).alias("spans"))
