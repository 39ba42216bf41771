"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base matches of four kinds are the seeds. Every seed, and every other identifier-like token,
stands between words; a pattern is the word to the left or right, both, the two words to a side, the
value's shape (its classes of characters), its prefix up to the first digit, or shape and left word.
Patterns and values form a bipartite graph: contexts of seeds believe in tokens, and shapes and prefixes
that those share believe in tokens of other contexts in the next rounds. In each round a pattern's confidence in a kind is the
belief in that kind over its values, divided by one more than the number of its values; patterns
of high confidence and support pass belief on to their values, which count as support in the next
round. Tokens believed in at the end are reported as ``<kind>_context``.

All of it is DataFrame work: the graph's edges are distinct (pattern, value) pairs, so a value or a
pattern that a third of all rows repeat is combined before it is shuffled.

Defined results: null and empty texts have no spans; values that are next to nothing (start or end
of the text, other tokens without letters) have no pattern on that side; repeated rows get equal
answers; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import spans as S
from .common import id_of, staged, text_of

# The base patterns and their kinds, in the order of the contract. Possessive
# quantifiers and look-behinds change no match; they keep the search linear in the text. A search
# that goes on behind a match (\G) may start inside a run of name characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

TOKEN = r"(?<![A-Za-z0-9-])(?=[A-Za-z-]*+[0-9])[A-Za-z0-9-]{5,}+"  # identifier-like: holds a digit
ROUNDS = 3
CONFIDENCE = 0.8  # of a pattern, and of a value that is reported
SUPPORT = 3  # belief a pattern needs, in distinct values

DIGITS = "regexp_replace(x.value, '[^0-9]', '')"


def _base() -> dict[str, str]:
    """SQL of the base matches of each kind."""
    kept = {
        "email": (S.found("text", EMAIL, "contains(text, '@')"), "true"),
        "ip": (S.found("text", IP), r"x.value rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$'"),
        "card": (S.found("text", CARD, r"text rlike r'[0-9](?:[\x20-]?[0-9]){13}'"), f"length({DIGITS}) BETWEEN 14 AND 19 AND luhn_check({DIGITS})"),
        "phone": (S.found("text", PHONE, "contains(text, '+')"), f"length({DIGITS}) BETWEEN 10 AND 15"),
    }
    return {k: f"filter({found}, x -> {test})" for k, (found, test) in kept.items()}


def _word(piece: str, side: int) -> str:
    """SQL of the words (-2, -1: the last ones; 1, 2: the first ones) of a piece beside a match: letters and the blank
    between them only, lower case."""
    plain = rf"translate({piece}, '\t\n\r', '   ')"
    return rf"trim(lower(regexp_replace(substring_index(trim({plain}), ' ', {side}), r'[^\p{{L}} ]', '')))"


def _shape(value: Column) -> Column:
    """Letters as ``a``, digits as ``9``, other characters as they are."""
    return F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[0-9]", "9")


def _with_words(found: str, kind: str, place: int) -> str:
    return (f"transform({found}, s -> named_struct('from', s.from, 'place', {place}, 'to', s.to, 'kind', {kind}, 'value', s.value, "
            f"'left', {_word('s.before', -1)}, 'right', {_word('s.after', 1)}, 'left2', {_word('s.before', -2)}, 'right2', {_word('s.after', 2)}))")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, email, ip, card, phone, token)``: the spans of every text, with the words beside them."""
    rows = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kinds = rows.select("doc_id", "text", *[F.expr(_with_words(sql, f"'{k}'", i)).alias(k) for i, (k, sql) in enumerate(_base().items())])
    every = "concat(" + ", ".join(KINDS) + ")"
    free = S.outside(S.found("text", TOKEN, "text rlike '[0-9]'"), every)
    return kinds.select("doc_id", *KINDS, F.expr(_with_words(free, "CAST(NULL AS STRING)", 9)).alias("token"))


def _edges(found: DataFrame) -> DataFrame:
    """Distinct ``(pattern, value, kind)``; kind is null for tokens that no base pattern matched."""
    sides = ("left", "right", "left2", "right2")
    one = found.select(F.explode(F.concat(*KINDS, "token")).alias("s")).select("s.kind", F.lower("s.value").alias("value"), *[f"s.{c}" for c in sides]).distinct()
    shape, prefix = _shape(F.col("value")), F.regexp_extract("value", "^[^0-9]+", 0)
    has = {c: F.col(c) != "" for c in ("left", "right")} | {c: F.contains(c, F.lit(" ")) for c in ("left2", "right2")}

    def pattern(mark: str, test: Column, *parts: str | Column) -> Column:
        return F.when(test, F.concat_ws(" ", F.lit(mark), *parts))
    patterns = F.array(pattern("<", has["left"], "left"), pattern(">", has["right"], "right"), pattern("=", has["left"] & has["right"], "left", "right"),
                       pattern("<<", has["left2"], "left2"), pattern(">>", has["right2"], "right2"), pattern("#", F.lit(True), shape),
                       pattern("^", prefix != "", prefix), pattern("#<", has["left"], shape, "left"))
    return one.select(F.explode(F.array_compact(patterns)).alias("pattern"), "value", "kind").distinct()


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """``(value, kind, belief)`` of tokens that confident patterns hold."""
    edges = staged(edges, "edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("kind IS NOT NULL").select("pattern", "kind", F.lit(1.0).alias("belief"))
    tokens = edges.where("kind IS NULL").select("pattern", "value")
    belief = None
    for _ in range(rounds):
        held = seeds if belief is None else seeds.union(tokens.join(belief, "value").select("pattern", "kind", "belief"))
        known = held.groupBy("pattern", "kind").agg(F.sum("belief").alias("held")).where(F.col("held") >= support - 0.5)
        sure = known.join(size, "pattern").withColumn("sure", F.col("held") / (F.col("n") + 1)).where(F.col("sure") >= confidence)
        doubt = F.sum(F.ln(1 - F.col("sure")))
        found = tokens.join(sure, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        best = found.groupBy("value").agg(F.max(F.struct("belief", "kind")).alias("b")).select("value", "b.kind", "b.belief")
        belief = staged(best, "beliefs")
    return belief.where(F.col("belief") >= confidence)


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base (array of spans), extra (array of spans), the counts of the base kinds."""
    found = staged(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "spans")
    believed = bootstrap(_edges(found))
    tokens = found.select("row", F.explode("token").alias("s")).select("row", "s.from", "s.to", F.lower("s.value").alias("value"))
    places = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, 4 + i)]), F.col("kind"))
    one = F.struct("from", places.alias("place"), "to", F.concat("kind", F.lit("_context")).alias("kind"))
    extra = tokens.join(believed, "value").groupBy("row").agg(F.collect_list(one).alias("extra"))
    plain = "transform({}, s -> named_struct('from', s.from, 'place', s.place, 'to', s.to, 'kind', s.kind))"
    base = plain.format("concat(" + ", ".join(KINDS) + ")")
    none = F.expr("CAST(array() AS array<struct<from:int,place:int,to:int,kind:string>>)")
    return found.join(extra, "row", "left").select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.expr(base).alias("base"),
                                                   F.coalesce("extra", none).alias("extra"))


def scan_private(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return private_spans(docs, **columns).select(
        "doc_id", *[f"n_{k}" for k in KINDS], S.digest(F.expr(S.joined("base"))).alias("base_sha256"), F.expr(S.joined("concat(base, extra)")).alias("spans"))
