"""Language identification by compression.

Every language gets a raw-content Zstandard dictionary, made of blocks of labelled texts. A text
is cut into blocks; each block is compressed with every dictionary, the sizes are summed over the
whole text, and the language with the smallest sum wins. The margin is how much larger the second
smallest sum is, relative to it; a text with a narrow margin, or without letters, is rejected.

The training sample is bounded: ``DOCS`` labelled texts per language, those with the smallest hash
of their id, and of their distinct blocks the ``BLOCKS`` with the smallest hash. Prediction reads
the text alone.

Defined results: a null text, an empty one and one without letters is ``und`` with score 0; equal
sizes go to the language first by code point; with no language learned everything is ``und``;
null ids are never learned from and not held out; repeated rows get equal answers; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, id_of

FOLDS = 5  # documents of fold 0 are held out
DOCS = 400  # labelled texts per language
BLOCK = 2048  # characters compressed together, and of a piece of a dictionary
BLOCKS = 64  # pieces of a dictionary
PARTS = 16  # of a language, when its sample is chosen
LEVEL = 3
MARGIN = 0.002  # narrower relative margins are rejected


def held_out(id_col: str = "doc_id"):
    fold = F.crc32(id_of(id_col).cast("string")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def _smallest(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The ``most`` rows of each language with the smallest hash of ``name``.

    Salted parts of a language choose first, so that a language with most rows is not one task's work.
    """
    part, n = F.pmod(F.xxhash64(name), F.lit(PARTS)), F.col("_n")
    order = [F.xxhash64(name), F.col(name)]
    for key in (["lang", part], ["lang"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(n <= most).drop("_n")
    return rows


def dictionaries(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 docs: int = DOCS, blocks: int = BLOCKS) -> dict[str, bytes]:
    """Raw dictionary content per language, from a sample bounded by ``docs`` and ``blocks``."""
    rows = labelled.select(id_of(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    chosen = _smallest(rows.select("lang", "doc_id"), "doc_id", docs).distinct()
    texts = rows.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most ``docs`` ids per language
    places = F.sequence(F.lit(0), F.expr(f"int((char_length(text) - 1) div {BLOCK})"))
    pieces = texts.where("text <> ''").select("lang", F.explode(places).alias("i"), "text").select(
        "lang", F.expr(f"substring(text, i * {BLOCK} + 1, {BLOCK})").alias("piece")).distinct()
    best = _smallest(pieces, "piece", blocks)
    found: dict[str, list[str]] = {}
    for r in best.orderBy("lang", F.xxhash64("piece"), "piece").collect():
        found.setdefault(r["lang"], []).append(r["piece"])
    return {k: "\n".join(found[k]).encode() for k in sorted(found)}


class Sizes:
    """Compressed sizes of a text under every dictionary."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        import zstandard as z
        self.langs = sorted(content)
        self.packers = []
        for k in self.langs:
            d = z.ZstdCompressionDict(content[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: str) -> list[int]:
        blocks = [text[i:i + BLOCK].encode("utf-8", "surrogatepass") for i in range(0, len(text), BLOCK)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def best(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest size, and the margin to the second."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        order = sorted(zip(self.of(text), self.langs))
        return order[0][1], (1.0 if len(order) == 1 else 1.0 - order[0][0] / order[1][0])


def predict(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the margin, 0 to 1), rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(content)  # bounded: ``BLOCKS`` pieces per language

    def run(batches):
        sizes = Sizes(sent.value)
        for b in batches:
            found = [sizes.best(t) for t in b.column("text").to_pylist()]
            score = [s for _, s in found]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([k for k, _ in found], pa.string()), pa.array(score, pa.float64()),
                pa.array([k == "und" or s < margin for k, s in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])
    return docs.select(id_of(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")


def kept_rows(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected. With no language learned there
    is nothing to reject by: every text with a letter stays."""
    sent = docs.sparkSession.sparkContext.broadcast(content)
    sizes: list[Sizes] = []

    @F.pandas_udf("boolean")
    def accepted(text):
        if not sizes:
            sizes.append(Sizes(sent.value))
        if not sizes[0].langs:
            return text.map(lambda t: bool(t) and any(map(str.isalpha, t)))
        return text.map(lambda t: (lambda k, s: k != "und" and s >= margin)(*sizes[0].best(t)))

    keep = fresh(docs, "_keep")
    return docs.withColumn(keep, accepted(F.col(text_col).cast("string"))).where(F.col(keep)).drop(keep)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents outside fold 0, predict every document."""
    content = dictionaries(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, content, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
