"""Mixing, SentencePiece, token counts, WARC, top-k search, the pipeline."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candlewick.llm import mixing, queries, spm, tokencount, topk, warc
from candlewick.llm.common import staged

SF = "/root/testdata/sf0.001"


# -- mixing
@pytest.fixture(scope="module")
def mixed_docs(spark):
    rng = random.Random(7)
    size = {"a": 3, "b": 60, None: 10, "c": 900, "d": 30, "e": 200}
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 80))), s) for i, s in enumerate(s for s, n in size.items() for _ in range(n))]
    rows += [(5000, None, "b"), (5001, " \n ", None), (None, "three words here", "z"), (7, "same row", "a"), (7, "same row", "a")]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, size int, taken string")


def test_mix_reaches_its_targets(mixed_docs):
    got = mixing.mix(mixed_docs, block=8).collect()
    assert len(got) == mixed_docs.count()
    per: dict = {}
    for r in mixed_docs.collect():
        per[r["source"]] = per.get(r["source"], 0) + len(brute.words(r["text"]))
    want, taken = brute.mix_targets(per), dict.fromkeys(per, 0)
    for r in got:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= max(40, 0.01 * want[s]), (s, taken[s], want[s])
    again = sorted(tuple(r) for r in mixing.mix(mixed_docs.repartition(5), block=8).select(F.coalesce("doc_id", F.lit(-1)), "size", "taken").collect())
    assert again == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["taken"]) for r in got)


def test_mixed_rows_repeat_documents(mixed_docs, nothing, hostile):
    out = mixing.mixed_rows(mixed_docs, block=8)
    assert out.columns == mixed_docs.columns
    copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(v for k, v in copies.items() if k != 7) <= 3 and 5000 not in copies
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    assert mixing.mix(hostile).count() == hostile.count()


def test_slots_follow_the_golden_ratio(spark):
    sources = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 0.0), (3, 20.0)], "s long, target double")
    got = mixing.schedule(sources, 10_000, 4, block=1).groupBy("s").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.countDistinct("r").alias("d")).collect()
    for r in got:
        assert abs(r["n"] - {0: 5000, 1: 3000, 3: 2000}[r["s"]]) <= 5 and (r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"])


# -- SentencePiece
ODD = ["", " ", "  ", "   x", "a  b", "\n", "\n\n a\nb", "x" * 50, "aaaa aaaaaaaaaaaa", "é①ﬁ", "tab\there", " " * 40 + "z" + " " * 17, "漢字かな交じり文",
       "a\u0000b", "<s> </s> <unk> <0x0A>", "\U0001f642\U0001f642 \U0001f642", "ing" * 300, "\r\n x", "0" * 13, "-----==----- ======== ////////", "https://www.example.com/index.html?a=1&b=22222",
       "supercalifragilisticexpialidocious antidisestablishmentarianism"]


@pytest.fixture(scope="module")
def vocabulary():
    return spm.load()


def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def test_ids_equal_the_library(vocabulary, spark):
    coder, sp = spm.Coder(vocabulary), library()
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == sp.encode(text), text[:80]
        assert coder.decode(ids.tolist()) == text


def test_random_strings_equal_the_library(vocabulary):
    rng, coder, sp = random.Random(5), spm.Coder(vocabulary), library()
    texts = ["".join(rng.choices("abcdefgeinrst  \n.,-ABC01éß中\U0001f642", k=rng.randint(0, 60))) for _ in range(3000)]
    assert [i.tolist() for i in coder.encode(texts)] == [sp.encode(t) for t in texts]


def test_small_cache_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(spm, "CACHE", 3)
    coder = spm.Coder(vocabulary)
    for _ in range(3):
        assert coder.encode(["one two three four"])[0].tolist() == library().encode("one two three four")


def test_encode_and_decode_over_spark(hostile, nothing):
    got = spm.encode(hostile)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got.collect())
    back = sorted((str(r["doc_id"]), r["text"]) for r in spm.decode(got).collect())
    assert back == sorted((str(r["doc_id"]), r["text"] or "") for r in hostile.collect())
    assert spm.encode(nothing).count() == 0


# -- token counts
def flat(tmp_path, name, tokens):
    path = tmp_path / name
    np.array(tokens, dtype="<u2").tofile(path)
    return str(path)


@pytest.mark.parametrize("block", [2, 6, 10, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    eod, rng = tokencount.SEPARATOR, random.Random(block)
    lengths = {flat(tmp_path, "empty", []): []}
    for name, rest in (("a", 0), ("b", 3), ("c", 0)):
        own = [rng.choice((0, 0, 1, 2, 7, 31)) for _ in range(40)]
        lengths[flat(tmp_path, name, [t for n in own for t in [*rng.choices(range(100), k=n), eod]] + [5] * rest)] = own + [rest] * (rest > 0)
    got = {}
    for r in tokencount.documents(tokencount.blocks(spark.createDataFrame([(p,) for p in lengths], "path string"), block)).collect():
        got.setdefault(r["path"], {})[r["ordinal"]] = r["n_tokens"]
    assert got == {p: dict(enumerate(n)) for p, n in lengths.items() if n}


def test_token_counts_equal_the_tokenizer(hostile, nothing):
    with open(tokencount.VOCABULARY, "rb") as f:
        encode = tokencount.encoder(f.read()).encode_ordinary
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or ""))) for r in hostile.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.token_counts(hostile, block=64).collect()) == want
    assert tokencount.token_counts(nothing).count() == 0


# -- WARC
@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/x y\r\nz", "<p>one</p>"), (2, None, None), (3, "http://b", ""), (4, "http://c", "<p>one</p>"), (None, "http://d", "<p>one</p>"),
            (5, "http://e", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "http://f", "x" * 2_000_000), (7, "http://g", "<p>two</p>"), (7, "http://g", "<p>two</p>")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_archive_round_trip(pages, spark):
    index = warc.write_bundles(pages, frame=64)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_bundles(index).collect()}
    assert got == {(1, "revisit", 4, 10), (4, "response", None, 10), (None, "revisit", 4, 10), (2, "revisit", 3, 0), (3, "response", None, 0),
                   (5, "response", None, 48), (6, "response", None, 2_000_000), (7, "response", None, 10)}
    assert warc.read_bundles(index).count() == pages.count() == index.count()
    one = warc.read_records(index.where("record_id = '<urn:page:5>'")).collect()
    assert [bytes(r["payload"]).decode() for r in one] == ["é\r\n\r\nWARC/1.1\r\n" * 3]
    assert warc.archive(pages.limit(0)).count() == 0


def test_bundles_are_plain_zstandard(pages):
    import io

    import zstandard
    index = warc.write_bundles(pages.coalesce(1), frame=1 << 20).collect()
    path = index[0]["path"]
    with open(path.removeprefix("file://"), "rb") as f:
        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert raw.count(b"WARC-Record-ID: ") == sum(r["path"] == path for r in index)
    reader = warc.Reader(path)
    assert len(reader.entries) >= 2 and sum(e[1] for e in reader.entries) == len(raw)


def test_short_payloads_need_no_revisit(pages):
    types = [r["record_type"] for r in warc.read_bundles(warc.write_bundles(pages, least=11)).collect()]
    assert set(types) == {"response"}


# -- top-k
@pytest.mark.parametrize("block,size", [(4, 16), (128, 1 << 15)])
def test_top_k_is_exact(spark, block, size):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(150)]
    rows += [(3, rows[3][1]), (200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, []), (240, [1.0, 2.0]), (None, [2.0] * 6), (260, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    live = [(i, np.floor(64 * np.pad(np.array(v, dtype=np.float32).astype(float), (0, 6 - len(v)))).astype(int)) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for n, (q, x) in enumerate(live):
        if q is not None and q % 20 == 0:
            found = sorted(((-int(x @ y), i is None, i or 0) for m, (i, y) in enumerate(live) if m != n))[:7]
            want += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(found)]
    got = [tuple(r) for r in topk.top_k(df, 7, block=block, size=size).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert topk.top_k(df.limit(0)).count() == 0


def test_repeated_query_packs_are_not_broadcast(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    found = topk.scored(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), size=16, block=4)
    assert found.where("q_at IS NULL").count() >= 25  # packs
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1000, 4096))[:, None] * np.ones((1, 4), dtype=np.int64)
    cuts = np.arange(0, len(x), 64)
    score, at, visited = topk.best_in_pack(np.ones((1, 4), dtype=np.int64), np.array([-1]), x, np.arange(len(x)), np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts), 5, 64)
    assert score[0].tolist() == sorted((4 * x[:, 0]).tolist())[::-1][:5] and visited <= 2


def test_large_components_use_whole_numbers():
    big = np.array([[1 << 40, 3], [1 << 40, 2]])
    score, _, _ = topk.best_in_pack(big[:1], np.array([0]), big, np.arange(2), big.max(0)[None], big.min(0)[None], 2, 2)
    assert score[0, 0] == ((1 << 80) + 6) % (1 << 64) and score[0, 1] == topk.NONE


# -- queries and pipeline
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    df, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = staged(stage(spark, df, SF), name)
        assert df.columns == docs.columns
        counts.append(df.count())
        if name in ("language", "exact_dedup", "near_dedup"):
            assert df.select("doc_id").distinct().count() == df.count()
        if name == "near_dedup":
            fps = {r["doc_id"]: brute.fingerprint(r["text"]) for r in df.collect()}
            assert len(set(brute.component_ids(fps).values())) == len(fps)
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert last.count() == counts[-1] and last.where("NOT round_trip").count() == 0


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_long_units_without_blanks():
    import random
    import time

    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    rng = random.Random(9)
    coder = spm.Coder(spm.load())
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/é漢"
    texts = ["".join(rng.choices(letters, k=n)) for n in (1023, 1024, 1025, 2500, 7001)] + ["a" * 6000, "ab" * 4000, "http" * 900 + "-" * 3000, "=" * 5000, "thequickbrownfox" * 400,
                                                                                     "x " + "é" * 2000 + "\n" + "0" * 3000 + " y"]
    for t, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(t), t[:20]
    long = "".join(rng.choices(letters, k=1_000_000))
    began = time.process_time()
    ids = coder.encode([long])[0]
    assert time.process_time() - began < 30 and coder.decode(ids.tolist()) == long


def test_round_trip_is_told_of_the_text_itself(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a▁b"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in spm.encode(df).collect()} == {1: True, 2: False, 3: True}


def test_scan_and_read_back_are_dealt_to_many_tasks(spark, tmp_path):
    paths = []
    for i in range(3):
        p = tmp_path / f"{i}.tokens"
        np.full(64_000, 7, dtype="<u2").tofile(p)
        paths.append((str(p),))
    scanned = tokencount.blocks(spark.createDataFrame(paths, "path string"), 1000)
    assert scanned.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and scanned.count() == 3 * 128
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "repeat(concat('p', id), 600) AS html").repartition(1)
    read = warc.read_bundles(warc.write_bundles(pages, frame=4000), stretch=5)
    met = read.selectExpr("spark_partition_id() AS p", "page_id").collect()
    assert len({r["p"] for r in met}) >= spark.sparkContext.defaultParallelism and sorted(r["page_id"] for r in met) == list(range(400))


def test_shared_bounds_and_ordered_blocks_prune(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12))
    rows = [(int(i), (centres[i % 30] + rng.normal(size=12) * 0.02).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert topk.visited_share(df, block=32) < 0.4
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, 5, block=32, size=700, sample=50).collect()}
    for q in range(0, 4000, 400):
        s = x @ x[q]
        best = sorted((-int(s[i]), i) for i in range(4000) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -v) for v, i in best]
