"""Exact dedup and SimHash against brute force."""

import random
import re
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from candlewick.llm import common, cuckoo, langid, mixing, simhash


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(1)
    index, live = cuckoo.CuckooIndex(log2=1), {}
    keys = [rng.randbytes(32) for _ in range(3000)]
    for k in [*keys, *rng.choices(keys, k=2000)]:
        assert index.insert(k, 1, 5, 9) == (k not in live)
        live[k] = live.get(k, 0) + 1
    assert index.log2 > 1 and index.live == len(live)
    for k in rng.sample(keys, 1500):
        assert index.delete(k, live.pop(k), 5, 9)
        assert index.stored(k) is None and not index.delete(k, 1, 5, 9)
    assert all(index.stored(k)[0] == n for k, n in live.items())
    again = cuckoo.CuckooIndex.of_rows(index.rows(3))
    assert again.live == len(live) and all(again.stored(k)[0] == n for k, n in live.items())
    assert not any(again.seems_known(k) and again.stored(k) for k in set(keys) - set(live))


def test_best_row_is_the_longest_then_the_smallest_id():
    index = cuckoo.CuckooIndex()
    for points, doc in ((3, 8), (5, None), (5, 9), (5, 4), (4, 1)):
        index.insert(b"k" * 32, 1, points, doc)
    assert index.stored(b"k" * 32) == [5, 5, 4]


def test_exact_dedup_of_hostile_rows(hostile):
    got = cuckoo.exact_dedup(hostile).collect()
    groups = defaultdict(list)
    rows = hostile.select("doc_id", "text").collect()
    for r in rows:
        groups[re.sub(brute.SPACE, "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
    want = []
    for r in rows:
        key = re.sub(brute.SPACE, "", r["text"] or "")
        best = min(groups[key], key=lambda x: (x[0], x[1], x[2] or 0))
        want.append((r["doc_id"], best[2], len(groups[key]), (best[0], best[2]) == (-len(r["text"] or ""), r["doc_id"]), brute.sha256(key)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_kept_rows_have_one_of_each_text(hostile, nothing):
    kept = cuckoo.kept_rows(hostile)
    assert kept.columns == hostile.columns
    texts = [re.sub(brute.SPACE, "", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(brute.SPACE, "", r["text"] or "") for r in hostile.collect()})
    assert cuckoo.kept_rows(nothing).count() == 0 and cuckoo.exact_dedup(nothing).count() == 0


def test_index_changes_over_spark(spark, hostile):
    found = common.staged(cuckoo.digests(hostile), "digests")
    index = common.staged(cuckoo.apply_changes(None, found, shards=4), "index")
    after = cuckoo.apply_changes(index, found.where("doc_id = 9"), found.where("doc_id IN (1, 10)"), shards=4)
    live = {bytes(r["digest"]): r["copies"] for r in after.where("digest IS NOT NULL").collect()}
    key = {r["doc_id"]: bytes(r["digest"]) for r in found.collect()}
    before = {bytes(r["digest"]): r["n"] for r in found.groupBy("digest").agg(F.count("*").alias("n")).collect()}
    assert live[key[9]] == 2 and key[10] not in live and live[key[1]] == before[key[1]] - 1


def test_simhash_of_hostile_rows(hostile, nothing):
    rows = hostile.where("doc_id IS NOT NULL").collect()
    fps = {r["doc_id"]: brute.fingerprint(r["text"]) for r in rows}
    want = brute.component_ids(fps)
    got = simhash.near_dedup(hostile).collect()
    assert len(got) == hostile.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])
    assert simhash.near_dedup(nothing).count() == 0


def _graph(spark, fps, bits, bucket):
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in common.components(simhash.links(nodes, bits, bucket)).collect()}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    parts = defaultdict(set)
    for f in fps:
        parts[roots.get(signed[f], signed[f])].add(f)
    return {frozenset(p) for p in parts.values()}


def test_small_and_large_buckets_link_the_same(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):  # dense families and chains around random centres
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 1, 2, 2, 3))))
    fps = sorted(fps)
    for bits in (1, 2):
        ids = brute.component_ids(dict(enumerate(fps)), bits)
        want = defaultdict(set)
        for i, f in enumerate(fps):
            want[ids[i]].add(f)
        for bucket in (0, 3, 1000):
            assert _graph(spark, fps, bits, bucket) == {frozenset(p) for p in want.values()}, (bits, bucket)


def test_long_chain_settles(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r["root"] for r in common.components(edges).collect()} == {0}


def test_near_rows_kept_once(hostile):
    rows = hostile.collect()
    kept = simhash.kept_rows(hostile)
    assert kept.columns == hostile.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = defaultdict(list)
    fps = [brute.fingerprint(r["text"]) for r in rows]
    roots = brute.component_ids(dict(enumerate(fps)))
    for k, r in enumerate(rows):
        groups[roots[k]].append((r["doc_id"], r["text"]))
    assert len(got) == len(groups)
    for g in groups.values():  # exactly one of each, with the smallest id
        mine = [x for x in got if x in g]
        assert len(mine) == 1 and mine[0][0] == min((i for i, _ in g if i is not None), default=None)


def test_distinct_texts_with_one_id_or_none_stay(spark):
    far = ["alpha beta gamma delta epsilon", "one two three four five six seven", "red green blue black white"]
    df = spark.createDataFrame([(None, far[0]), (None, far[1]), (5, far[0]), (5, far[2]), (6, far[0]), (6, far[0])], "doc_id long, text string")
    assert sorted(map(tuple, simhash.kept_rows(df).collect()), key=str) == [(5, far[0]), (5, far[2]), (None, far[1])]
    assert sorted(map(tuple, cuckoo.kept_rows(df).collect()), key=str) == [(5, far[0]), (5, far[2]), (None, far[1])]


HELPERS = """_keep _nth _digest _points _w_digest _w_points _w_id _id _source _th _times _n _k _elect_key _elect_winner _elect_nth _elect_hash _mix_id _mix_source _mix_text
_mix_times _mix_nth key fp h th doc times root best none node u v s b target digest points keep_id copies""".split()


@pytest.mark.parametrize("kept", [simhash.kept_rows, cuckoo.kept_rows, mixing.mixed_rows, lambda d: langid.kept_rows(d, {"en": b"the cat sat on the mat", "de": b"der die das"})])
def test_columns_named_like_helpers(hostile, kept):
    plain = hostile.select("doc_id", "text", "lang", "source", "n_chars")
    named = plain.withColumns({c: F.lit(i) for i, c in enumerate(HELPERS)}).select(*[c for h in (HELPERS[:20], plain.columns, HELPERS[20:]) for c in h])
    out = kept(named)
    assert out.columns == named.columns
    some = sorted(map(str, out.select(*plain.columns).collect()))
    assert some == sorted(map(str, kept(plain).collect())) and out.where(F.col("_nth") != HELPERS.index("_nth")).count() == 0


def test_deleting_the_row_that_stays_elects_another(spark, hostile):
    rows = [(1, "a  b", 9), (2, "a b", 7), (3, "ab", 7), (4, "cc", 1), (5, "c c", 1)]
    found = cuckoo.digests(spark.createDataFrame(rows, "doc_id long, text string, x int"))
    index = common.staged(cuckoo.apply_changes(None, found, shards=4), "index")
    gone, live = found.where("doc_id IN (1, 5)"), found.where("doc_id NOT IN (1, 5)")
    after = cuckoo.apply_changes(index, found.limit(0), gone, shards=4)
    stale = {r["points"] for r in after.where("digest IS NOT NULL").collect()}
    assert stale == {cuckoo.STALE}
    again = cuckoo.reelected(common.staged(after, "index"), live)
    assert again.columns == index.columns
    assert {(r["copies"], r["points"], r["keep_id"]) for r in again.where("digest IS NOT NULL").collect()} == {(2, 3, 2), (1, 2, 4)}
    assert again.where("digest IS NULL").count() == index.where("digest IS NULL").count()


def test_pipeline_of_hostile_and_empty_tables(spark, hostile, nothing, tmp_path):
    import corpus_pipeline
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, df in (("hostile", hostile.select(*plain)), ("nothing", nothing.select(*plain))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)
        if name == "nothing":
            assert not got
        else:
            assert {7, 8} & {r["doc_id"] for r in got} and not {4, 5, 6} & {r["doc_id"] for r in got}
