import zlib
from collections import Counter, defaultdict

import pytest

from lettermill.llm import mixing, sharding
from tests.llm.conftest import CLASHING, DATA, EDGES


def check_shards(rows, n):
    """Contiguous in order of id (null first), gapless, balanced to a document."""
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    low = -(2**63)
    total, most, last = sum(r.size for r in rows), max((r.size for r in rows), default=0), low
    for s in sorted(by):
        got = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in got] == list(range(len(got)))
        ids = [low if r.doc_id is None else r.doc_id for r in got]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    assert all(abs(sum(r.size for r in by[s]) - total / n) <= most for s in range(n))


def test_shards_of_documents(spark, texts):
    rows = sharding.op1_shard_bytes(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.grown_shard is None for r in rows)
    check_shards(rows, 8)
    total, run, want, slots = sum(r.size for r in rows), 0, {}, Counter()
    for r in sorted(rows, key=lambda r: r.doc_id):  # a row goes to the shard of its middle byte
        shard = min((2 * run + r.size) * 8 // (2 * total), 7)
        want[r.doc_id] = (shard, slots[shard])
        slots[shard] += 1
        run += r.size
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want


def test_a_very_long_text_fills_a_shard(spark):
    rows = [(k, "x" * (3_000_000 if k == 7 else 100)) for k in range(20)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check_shards(got, 4)
    taken = mixing.mix(spark.createDataFrame([(k, " ".join(["w"] * (400_000 if k == 7 else 10)), "s") for k in range(20)],
        "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in taken) == round(1.5 * (400_000 + 190)) and max(r.taken / r.size for r in taken) <= 2


def test_shards_of_edge_cases(edges, nothing):
    out = sharding.shard(edges, 3)
    rows = out.collect()
    assert len(rows) == len(EDGES) and set(out.columns) == {*edges.columns}
    check_shards(rows, 3)
    assert sharding.shard(nothing).count() == 0


def test_a_hot_id_is_spread(spark):
    frame = spark.createDataFrame([(5 if k % 3 else k, f"t{k}") for k in range(600)], "doc_id long, text string")
    check_shards(sharding.shard(frame, 4).collect(), 4)


def test_reruns_agree(spark):
    assert sorted(map(tuple, sharding.op1_shard_bytes(spark, DATA).collect())) == sorted(map(tuple, sharding.op1_shard_bytes(spark, DATA).collect()))


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 3}, {"a": 0, "b": 7}, {"a": 0}, {"": 5, "b": 5, "c": 90,
    "d": 4, None: 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, budget, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:  # share, stop those above their cap, share again
        level = budget / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not above:
            break
        want |= {s: 2 * sizes[s] for s in above}
        budget -= sum(2 * sizes[s] for s in above)
        open_ -= above
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix_of_documents(spark, texts):
    rows = mixing.op9_mix(spark, DATA).collect()
    taken, target = Counter(), {}
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        assert r.size == len(texts[r.doc_id].split()) and 0 <= r.taken <= 2 * r.size
        taken[sources[r.doc_id]] += r.taken
        target[sources[r.doc_id]] = r.target
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op9_mix(spark, DATA).collect()))


def test_mix_of_edge_cases(edges, nothing):
    out = mixing.mix(edges)
    rows = out.collect()
    assert len(rows) == len(EDGES) and all(r.size == 0 and r.taken == 0 for r in rows if not (r.text or "").strip())
    assert {c for c in CLASHING if c not in ("size", "taken", "target")} <= set(out.columns)
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_rows(edges)
    assert mixed.columns == edges.columns and all(r.text.strip() and r["size"] == "0" for r in mixed.collect())
