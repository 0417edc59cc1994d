from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import simhash
from tests.llm.conftest import DATA
from tests.llm.test_language import brute_languages
from tests.llm.test_sharding_mixing import check_shards
from tests.llm.test_similarity import brute_near_copies, fingerprint, least_reachable


def test_each_stage_against_its_brute_force(spark, tmp_path, documents):
    docs, before = documents, {r.doc_id: r.text for r in documents.collect()}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        if name == "language":
            rows_ = documents.collect()
            told = brute_languages([(r.text, r.lang) for r in rows_], [r.text for r in rows_])
            bad = {r.doc_id for r, (lang, share) in zip(rows_, told) if lang == "und" or share < corpus_pipeline.MIN_SHARE}
            assert set(after) == set(before) - bad and len(bad) <= 0.02 * len(before)
        if name == "near_duplicates":
            assert sorted(after, key=str) == brute_near_copies(list(before.items()))
        if name == "leaks":
            flat = {i: " ".join(t.lower().split()) for i, t in before.items()}
            whole = {i for i, t in flat.items() if any(" ".join(w) in t for w in items)}
            assert whole and not whole & set(after) and len(before) - len(after) <= len(whole) + 2
        if name == "mixture":
            size, taken, by = Counter(), Counter(), defaultdict(set)
            for r in spark.read.parquet(str(tmp_path / str(k - 1))).collect():
                size[r.source] += len(r.text.split())
                by[r.source].add(len(r.text.split()))
            for r in rows:
                taken[r.source] += len(r.text.split())
            assert max(Counter(r.doc_id for r in rows).values()) <= 2 and all(taken[s] <= 2 * size[s] for s in size)
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(max(v) for v in by.values())
        if name == "shards":
            check_shards(rows, corpus_pipeline.N_SHARDS)
            assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= set(docs.columns)
        else:
            assert docs.columns == documents.columns
        before = after


def test_run_and_an_empty_table(spark, documents):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    docs = documents.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_stages_with_nulls_ties_repeats_and_clashing_names(spark, documents):
    """Columns named as the operators' results and own columns stay as they were."""
    odd = [(k, t, None, src, None) for k, (t, src) in enumerate([(None, None), ("", "a"), (" \n", None), ("12 34", "a"), ("only words", None)], 10_000)]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents.limit(40).collect()]
    rows += [*odd, *odd, *rows[:5], (None, rows[0][1], "fr", None, 1), (None, rows[0][1], "fr", None, 1)]
    docs = spark.createDataFrame(rows, documents.schema)
    names = ["score", "lang_pred", "leaks", "taken", "target", "uid", "c0", "in0", "at", "key", "fp", "sketch", "words", "copies"]
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, DATA)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for r in got for n in names)
        if name == "language":
            assert not any(r.text is None or not r.text.strip() or r.text == "12 34" for r in got) and sum(r.doc_id == rows[0][0] for r in got) == 2
        if name == "near_duplicates":
            assert len({r.text for r in got}) == len(got) and all(r.doc_id is not None for r in got)
        left = spark.createDataFrame(got, out.schema)
    named = docs.withColumnRenamed("n_chars", "Size")
    assert "Size" not in corpus_pipeline.shards(spark, named, DATA).columns and corpus_pipeline.mixture(spark, named, DATA).columns == named.columns


def test_near_copies_by_fingerprints_and_by_sketches(spark, documents):
    """Groups hang together by op5's links and by those of sketches: texts that
    mostly repeat one line, with tails of their own, are within 3 bits though few
    of their shingles agree; one is a sketch's near-copy of another alone."""
    line = " ".join(f"line{k}" for k in range(13))
    tail = lambda k, n=40: " ".join(f"t{k}x{j}" for j in range(n))
    rows = [(10_000 + k, f"{f'{line} ' * 30}{tail(k)}") for k in range(6)]
    own = tail(9, 300)
    rows += [(10_100, own), (10_101, f"{own} {tail(8, 45)}"), (10_102, tail(7, 300)), (10_103, None), (10_104, " \n")]
    rows += [(r.doc_id, r.text) for r in documents.collect()]
    prints = [fingerprint(t) for _, t in rows]
    raw = [(t or "").encode() for _, t in rows]
    words, slots = simhash.sketch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)]
    near = [(a, b) for a, b in pairs if (prints[a] ^ prints[b]).bit_count() <= 3]
    wide = simhash.similar(slots, words, *np.array(pairs).T, simhash.SIMILARITY)
    want = set(least_reachable([i for i, _ in rows], near + [p for p, ok in zip(pairs, wide.tolist()) if ok]))
    assert not want & {10_001, 10_101, 10_104} and {10_000, 10_100, 10_102} <= want
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, DATA).collect()} == want
