"""Registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import mixing, packing, quality, registry, simhash
from tracelake.llm.queries import tokenizer

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    verdict, _, detail = compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLES[name])
    assert verdict == "ok", detail


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d+_", q)}
    assert "pipeline" in entry.queries() and set(ORACLES) == set(entry.oracle_sql()) & set(QUERIES)


def test_rerun_agrees(spark):
    for name in ("op1_bin_completion_packing", "op2_consistent_hash_shards", "op9_mix_sources"):
        first, second = (Counter(map(tuple, QUERIES[name](spark, SF_DIR).collect())) for _ in range(2))
        assert first == second


def test_pipeline(spark, tmp_path):
    """Every stage by hand, on documents that hold exact copies and near copies."""
    base = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    copies = base.filter("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 10_000)
    near = base.filter("doc_id BETWEEN 30 AND 59 AND n_chars > 3000").withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.concat("text", F.lit(" tail")))
    base.union(copies).union(near).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.collect()

    scorer = quality.train(docs, labels)
    score = scorer.score(np.array([quality.features(r.text or "") for r in rows]))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= corpus_pipeline.GOOD]
    best = {}
    for r in sorted(rows, key=lambda r: -r.doc_id):
        best[hashlib.sha256(re.sub("[A-Z]", lambda m: m[0].lower(), r.text).encode()).digest()] = r
    rows = list(best.values())
    prints = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
        if not changed:
            break
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]].append(r)
    rows = [min(g, key=lambda r: r.doc_id) for g in least.values()]
    ids = {r.doc_id for r in rows}
    assert not any(i + 10_000 in ids and i in ids for i in range(30))
    copies = {r.doc_id: r.copies for r in mixing.mix_table(docs.filter(F.col("doc_id").isin(*ids))).collect()}
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(tokenizer()), Counter()
    for r in rows:
        x = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(x) % 1024 or 1024, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += copies[r.doc_id]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    used = len({r.sequence_id for r in got})
    assert used == sum(t for t, _ in packing.bin_completion(Counter(r.length for r in got), 1024))


def test_stages_keep_the_columns(spark, edge, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage is not None and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
