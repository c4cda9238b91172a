"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, simhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def check_exact(rows, got, largest):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(lowered(text).encode()).hexdigest()].append(doc_id)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256])
        assert r.keep_id == ((max if largest else min)(ids) if ids else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) <= {1} and set(kept) == set(groups)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(edge, keep):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    check_exact(rows, exact_dedup.exact_groups(edge, keep).collect(), keep == "largest")


def test_colliding_hashes_do_not_merge_texts(edge):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    weak = exact_dedup.exact_groups(edge, "largest", digest=lambda text: F.unhex(F.substring(F.md5(text), 1, 2).substr(1, 0)))
    check_exact(rows, weak.collect(), True)


def test_drop_copies_keeps_all_columns(edge, empty):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in edge.collect()})
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edge):
    for r in simhash.fingerprints(edge).join(edge.select("doc_id", "text"), "doc_id").collect():
        if len(r.text or "") < 1000:
            assert r.bits % (1 << 64) == brute_fingerprint(r.text)


def test_codewords_meet():
    """A word and a word one bit away meet at the second one's codeword; the code is perfect."""
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    near = simhash.nearby_codewords(words)
    for bit in range(23):
        assert (near == simhash.nearby_codewords(words ^ (1 << bit))[:, :1]).any(1).all()
    _, leader, other = simhash.golay_tables()
    assert sorted(np.bitwise_count(leader).tolist()).count(3) == 1771 and other.shape == (2048, 5)


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_links_and_components_on_dense_chains(spark):
    """Chains, dense groups and far values; each step flips up to three bits."""
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 30])):
            prints.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            x = y if rng.random() < 0.7 else x
            prints.add(y)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "bits long")
    links = {(r.a, r.b) for r in simhash.links(df).collect()}
    near = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3}
    assert links == near and near
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(prints)
    for i, s in enumerate(signed):
        members = [signed[j] for j in range(len(prints)) if want[j] == want[i]]
        assert roots.get(s, s) == min(members)


def test_near_groups(edge, empty):
    got = simhash.near_groups(edge).collect()
    assert len(got) == edge.count()
    zero = [r for r in got if r.bits == 0]
    assert {r.doc_id for r in zero} == {5, 6, 7, None} and {r.component_id for r in zero} == {5}
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == 1 and by_id[9].component_id == 8 and by_id[14].component_id == 11
    kept = simhash.drop_near_copies(edge)
    assert kept.columns == edge.columns and {2, 9, 14, 6, 7}.isdisjoint({r.doc_id for r in kept.collect()})
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_unique_texts_without_an_id_stay(spark, edge):
    """Rows of other components do not compete, whatever ids they have."""
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_copies(edge).collect()]
    assert (None, "no id here") in kept and (None, None) not in kept
    rows = [(None, "one text without an id"), (None, "quite another story of the sea"), (4, "the first text of number four"), (4, "something else of that number"), (4, "something else of that number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(simhash.drop_near_copies(docs).collect(), key=str) == sorted(set(rows), key=str)
