"""Tokens, token files and packing: exact round trips and brute force."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import packing, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = tokens.Encoder(PATH)


def ids_of(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB é\n\t'.,!s0\x1c\xa0\0Ä|<>endoftx"), max_size=60) | st.text(max_size=40))
def test_words_give_the_ids_of_whole_texts(text):
    assert np.frombuffer(ENCODER.encode([text])[0], tokens.ID).tolist() == ids_of(text, 0)[:-1]


@pytest.mark.parametrize("end", ["", "\n", " end", "\n\nend"])
@pytest.mark.parametrize("start", ["", "\n", "start "])
def test_many_lines_without_a_space(start, end):
    text = start + "\n".join(["word", "x1", "Ä.", "5,", "字"] * 1000) + end
    assert np.frombuffer(ENCODER.encode([text])[0], tokens.ID).tolist() == ids_of(text, 0)[:-1]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some  Words, here."
    assert np.frombuffer(tokens.Encoder(path).encode([text])[0], tokens.ID).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded():
    small = tokens.Encoder(PATH, remembered=5)
    for text in ("one two three four five six seven eight", "nine ten one two", "x" * 200 + " " + "y" * 200):
        assert np.frombuffer(small.encode([text])[0], tokens.ID).tolist() == ids_of(text, 0)[:-1]
    assert "y" * 200 not in small.words


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packed_ids_unpack_anywhere(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(tokens.ID)
    data = token_files.pack(ids, bits, block_ids=64)
    assert (token_files.unpack(data) == ids).all()
    for a, b in [(0, 0), (0, 1), (63, 65), (64, 128), (500, 1000), (999, 5000)]:
        assert (token_files.unpack(data, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_files.pack(np.array([1 << bits], np.uint64).astype(np.uint64), bits) if bits < 32 else token_files.unpack(b"none" + data[4:])
    assert len(token_files.unpack(token_files.pack(ids[:0], bits))) == 0


def test_token_files(spark, edge, empty, tmp_path):
    path = token_files.write_tokens(edge, PATH, 0, str(tmp_path / "t"), segment_ids=50)
    got = token_files.read_tokens(spark, path).collect()
    rows = sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = Counter((r.doc_id, tuple(ids_of(r.text, 0))) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, tokens.ID).tolist())) for r in got) == want
    path = token_files.write_tokens(empty, PATH, 0, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, path).count() == 0


def bins_of(patterns):
    return sum(t for t, _ in patterns)


def contents(patterns):
    return Counter({x: n for x, n in sum((Counter({x: t * n for x, n in p}) for t, p in patterns), Counter()).items()})


def optimum(items, capacity):
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {rooms.index(r) for r in rooms if r >= items[i]}:
            place(i + 1, sorted([*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]]))
        place(i + 1, sorted([*rooms, capacity - items[i]]))

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    for _ in range(40):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        patterns = packing.bin_completion(Counter(items), 20)
        assert contents(patterns) == Counter(items) and all(sum(x * n for x, n in p) <= 20 for _, p in patterns)
        assert bins_of(patterns) == optimum(items, 20) >= packing.lower_bound(Counter(items), 20)


def test_bin_completion_on_large_counts():
    rng = random.Random(6)
    counts = Counter({x: rng.randint(0, 500) for x in range(1, 129)})
    patterns = packing.bin_completion(counts, 128, nodes=500)
    assert contents(patterns) == +counts and all(sum(x * n for x, n in p) <= 128 for _, p in patterns)
    assert packing.lower_bound(counts, 128) <= bins_of(patterns) <= bins_of(packing.best_fit(counts, 128))
    with pytest.raises(ValueError):
        packing.bin_completion({129: 1}, 128)
    assert packing.bin_completion({}, 128) == []


def test_packed_documents(spark, edge, empty):
    placed = packing.packed(packing.token_pieces(edge, PATH, 64, 2), 64)
    got = placed.collect()
    want = Counter()
    for r in edge.select("doc_id", "text").collect():
        ids = ids_of(r.text, 2)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], tokens.ID).tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *itertools.accumulate(n for _, n in parts[:-1])] and sum(n for _, n in parts) <= 64
    assert len(places) == bins_of(packing.bin_completion(Counter(r.length for r in got), 64))
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert set(whole) == set(places)
    for r in got:
        assert whole[r.sequence_id].ids[r.offset * 4 : (r.offset + r.length) * 4] == r.ids
    assert packing.packed(packing.token_pieces(empty, PATH), 1024).count() == 0
