"""Vector codes, chat formatting and whitening against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import ann, chat, vector_codes, whitening

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def brute_codes(rows, entries=16, rounds=6, parts=8):
    """{row: (code, error)} and all entries, with Python's integers."""
    x = [[math.floor(4096 * c) for c in v] for v in rows]
    d = len(x[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for v in cut:
                mine.setdefault(nearest(p, v[p])[1], []).append(v[p])
            for e, members in mine.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [("".join(f"{i:02x}" for _, i in f), sum(s for s, _ in f)) for f in found], digest


def test_codes_with_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) + rng.choice([0, 1e-5]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[9][1], 1), (200, rows[9][1], None), (-3, rows[9][1], 2)]
    odd = [(300, None, 1), (-300, [None] * 16, 1), (-301, [NAN] + [0.0] * 15, 1), (302, [INF] * 16, None), (303, [1.0] * 8, 2), (304, [], 2), (305, [1e30] * 16, 1), (306, [1.0] * 9, 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, label int, code string").repartition(4)
    got = vector_codes.vector_codes(df).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, digest = brute_codes([r[1] for r in rows])
    total = {}
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        total[label] = total.get(label, 0) + error
    expected = [(i, label, code, error, total[label], digest) for (i, _, label), (code, error) in zip(rows, want, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    assert vector_codes.vector_codes(df.limit(0)).count() == 0 and vector_codes.vector_codes(df.filter("vec_id = 300")).count() == 0
    few = vector_codes.vector_codes(df.filter("vec_id IN (1, 2)")).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in few) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]


@pytest.mark.parametrize("m, d, fanout", [(1, 3, 4), (16, 8, 4), (16, 8, 2), (40, 2, 3), (200, 4, 5)])
def test_tree_search_is_exact_and_drops_subtrees(m, d, fanout):
    rng = np.random.default_rng(m)
    for spread in (3, 1000, 1 << 27):
        entries = rng.integers(-spread, spread + 1, (m, d))
        entries[m // 2 :: 5] = entries[0]  # equal entries
        x = np.concatenate([rng.integers(-spread, spread + 1, (500, d)), entries, (entries[: m // 2] + entries[m // 2 : m // 2 * 2]) // 2])
        index, least, measured = vector_codes.Gnat(entries, fanout).nearest(x)
        far = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all() and (least == far.min(1)).all()
        if m == 200 and spread > 3:
            assert measured < 0.6 * far.size


def test_bounds_of_roots_are_safe():
    rng = random.Random(1)
    for square in [0, 1, 2, 4, (1 << 62) - 1, (1 << 53) + 1] + [rng.randrange(1 << rng.randrange(1, 62)) for _ in range(2000)]:
        lo, hi = Fraction(float(vector_codes.below(np.int64(square)))), Fraction(float(vector_codes.above(np.int64(square))))
        assert lo * lo <= square <= hi * hi


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>[\\INST]", "<<s>s>", "[/SYS][SYS", "\\", "[ROLE] x [/ROLE] ", " a <", "é\n\n", "</s", "<s>" * 50]


def test_marks_in_texts_come_back():
    template = chat.Template()
    for text in TEXTS:
        assert chat.unescaped(chat.escaped(text)) == text
        assert not any(mark in chat.escaped(text) for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"))
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", " ", "x", "</s>", "[/INST]", "ROLE]"]) for _ in range(rng.randrange(12)))
        turns = [(rng.choice(["system", "user", "assistant", "", "tool", text]), rng.choice(TEXTS + [text])) for _ in range(5)]
        machine = chat.Machine(template)
        whole = "".join(s for r, t in turns for s, _ in machine.turn(r, t)[1])
        assert chat.Reader(template).turns(whole) == turns


def test_conversations(spark):
    long = "word " * 100_000
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, "user", "c"), (2, 0, "system", TEXTS[2]), (2, 1, "user", long), (2, 2, "assistant", TEXTS[3]),
            (3, 0, "assistant", "first"), (3, 1, "assistant", "second"), (None, None, None, None), (None, 0, "tool", "x"), (4, 0, "user", "same"), (4, 0, "user", "same"),
            (5, 1, "user", "z"), (5, 1, "user", "a"), (5, None, "assistant", "end"), (6, 0, "[/ROLE] ", "x")]
    rows += [(9, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, position string, loss string").repartition(5)
    turns = chat.formatted(df)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    text = {}
    for r in turns.orderBy("conv_id", "position").collect():
        text[r.conv_id] = text.get(r.conv_id, "") + "".join(s.text for s in r.segments)
    assert {c: chat.Reader(chat.Template()).turns(x) for c, x in text.items()} == want
    for back in (chat.read_back(turns), chat.read_back(chat.arranged(turns.repartition(7)))):
        got = {r.conv_id: r for r in back.collect()}
        assert set(got) == set(want)
        for c, said in want.items():
            learned = "".join(x for r, x in said if r == "assistant")
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
            assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(said), len(learned), len(text[c]))
            assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert {c: (r.valid, r.bad_turns) for c, r in got.items()} == {1: (False, 0), 2: (True, 0), 3: (False, 2), None: (False, 2), 4: (False, 1), 5: (False, 1), 6: (False, 1), 9: (True, 0)}
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_bidiagonal_form():
    rng = np.random.default_rng(3)
    for r in (rng.normal(size=(7, 7)), np.triu(rng.normal(size=(12, 12))), np.diag([3.0, 0, 2, 0]), np.zeros((3, 3)), np.ones((5, 5)), rng.normal(size=(1, 1))):
        d, u, v = whitening.bidiagonal(r)
        b = np.diag(d) + np.diag(u, 1)
        assert np.allclose(v.T @ v, np.eye(len(r)), atol=1e-13)
        assert np.allclose(v @ b.T @ b @ v.T, r.T @ r, atol=1e-12)


def exact_product(q):
    out = Fraction(1)
    for x in q:
        out *= Fraction(x)
    return out


def test_qd_values():
    """Against a dense solver; graded matrices against their exact determinant, as a dense solver loses the small values."""
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 10, 64, 150):
        q, e = rng.random(n) + 1e-3, rng.random(n - 1)
        b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
        assert np.allclose(whitening.dqds(q.tolist(), e.tolist()), np.linalg.svd(b, compute_uv=False) ** 2, rtol=1e-9, atol=1e-13)
    for n in (2, 5, 20, 40):
        q, e = 10.0 ** rng.uniform(-8, 2, n), 10.0 ** rng.uniform(-8, 2, n - 1)
        got = whitening.dqds(q.tolist(), e.tolist())
        assert abs(exact_product(got) / exact_product(q.tolist()) - 1) < 1e-11
        assert abs(sum(got) / (q.sum() + e.sum()) - 1) < 1e-13
    assert whitening.dqds([0.0, 4.0, 0.0], [0.0, 0.0]) == [4.0, 0.0, 0.0]
    assert np.allclose(whitening.dqds([1.0] * 30, [0.0] * 29), 1)
    assert np.allclose(whitening.dqds([0.0, 1.0, 2.0], [1.0, 3.0]), np.linalg.svd(np.array([[0, 1, 0], [0, 1, 3**0.5], [0, 0, 2**0.5]]), compute_uv=False) ** 2, atol=1e-12)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5, 0.25, 0.1], [2] * 8, [3, 3, 3, 1, 1, 1, 1e-6, 1e-6], [1, 1 - 1e-9, 1 - 2e-9, 1 - 1e-5, 0.5, 0.5, 0.5 + 1e-12, 1e-9], [9, 9, 1, 1, 0, 0, 0, 0]])
def test_vectors_are_orthonormal_also_in_clusters(values):
    rng = np.random.default_rng(2)
    for _ in range(5):
        axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
        r = np.linalg.qr(rng.normal(size=(8, 8)))[0] @ np.diag(np.sqrt(values)) @ axes.T
        got, v, whole = whitening.principal(r, 8)
        kept = sorted((x for x in values if x > 0), reverse=True)
        assert len(got) >= len(kept) and np.allclose(got[: len(kept)], kept, atol=1e-13) and abs(whole - sum(values)) < 1e-12
        assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
        assert np.abs(r.T @ r @ v - v * got).max() < 1e-11 * max(values)


def brute_whitened(x, most=8):
    n = len(x)
    s = [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(r, s, strict=True)] for r in x])
    values, axes = np.linalg.eigh(y.T @ y / n)
    order = [i for i in np.argsort(-values)[:most] if values[i] > 1e-9 * values.max()]
    return [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], y @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compare_whitened(df, x, ids):
    deviation, w, explained = brute_whitened(x)
    got = {}
    for r in df.collect():
        assert r.n == len(x) and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(ids) and all(sorted(g) == list(range(1, w.shape[1] + 1)) for g in got.values())
    for c in range(w.shape[1]):
        mine = np.array([got[i][c + 1].whitened for i in ids])
        assert np.allclose(mine, w[:, c] * np.sign(mine @ w[:, c]), atol=1e-8)
        assert all(math.isclose(got[i][c + 1].explained, explained[c], rel_tol=1e-9) for i in ids)
    assert [int(got[i][1].deviation) for i in ids] == deviation


def test_whitened_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = [[math.floor(1024 * c) + 100_000 for c in r.embedding] for r in rows]
    for parts in (1, 11):
        compare_whitened(whitening.whitened(df.repartition(parts)), x, [r.vec_id for r in rows])


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * [100, 10, 1, 1e3, 3]).tolist()) for i in range(40)]
    odd = [(50, None), (51, [None] * 5), (52, [NAN] * 5), (53, [1.0, 2.0, 3.0, 4.0, -INF]), (54, [1.0]), (55, []), (56, [1e300] * 5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, deviation string").repartition(3)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    compare_whitened(whitening.whitened(df), x, [i for i, _ in rows])
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")
    for nothing in (df.limit(0), same, same.limit(1), df.filter("vec_id > 49")):
        got = whitening.whitened(nothing)
        assert got.count() == 0 and "identity_error" in got.columns
    # Two dimensions that move together leave one component; equal rows get equal values.
    line = spark.range(9).selectExpr("id AS vec_id", "array(CAST(id % 3 AS double), CAST(2 * (id % 3) AS double)) AS embedding")
    got = whitening.whitened(line.repartition(4)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and len({r.whitened for r in got}) == 3
    # Sums of squares beyond 64 bits stay exact.
    wide = spark.createDataFrame([(i, [float(i << 33), 1.0]) for i in range(7)], "vec_id long, embedding array<double>")
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(wide).filter("component = 1").collect()}
    assert got == {i: (7 * (i << 43) - (21 << 43)) ** 2 for i in range(7)}


def test_neighbours_of_queries_apart_from_the_rows(spark):
    """Queries far from all clusters, a common part of all rows, and one very long row: the codes of a sample say little of such queries."""
    rng = np.random.default_rng(1)
    x = 0.05 * rng.normal(size=(4000, 64)) + rng.normal(size=(50, 64))[rng.integers(0, 50, 4000)]
    x[::20] = 2 * rng.normal(size=(200, 64))
    for vectors in (x, x + 3 * (np.arange(4000) % 20 > 0)[:, None], np.where(np.arange(4000)[:, None] == 5, 1e4 * x, x)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
        near = vectors[::20] @ vectors.T
        near[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
        want = {20 * q: set(np.argsort(-s, kind="stable")[:20].tolist()) for q, s in enumerate(near)}
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, sample=1_000, block_rows=2_000).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[q] & want[q]) / 20 for q in want]) > 0.95
