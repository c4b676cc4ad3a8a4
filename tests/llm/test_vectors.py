"""Whitening, vector codes and nearest neighbours against slow ways, on hard rows and hard numbers."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pennyflow.llm import cross_polytope, vector_codes, whitening

NAN = float("nan")
SCHEMA = "vec_id long, embedding array<double>, label int, x string, v string, id string, n string, h string"


def rows_of(count=400, length=12, seed=3):
    """Clusters, copies, ties, repeated rows, null ids, and vectors that take no part."""
    drawn = np.random.default_rng(seed)
    centres = drawn.normal(size=(6, length)) * np.linspace(2, 0.3, length)
    out = [(k, (centres[k % 6] + drawn.normal(size=length) * 0.2).round(3).tolist(), k % 3 if k % 7 else None) for k in range(count)]
    out += [(count + k, out[k % 5][1], 1) for k in range(90)]  # copies of five vectors
    out += [out[20], out[20], (None, out[9][1], 2), (None, [-0.0] * (length - 1) + [1.5], 2)]
    out += [(9000, None, 0), (9020, [NAN] * length, 0), (9040, [None] * length, 1), (9060, [float("-inf")] + [0.0] * (length - 1), 1), (9080, [], 1), (9100, [0.5] * (length + 2), 1)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def usable(rows, length=12):
    return [r for r in rows if r[1] is not None and len(r[1]) == length and all(c is not None and np.isfinite(c) for c in r[1])]


def ordered(values):
    return sorted(values, key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture(scope="module")
def rows():
    return rows_of()


def slow_white(rows, components=4):
    own = usable(rows)
    x = np.floor(256 * np.array([r[1] for r in own])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return own, x, n, sums, values, vectors, (x - sums / n) @ (vectors / np.sqrt(values)), values / (centred**2).sum() * n


def test_whitening(spark, rows):
    own, x, n, sums, _, _, white, explained = slow_white(rows)
    got = whitening.whitened(frame(spark, rows)).collect()
    assert len(got) == 4 * len(own) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-12 and max(r["residual"] for r in got) < 1e-8
    deviation = {r[0]: int(d) for r, d in zip(own, ((n * x - sums) ** 2).sum(axis=1), strict=True) if r[0] is not None}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got if r["vec_id"] is not None)
    for c in range(4):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1 and r["vec_id"] is not None}
        theirs = {r[0]: w for r, w in zip(own, white[:, c], strict=True) if r[0] is not None}
        sign = np.sign(mine[0] * theirs[0])
        assert max(abs(mine[k] - sign * theirs[k]) for k in theirs) < 1e-9
        assert {round(r["explained"] / explained[c], 9) for r in got if r["component"] == c + 1} == {1.0}
    counts = {}
    for r in own:
        counts[r[0]] = counts.get(r[0], 0) + 4
    have = {}
    for r in got:
        have[r["vec_id"]] = have.get(r["vec_id"], 0) + 1
    assert have == counts


def test_whitening_of_few_vectors(spark):
    one = [(1, [0.5, 0.25], 0, *["c"] * 5), (2, [0.5, 0.25], 0, *["c"] * 5)]
    assert whitening.whitened(spark.createDataFrame(one, SCHEMA)).count() == 0  # one distinct vector: no component
    two = spark.createDataFrame([*one, (3, [-0.5, 0.25], 0, *["c"] * 5)], SCHEMA)
    got = whitening.whitened(two).collect()
    assert [(r["vec_id"], r["component"]) for r in sorted(got)] == [(1, 1), (2, 1), (3, 1)] and max(abs(abs(r["whitened"]) - 1) for r in got) < 1e-12


def test_lobpcg_passes_and_doubling():
    drawn = np.random.default_rng(5)
    turn = np.linalg.qr(drawn.standard_normal((150, 150)))[0]
    for values in (np.linspace(10, 1, 150), np.repeat([5.0, 3.0, 1.0], 50), np.concatenate([[1e9, 4, 3, 2], np.full(146, 1e-6)])):
        matrix = turn @ np.diag(values) @ turn.T
        for guard, patience in ((12, 200), (0, 3)):  # the second has to double its block until it holds all dimensions
            passes = []
            got, vectors, residuals = whitening.lobpcg(lambda b, m=matrix, p=passes: p.append(b.shape[1]) or m @ b, 150, 4, guard, patience)
            assert np.allclose(got, np.sort(values)[::-1][:4], rtol=1e-12)
            assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
            assert np.linalg.norm(matrix @ vectors - vectors * got, axis=0).max() < 1e-12 * values.max() and residuals.max() < 1e-12 * values.max()


def test_deviations_that_do_not_fit():
    sums, n = [0, 10, 1 << 40], 1 << 20
    x = np.array([[0, 0, 1 << 20], [5, 0, 1 << 20], [1 << 12, 0, 0], [1 << 50, 0, 0], [-(1 << 63), (1 << 63) - 1, 0]])
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, n, sums).to_pylist() == [w if w < 1 << 63 else None for w in want]
    edge = np.array([[3037000499, 0, 0], [3037000500, 0, 0]])  # the roots about a long's bound
    assert whitening.deviations(edge, 1, [0, 0, 0]).to_pylist() == [3037000499**2, None]


def slow_codes(rows, length=12, parts=8, entries=16, rounds=6):
    own = usable(rows, length)
    wide = -(-length // parts)
    x = [[int(np.floor(4096 * c)) for c in r[1]] + [0] * (wide * parts - length) for r in own]
    cut = [[tuple(v[p * wide : (p + 1) * wide]) for p in range(parts)] for v in x]
    first = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0], x[k]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign(part, p):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        fresh = [list(b) for b in books]
        for p in range(parts):
            at = [assign(c[p], p)[0] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a == e]
                if mine:
                    fresh[p][e] = tuple(sum(v) // len(mine) for v in zip(*mine, strict=True))
        books = fresh
    found = [[assign(c[p], p) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for r, e in zip(own, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    text = ",".join(str(v) for b in books for e in b for v in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return ordered([(r[0], "".join(f"{a:02x}" for a, _ in f), e, by_label[r[2]], digest) for r, f, e in zip(own, found, errors, strict=True)])


def codes(df, **more):
    return ordered([tuple(r) for r in vector_codes.compressed(df, **more).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()])


def test_codes(spark, rows):
    assert codes(frame(spark, rows)) == slow_codes(rows)


def test_codes_of_few_vectors_and_many_labels(spark, rows, monkeypatch):
    few = [r for r in rows if r[0] is not None and r[0] in (3, 4, 20)]
    assert codes(frame(spark, few)) == slow_codes(few)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert codes(frame(spark, rows[:60])) == slow_codes(rows[:60])


def test_codes_of_huge_numbers(spark):
    rows = [(1, [1e30] + [0.0] * 7, 0), (2, [-1e30] + [0.0] * 7, 0), (3, [1e12] * 8, 1), (4, [3e12] * 8, None), (5, [0.5] * 8, 1)]
    got = vector_codes.compressed(frame(spark, rows), entries=2).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and all(len(r["code"]) == 16 for r in got)
    assert all(r["error"] is None or 0 <= r["error"] < 1 << 63 for r in got)


@pytest.mark.parametrize("length", [1, 2, 3, 8, 13])
def test_bounds_filter_but_never_the_nearest(length):
    drawn = np.random.default_rng(length)
    for scale in (3, 4000, 1 << 26, 1 << 40):
        entries = drawn.integers(-scale, scale, (16, length))
        entries[5] = entries[2]  # a tie goes to the lower index
        x = np.concatenate([drawn.integers(-scale, scale, (300, length)), entries, np.zeros((2, length), np.int64), entries[:8] + 1])
        at, far, _ = vector_codes.nearest(x, entries)
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in entries] for r in x]
        assert at.tolist() == [w.index(min(w)) for w in want] and far.tolist() == [min(w) for w in want]


def test_bounds_spare_most_distances():
    """Where neighbouring numbers are alike and rows lie about the entries, as codebooks make them do; noise is spared less."""
    drawn = np.random.default_rng(4)
    entries = drawn.normal(size=(16, 16)).cumsum(axis=1) * 1000
    x = entries[drawn.integers(0, 16, 2000)] + drawn.normal(size=(2000, 16)) * 300
    at, far, exact = vector_codes.nearest(x.astype(np.int64), entries.astype(np.int64))
    want = ((x.astype(np.int64)[:, None] - entries.astype(np.int64)[None]) ** 2).sum(axis=2)
    assert (at == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all() and exact < 0.2 * want.size


def slow_nearest(rows, nearest=20, every=20):
    own = [r for r in {(r[0], tuple(0.0 if c == 0 else c for c in r[1])) for r in usable(rows)} if any(r[1])]
    x = np.array([r[1] for r in own])
    out = {}
    for q, v in own:
        if q is not None and q % every == 0:
            score = x @ np.array(v)
            best = sorted((-round(s, 9), r[0] is None, r[0] or 0) for s, r in zip(score, own, strict=True) if r[0] != q)[:nearest]
            out[q] = [(-s, None if none else i) for s, none, i in best]
    return out


def test_nearest_where_all_buckets_are_probed(spark, rows, monkeypatch):
    monkeypatch.setattr(cross_polytope, "RECALL", 1.0)
    monkeypatch.setattr(cross_polytope, "SAMPLE_QUERIES", 10**6)
    monkeypatch.setattr(cross_polytope, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cross_polytope, "BLOCK_QUERIES", 4)
    got = {}
    for r in cross_polytope.nearest_by_product(frame(spark, rows), "id % 20 = 0").orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((round(r["score"], 9), r["vec_id"]))
    assert got == slow_nearest(rows)


@pytest.mark.parametrize("bucket_rows", [256, 2])
def test_recall(spark, bucket_rows, monkeypatch):
    """With one function a hash, and with two, where many more rows than a bucket holds ask for finer ones."""
    monkeypatch.setattr(cross_polytope, "BUCKET_ROWS", bucket_rows)
    drawn = np.random.default_rng(1)
    centres = drawn.normal(size=(40, 24))
    x = centres[drawn.integers(0, 40, 4000)] + 0.4 * drawn.normal(size=(4000, 24))
    x *= drawn.uniform(0.5, 2, (4000, 1))  # the largest product isn't the smallest angle
    table = frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(x)])
    got = cross_polytope.nearest_by_product(table, "id % 20 = 0").groupBy("query_id").agg(F.collect_set("vec_id").alias("found"))
    hits = 0
    for r in got.collect():
        score = x @ x[r["query_id"]]
        score[r["query_id"]] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(r["found"]))
    assert hits >= 0.9 * 20 * 200


def test_probes_come_in_the_order_of_their_penalty():
    drawn = np.random.default_rng(2)
    index = cross_polytope.Index(3, 1.0, 2, tables=2)
    q = drawn.normal(size=(5, 3))
    tables, codes_ = index.ranked(q, 60)
    axes = 2 * index.width
    for k in range(5):
        unit, costs = q[k] / np.linalg.norm(q[k]), {}
        for t in range(2):
            near = [np.ravel(np.column_stack([y, -y])) for y in (index.turned(unit[None], t, f)[0] for f in range(2))]
            for a in range(axes):
                for b in range(axes):
                    costs[t, a * axes + b] = sum((n.max() - n[c]) ** 2 for n, c in zip(near, (a, b), strict=True))
        mine = [costs[t, c] for t, c in zip(tables[k].tolist(), codes_[k].tolist(), strict=True)]
        assert np.allclose(mine, sorted(costs.values())[:60]) and len(set(zip(tables[k].tolist(), codes_[k].tolist(), strict=True))) == 60


def test_hadamard():
    assert np.allclose(cross_polytope.hadamard(np.eye(4)) * 2, [[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])


@pytest.mark.parametrize("run", [whitening.whitened, vector_codes.compressed, lambda df: cross_polytope.nearest_by_product(df, "id % 20 = 0")])
def test_tables_without_a_usable_vector(spark, run):
    none = frame(spark, [(0, None, 0), (20, [NAN], 0), (40, [], None)])
    assert run(none).count() == 0 and run(none.limit(0)).count() == 0
