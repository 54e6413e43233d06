"""Whitening and near-duplicate embeddings against numpy; spelling variants against plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from tracewell.llm import variants, vectorgraph, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, n bigint, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7, "x") for i, v in rows], VECTORS)


def odd_rows():
    return [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0, 2.0])]


def test_jacobi_on_cholesky_factor():
    random_ = np.random.default_rng(1)
    for rank, size in ((7, 7), (3, 9), (1, 5)):
        x = random_.normal(size=(40, rank)) @ random_.normal(size=(rank, size)) * np.logspace(0, -3, size)
        a = x.T @ x
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a, rtol=1e-9, atol=1e-12 * a.max())
        vectors, values = whitening.one_sided_jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-8)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12) and np.allclose(a @ vectors, vectors * values, atol=1e-10 * a.max())


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    c = (rng.normal(size=(150, 12)) * np.linspace(1, 0.2, 12)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(c)] + [(7, c[7]), (None, c[3])] + odd_rows()
    got = whitening.whitened(frame(spark, rows)).toPandas()
    kept = np.concatenate([c, c[7:8], c[3:4]]).astype(float)
    x = np.floor(1024 * kept).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - total / n) @ vectors[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k in range(8):
        part = got[(got.component == k + 1) & got.vec_id.notna()].groupby("vec_id").whitened.first()
        want = white[part.index.astype(int), k]
        assert np.allclose(np.abs(part), np.abs(want), atol=1e-9) and abs(abs((part * want).sum()) - (want * want).sum()) < 1e-6
    shares = got.groupby("component").explained.first()
    assert np.allclose(shares, values[:8] / values.sum(), rtol=1e-9)
    exact = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], total)) for i in range(150)}
    assert all(exact[int(i)] == d for i, d in zip(got.vec_id, got.deviation) if i == i)


def test_whitening_without_variance(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).toPandas()
    assert set(line.component) == {1} and np.isclose(line.explained[0], 1.0) and np.isclose((line.whitened ** 2).mean(), 1.0)


def test_deviations_beyond_a_long():
    x = np.array([[0, 1 << 40], [5, 6]])
    assert whitening.deviations(x, 2, [5, (1 << 40) + 6]) == [None, None]
    assert whitening.deviations(x[1:], 1, [5, 5]) == [1]


def crowd(rng, base, n, noise):
    return base + rng.normal(size=(n, len(base))) * noise


@pytest.mark.parametrize("limit, tight", [(4096, 0.05), (96, 0.05), (96, 0.02)])
def test_near_vectors_against_brute_force(spark, monkeypatch, limit, tight):
    """A crowd of a third of all rows, smaller groups, copies, odd rows; small limits make hot cores and parts."""
    monkeypatch.setattr(vectorgraph, "LIMIT", limit)
    monkeypatch.setattr(vectorgraph, "SHARD", limit // 2)
    rng = np.random.default_rng(3)
    bases = rng.normal(size=(30, 12))
    x = np.concatenate([rng.normal(size=(350, 12)), crowd(rng, bases[0], 250, tight), *(crowd(rng, b, 5, 0.1) for b in bases[1:])])
    x = np.concatenate([x, x[:40], x[340:380] * 2]).astype(np.float32)
    rows = list(enumerate(x)) + [(i, v) for i, v in odd_rows()] + [(906, [0.0] * 12), (None, x[0])]
    got = vectorgraph.linked_vectors(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and set(got.columns) == {"vec_id", "n_links", "component_id", "kept", "audit_recall"}
    u = np.concatenate([x, x[:1]]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = vectorgraph.local_roots(len(u), *np.nonzero(near))
    named = got[got.vec_id.notna()].set_index(got.vec_id.dropna().astype(int))
    want = near.sum(axis=1)
    assert named.n_links.loc[range(len(x))].tolist() == want[: len(x)].tolist()
    assert named.component_id.loc[range(len(x))].astype(int).tolist() == root[: len(x)].tolist()
    assert named.kept.loc[range(len(x))].tolist() == [bool(r == i) for i, r in enumerate(root[: len(x)])]
    odd = named.loc[[i for i, _ in odd_rows()] + [906]]
    assert (odd.n_links == 0).all() and odd.kept.all() and (odd.component_id == odd.index).all()
    assert got.audit_recall[0] == 1.0


def test_near_vectors_of_an_empty_table(spark):
    assert vectorgraph.linked_vectors(frame(spark, [])).count() == 0
    alone = vectorgraph.linked_vectors(frame(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


def plain_variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)):] == b[i + 1:]

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if words[v] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_variants_against_plain_python(spark):
    rng = random.Random(4)
    chain = ["chainaaa"] * 300 + ["chainaab"] * 50 + ["chainabb"] * 7
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9))) for _ in range(25)]
    rows = [(None, None), (1, ""), (2, "123 -- ."), (None, "Größer größer GRÖßER größer größer"), (3, "x" * 3000 + " "), (4, ("y" * 900 + " ") * 5 + ("y" * 901 + " ") * 6)]
    for i in range(10, 160):
        words = []
        for _ in range(120):
            w = stems[min(int(rng.paretovariate(0.7)) - 1, 24)]
            at = rng.randrange(len(w))
            words.append(rng.choice([w] * 6 + [w[:at] + w[at + 1:], w[:at] + "z" + w[at:], w[:at] + "Á" + w[at + 1:], w.upper()]))
        rows.append((i, rng.choice([" ", "\n", "1"]).join(words)))
    rows += [*rows[20:30], (500, " ".join(chain))]
    frame_ = spark.createDataFrame([(i, t, "q", 1, "z") for i, t in rows], "doc_id bigint, text string, word string, n int, reduced string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(frame_).collect()}
    want = plain_variants(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert any(v[1] != v[0] for v in want.values() if v[0]), "chains of forms"
    assert variants.variants(frame_.limit(0)).count() == 0


def test_neighbourhoods_hold_every_reduced_edit():
    word = np.array([[ord(c) for c in "abcdefgh"]], dtype=np.uint32)
    hashes = set(variants.neighbourhoods(word)[0].tolist())
    for other in ("abcdefgh", "bcdefgh", "abcdefg", "abcdefghé", "xabcdefgh", "abcxdefgh", "abczefgh"):
        assert variants.reduced_forms(np.array([[ord(c) for c in other]], dtype=np.uint32))[0] in hashes
