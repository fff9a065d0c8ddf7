"""The Merkle manifest and the whitening against plain versions, and on odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import merkle, whitening
from locusframe.llm.common import key_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `tree` string, `meta.x` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes, fanout=8):
    """Root, and for each leaf its steps (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            ways[leaf].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], ways


def plain_audit(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees.setdefault(lang, []).append((doc_id, plain_leaf(doc_id, source, lang, n_chars, text), plain_leaf(doc_id, source, lang, n_chars, low if touched else text)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[lang] = plain_tree([r[1] for r in trees[lang]])
    root, tops = plain_tree([built[x][0] for x in langs])
    out = []
    for top, lang in zip(tops, langs):
        for way, (doc_id, leaf, seen) in zip(built[lang][1], trees[lang]):
            for left, right in way + top:
                seen = sha(left + seen + right)
            out.append((doc_id, leaf, built[lang][0], root, sha("".join(a + b for a, b in way + top)), seen, seen == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_manifest_against_a_plain_version(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["Ab", "été Zz\n", "", None]) if i % 5 else "X" * i, rng.choice(["en", "en", "fr", None]), rng.choice(["a", None]), i) for i in range(n)]
    if n > 8:
        rows += [(6, "Same", "en", "a", 1)] * 2 + [(None, "No id", "fr", None, None), (7, "alone", "", "b", 5)]
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], DOCS).repartition(5)
    assert sorted(map(tuple, merkle.audit(df).collect()), key=repr) == plain_audit(rows)


def test_more_rounds_of_small_superblocks_give_the_same_proofs(spark):
    rows = spark.range(500).selectExpr("cast(id % 2 as string) as tree", "id as place", "sha2(cast(id as string), 256) as digest")
    seen = [{(r.tree, r.place): (r.lefts, r.rights, r.root, r.subroot, r.idx) for r in merkle.manifest(rows, 3, levels).collect()} for levels in (1, 2, 5)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 500
    root = {r[2] for r in seen[0].values()}.pop()
    again = merkle.manifest(rows, 3, 2).select(merkle.folded(F.col("digest"), F.col("lefts"), F.col("rights")).alias("up")).distinct().collect()
    assert [r.up for r in again] == [root]


def test_manifest_of_no_rows(spark):
    assert merkle.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_keys_of_trees_put_null_first(spark):
    got = spark.createDataFrame([("b",), (None,), ("é",), ("",)], "x string").select("x", key_text(F.col("x")).alias("k")).orderBy("k").collect()
    assert [r.x for r in got] == [None, "", "b", "é"]


def plain_whitening(vectors, most):
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    z = x - x.mean(axis=0)
    v = z.T @ z / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return z @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(400, 40)) @ np.diag(np.linspace(3, 0.5, 40)) + 5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, `meta.x` int").repartition(6)
    got = whitening.whitened_rows(df).collect()
    want, explained = plain_whitening(vectors, 32)
    exact = [[int(math.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*exact)]
    assert len(got) == 400 * 32 and {r.n for r in got} == {400} and all(r.identity_error < 1e-10 for r in got)
    sign = {}
    for r in got:
        k = r.component - 1
        w = want[r.vec_id, k]
        if abs(w) > 0.1:
            assert sign.setdefault(k, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert math.isclose(abs(r.whitened), abs(w), rel_tol=1e-7, abs_tol=1e-7) and math.isclose(r.explained, explained[k], rel_tol=1e-9)
        assert r.deviation == sum((400 * a - s) ** 2 for a, s in zip(exact[r.vec_id], sums))


def test_whitening_leaves_out_what_is_no_vector(spark):
    good = [(i, [float(i % 3), float(i % 2), 1.0]) for i in range(6)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, float("nan"), 2.0]), (93, [1.0, float("inf"), 2.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 1.0, 1.0]), (None, [0.0, 1.0, 1.0])]
    got = whitening.whitened_rows(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {*range(6), None} and {r.component for r in got} == {1, 2} and {r.n for r in got} == {7}


def test_whitening_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whitened_rows(spark.createDataFrame(rows, schema)).collect() == []


def test_merged_sums_are_those_of_all(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(10**6), 10**6, (1000, 5))
    parts = [whitening.Summed.of(p) for p in np.split(x, [0, 1, 7, 400])]
    now = parts[0]
    for p in parts[1:]:
        now = now.merge(p)
    want = whitening.Summed.of(x)
    assert now.n == 1000 and (now.total == want.total).all() and np.allclose(now.scatter, want.scatter, rtol=1e-12)


def test_deviations_beyond_64_bits_are_null():
    model = whitening.Whitening(1 << 40, np.array([0]), np.eye(1), np.ones(1), 1.0)
    assert whitening.deviations(model, np.array([[0], [1 << 30]])) == [0, None]
    assert whitening.deviations(whitening.Whitening(3, np.array([4]), np.eye(1), np.ones(1), 1.0), np.array([[5]])) == [121]
