"""Personal data against naive patterns, enumerated segmentations, held-out values and odd tables."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from locusframe.llm import personal_data as pd

SCHEMA = "doc_id long, text string, spans string, `meta.x` int"


def naive_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@pytest.fixture(scope="module")
def model():
    words = ["harbour", "winter", "letter", "garden", "Montag", "rivière", "and", "of", "the"]
    rng = random.Random(1)
    windows = [("", " ".join(rng.choices(words, k=6)) + " ", str(rng.randrange(9999)), " " + " ".join(rng.choices(words, k=5))) for _ in range(60)]
    return pd.train(pd.lessons(windows, made=120), epochs=60)


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    pieces = ["a@b.c", "@", ".", "_", "1", "23", "999", "1.2.3.4", " ", "-", "+", "+1 (659) 555-3949", "4111 1111 1111 1111", "4111-1111-1111-1111", "x", "é", "\n", "(", "0012", "😀", "%"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert sorted(pd.base_spans(text)) == sorted(naive_spans(text)), text


def test_long_runs_take_linear_time(model):
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 200_000, "+1" * 200_000, "1 2-" * 100_000, "a.b at " * 50_000, "0" * 5000 + ".0.0.0"):
        began = time.time()
        pd.found_spans(model, [text])
        assert time.time() - began < 40


def all_paths(n, scores):
    """(labels with their places, value without transitions) of every segmentation of n tokens."""
    def go(t):
        if t == n:
            yield ()
            return
        for rest in go(t + 1):
            yield ((t, 1, pd.OUTSIDE), *rest)
        for d in range(1, min(scores.shape[1], n - t) + 1):
            for k in range(pd.OUTSIDE):
                if np.isfinite(scores[t, d - 1, k]):
                    for rest in go(t + d):
                        yield ((t, d, k), *rest)
    return list(go(0))


def test_dynamic_programs_against_enumeration():
    rng = np.random.default_rng(3)
    k = pd.OUTSIDE
    for n in (1, 3, 5):
        scores = rng.normal(size=(2, n, 3, k)) * 2
        scores[rng.random(scores.shape) < 0.5] = -np.inf
        for t in range(n):
            scores[:, t, n - t :] = -np.inf
        trans = rng.normal(size=(k + 1, k + 1))
        trans[k, k] = 0.0
        log_z, segments, moves = pd.forward_backward(scores, trans)
        want_moves = np.zeros_like(moves)
        for b in range(2):
            paths = all_paths(n, scores[b])
            value = []
            for p in paths:
                labels = [k, *(y for _, _, y in p), k]
                value.append(sum(scores[b, t, d - 1, y] for t, d, y in p if y < k) + sum(trans[x, y] for x, y in itertools.pairwise(labels)))
            value = np.array(value)
            total = np.log(np.exp(value).sum())
            assert np.isclose(total, log_z[b])
            share = np.exp(value - total)
            want = np.zeros_like(segments[b])
            for p, q in zip(paths, share):
                for t, d, y in p:
                    if y < k:
                        want[t, d - 1, y] += q
                labels = [k, *(y for _, _, y in p), k]
                for x, y in itertools.pairwise(labels):
                    want_moves[x, y] += q
            assert np.allclose(segments[b], want)
            place = np.array([(t, d + 1) for t in range(n) for d in range(3) if np.isfinite(scores[b, t, d]).any()])
            if len(place):
                got = pd.best_path(place[:, 0], place[:, 1], np.array([scores[b, t, d - 1] for t, d in place]), trans)
                found = [(int(place[c, 0]), int(place[c, 1]), y) for c, y in got]
                best = [s for s in paths[int(value.argmax())] if s[2] < k]
                assert found == best
        assert np.allclose(moves, want_moves)


def test_training_follows_the_likelihood():
    """The gradient is that of the log likelihood: a trained model is at a minimum of its penalised sum in every direction tried."""
    samples = [("tel (659) 555-3949 now", [("phone", 4, 18)]), ("in 2021-03-04 it", []), ("a at b.com x", [("email", 0, 10)]), ("1 2 3 4 5 6 7", [])]
    model = pd.train(samples, epochs=400, rate=0.05, decay=1e-2)

    def loss(m):
        total = 0.0
        for text, spans in samples:
            tok = pd.tokens([text])
            c = pd.candidates(tok)
            dense = np.full((1, len(tok), pd.LENGTH, len(pd.KINDS)), -np.inf)
            scores = m.scores(c)
            dense[0, c.first, c.size - 1] = scores
            log_z = pd.forward_backward(dense, m.transitions)[0][0]
            labels, value, at = [pd.OUTSIDE], 0.0, 0
            while at < len(tok):
                hit = [(i, y) for kind, a, b in spans for y in [pd.KINDS.index(kind)] for i in range(len(c.first)) if c.first[i] == at and tok.start[at] == a and tok.end[at + c.size[i] - 1] == b]
                if hit:
                    value += scores[hit[0]]
                    labels.append(hit[0][1])
                    at += int(c.size[hit[0][0]])
                else:
                    labels.append(pd.OUTSIDE)
                    at += 1
            total += log_z - value - sum(m.transitions[x, y] for x, y in itertools.pairwise([*labels, pd.OUTSIDE]))
        return total / len(samples) + 0.5 * 1e-2 * ((m.weights**2).sum() + (m.transitions**2).sum())

    rng, here = np.random.default_rng(0), loss(model)
    used = np.abs(model.weights) > 1e-3
    for _ in range(10):
        step = rng.normal(size=model.weights.shape) * used * 0.05
        turn = rng.normal(size=model.transitions.shape) * 0.05
        turn[-1, -1] = 0.0
        assert loss(pd.SemiCrf(model.weights + step, model.transitions + turn)) > here - 1e-4


def test_values_written_in_other_ways(model):
    rng = np.random.default_rng(77)
    words = ["forest", "paper", "silver", "Haus", "monde"]
    right = {k: 0 for k in pd.KINDS}
    for kind in pd.KINDS:
        for _ in range(50):
            value = pd.made_up(rng, kind, words)[1]
            text = f"the winter letter {value} and of garden"
            (found,) = pd.found_spans(model, [text])
            right[kind] += [(k, text[a:b]) for k, a, b, _ in found] == [(kind, value)]
    assert min(right.values()) >= 45, right


def test_plain_numbers_are_left_alone(model):
    texts = ["on 2023-11-05 at 12:30:45 it was 3.50 or 1,234.00", "see 1.2.3 and pp. 123-456, in 1990-2005", "id 0af3c2d1e4b5 and 1234567 of 99", "he was at home. A dot com crash", "version v2.10.3 has 123456 rows", "one 4 5 6 7 8 9 10 11"]
    assert all(not s for s in pd.found_spans(model, texts))


def test_base_spans_stay_and_others_lie_outside(model):
    text = "mail a.b@c.org or kim dot lee at web dot org, 4465758382889437 4465758382889437"
    (found,) = pd.found_spans(model, [text])
    assert ("email", 5, 14, True) in found
    added = [(k, text[a:b]) for k, a, b, base in found if not base]
    assert ("email", "kim dot lee at web dot org") in added and added.count(("card", "4465758382889437")) == 2


def test_blocks_of_tokens_change_nothing(model):
    rng = np.random.default_rng(4)
    texts = [" ".join(pd.made_up(rng, k, ["oak"])[1] + " and then" for k in pd.KINDS * 8) for _ in range(4)]
    want = pd.found_spans(model, texts)
    keep = pd.BLOCK
    try:
        pd.BLOCK = 37
        assert pd.found_spans(model, texts) == want
    finally:
        pd.BLOCK = keep


def test_report_on_odd_documents(spark):
    rows = [(1, "write to kim@web.org or 10.0.0.1"), (1, "write to kim@web.org or 10.0.0.1"), (2, None), (3, ""), (None, "call +1 (659) 555-3949"), (4, "x" * 200_000 + " 4111 1111 1111 1111"), (5, "4111 1111 1111 1112, 1.2.3.999")]
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA)
    model = pd.fit(docs)
    got = sorted(map(tuple, pd.report(docs, model).collect()), key=repr)
    want = []
    for i, t in rows:
        base = naive_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(s[0] == k for s in base) for k in pd.KINDS), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want, key=repr)
    masked = {r.doc_id: r for r in pd.find(docs, model, masked="clean").collect()}
    assert masked[1].clean == "write to <EMAIL> or <IP>" and masked[2].clean is None and masked[1]["meta.x"] == 7
    assert pd.report(docs.limit(0), pd.fit(docs.limit(0))).collect() == []


def test_masks_of_overlapping_spans():
    assert pd.mask("ab 12 34 x", [("card", 3, 8, True), ("phone", 6, 8, True)]) == "ab <CARD> x"
