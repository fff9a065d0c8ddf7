"""Results of single operators against plain versions of them."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from locusframe.llm import common, decontamination, divergence, html_blocks, language_crf, line_dedup, log_bilinear, near_dedup, toxicity, warc

WORDS = [a + b for a in ("ra", "ti", "mo", "ke", "lu", "so", "ne", "da") for b in ("n", "ster", "ling", "dor", "vex", "pa")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def dense_nnpu(positive, unlabelled, prior, epochs, steps, seed):
    """The non-negative risk of a dense logistic model, minimised by Adam."""
    rng = np.random.default_rng(seed)
    dims = positive.shape[1]
    w, b = np.zeros(dims), math.log(prior / (1 - prior))
    m, v, mb, vb, t = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 0
    for _ in range(epochs):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), steps), np.array_split(rng.permutation(len(unlabelled)), steps)):
            xp, xu = positive[p], unlabelled[u]
            fp, fu = xp @ w + b, xu @ w + b
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
            gp, gu = -prior * sp / len(p), su / len(u)  # of the negative part
            if negative >= 0:
                gp = gp + prior * (sp - 1) / len(p)
            else:
                gp, gu = -gp, -gu
            g, gb = xp.T @ gp + xu.T @ gu + 1e-6 * w, gp.sum() + gu.sum()
            t += 1
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= 0.1 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def test_toxicity_training_against_a_dense_version():
    rng = np.random.default_rng(4)
    positive = [(np.sort(rng.choice(12, 4, replace=False)).astype(np.int32), np.full(4, 0.5, np.float32)) for _ in range(40)]
    unlabelled = [(np.sort(rng.choice(60, 5, replace=False)).astype(np.int32), np.full(5, 0.4, np.float32)) for _ in range(120)]
    w, b = toxicity.train(positive, unlabelled, 0.2, epochs=8, seed=3)
    dense = lambda rows: np.array([np.bincount(f, x, 1 << 8)[: 1 << 8] for f, x in rows])
    used = np.flatnonzero(w)
    p, u = dense(positive), dense(unlabelled)
    p[:, np.setdiff1d(np.arange(256), used)], u[:, np.setdiff1d(np.arange(256), used)] = 0, 0
    want, want_b = dense_nnpu(p, u, 0.2, 8, 4, 3)
    assert len(used) and np.allclose(w[used], want[used], rtol=1e-3, atol=1e-3) and math.isclose(b, want_b, rel_tol=1e-3)


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(1)
    docs = [(i, prose(i, 60) + (" vilescum filthrot " * rng.randrange(1, 4) if i % 4 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(df, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held)
    assert all(got[i].predicted == int(i % 4 == 0) for i in held) and all(0 <= r.score <= 1 for r in got.values())


def test_language_of_mixed_text(spark):
    """Half of a text in one language, half in another: words are labelled by where they stand."""
    rng = random.Random(3)
    own = {k: ["".join(rng.choice(c) for _ in range(6)) for _ in range(40)] for k, c in (("aa", "abcdefgh"), ("zz", "stuvwxyz"))}
    rows = [(i, " ".join(rng.choice(own[k]) for _ in range(60)), k) for i in range(80) for k in (("aa", "zz")[i % 2],)]
    model = language_crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = [rng.choice(own["aa"]) for _ in range(15)] + [rng.choice(own["zz"]) for _ in range(15)]
    gamma, _ = language_crf.label_words(model, pa.array([" ".join(words)]))
    assert [model.languages[k] for k in gamma.argmax(axis=1)] == ["aa"] * 15 + ["zz"] * 15


def test_base_scores_against_counts(spark):
    docs = [(i, prose(i, 30 + i) + (" Ünï %d\x0bRARE%d" % (i, i % 3) if i % 2 else "")) for i in range(60)] + [(100, None), (101, ""), (None, "ra n\tRa")]
    split = lambda t: [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\t", " ").split(" ") if w]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in docs:
        if not held(i):
            counts.update(split(t))
            counts[None] += 1
    total, types = sum(counts.values()), len(counts)
    keep = log_bilinear.DICTIONARY
    try:
        for log_bilinear.DICTIONARY in (keep, 20):  # all words in the table, or most of them joined
            got = {r.doc_id: r for r in log_bilinear.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
            for i, t in docs:
                tokens = [*split(t), None]
                base = sum(math.log10((counts[w] + 1) / (total * 1.0 + types + 1)) for w in tokens)
                assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total)
                assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].score < 0
    finally:
        log_bilinear.DICTIONARY = keep


def test_word_lookup_and_endings(spark):
    from pyspark.sql import functions as F

    words = sorted({prose(i, 1) + str(i) for i in range(3000)} | {"é", "ab", "x" * 40})
    listed = log_bilinear.Dictionary([w.encode() for w in words[::2]], 5)
    data, offsets = common.text_bytes(pa.array(words))
    hashes = common.word_hashes(data, offsets)[0]
    assert listed.numbers(hashes).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(words))]
    ending = F.conv(F.hex(F.substring(F.col("w").cast("binary"), -3, 3)), 16, 10).cast("bigint")
    native = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1).select("w", log_bilinear.rare_class(ending).alias("k")).collect()
    assert [r.k for r in native] == log_bilinear.ending_classes(data, offsets[:-1], offsets[1:]).tolist()


def test_model_knows_more_than_counts(spark):
    """Two vocabularies that never meet in a text: the context tells which one comes next."""
    rng = random.Random(8)
    sides = [[f"{c}{i}" for i in range(150)] for c in ("q", "z")]
    docs = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(400))) for i in range(150)]
    got = log_bilinear.score_texts(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.1


@pytest.mark.parametrize("words", [1, 3, 4, 5, 6, 8, 9, 12])
def test_every_short_item_is_found(words):
    rng = random.Random(words)
    items = [" ".join("%s%d" % (rng.choice(WORDS), rng.randrange(99)) for _ in range(words)) for _ in range(40)]
    found = decontamination.Items(list(range(40)), items).search(pa.array([prose(k, k) + " " + x + " " + prose(99, 300) for k, x in enumerate(items)]))
    assert {(r, i) for r, i, _ in found} >= {(k, k) for k in range(40)}


@pytest.mark.parametrize(("words", "times"), [(5, 60), (6, 40), (8, 30), (7, 15), (30, 3), (25, 1), (60, 2)])
def test_items_that_repeat_themselves_are_found(words, times):
    rng = random.Random(words)
    items = [" ".join(["%s%d" % (rng.choice(WORDS), rng.randrange(99)) for _ in range(words)] * times) for _ in range(60)]
    found = decontamination.Items(list(range(60)), items).search(pa.array([prose(k, 400) + " " + x + " " + prose(99 + k, 400) for k, x in enumerate(items)]))
    assert {(r, i) for r, i, _ in found} >= {(k, k) for k in range(60)}


def test_recall_of_items_with_changed_words_by_size():
    """Of items of which the document has 0.8 or more of the shingles, 0.97 or more are found, in each class of size."""
    rng = random.Random(12)
    for words in (12, 20, 40, 90, 200):
        items = [prose(1000 * words + k, words).split() for k in range(60)]
        changed = []
        for k, item in enumerate(items):
            own = list(item)
            if k % 3:
                own[rng.randrange(words) if words >= 60 else rng.choice((0, words - 1))] = "altered"
            changed.append(prose(k, 300) + " " + " ".join(own) + " " + prose(k + 1, 300))
        found = {(r, i) for r, i, _ in decontamination.Items(list(range(60)), [" ".join(x) for x in items]).search(pa.array(changed))}
        share = [len(a & b) / len(a) for x, y in zip(items, changed) for a, b in [(decontamination.word_tuples(" ".join(x)), decontamination.word_tuples(y))]]
        want = [k for k in range(60) if share[k] >= 0.8]
        assert len(want) >= 40 and sum((k, k) in found for k in want) >= 0.97 * len(want)


def test_items_in_blocks_and_odd_items(spark):
    items = spark.createDataFrame([(1, prose(1, 20)), (2, prose(2, 9)), (3, None), (4, ""), (5, "only four words here"), (1, prose(1, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(1, 20)), (2, "x " + prose(2, 9)), (3, "say only four words here now"), (4, None), (5, prose(7, 50)), (5, prose(7, 50))], "doc_id long, text string")
    for block in (100, 2):
        found = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items, block).collect())
        assert found == [(1, 1), (1, 1), (2, 2), (3, 5)]
        assert sorted(r.doc_id for r in decontamination.without_leaks(docs, items, block).collect()) == [4, 5, 5]


LONG = "long text words here and so on " * 8
PAGES = {
    '<div class="content no-sidebar"><article><p>%s</p></article></div>' % LONG: LONG,
    '<div class="page-with-header"><p>%s</p><p>Yes.</p></div>' % LONG: LONG + "\n\nYes.",
    '<article><div class="lead-body no-ads"><p>Hi there</p></div><figure><img><figcaption>A caption</figcaption></figure><p><a href=x>mostly link text</a> ok</p></article>': "Hi there\n\nA caption\n\nmostly link text ok",
    "<p>Yes.</p><p>Short one.</p><p>%s</p>" % LONG: "Yes.\n\nShort one.\n\n" + LONG,
    "<form id=all><div class=main><p>%s</p></div></form>" % LONG: LONG,
    '<ul><li><a>a</a><li><a>b</a></ul><h1>Title</h1><p>%s</p><div class="comments"><article class="comment"><p>%s</p></article></div><footer>x</footer>' % (LONG, LONG): "Title\n\n" + LONG,
    '<div class="sidebar"><p>%s</p></div><div class=post><p>%s</p><p>End.</p></div>' % ("aside " * 20, LONG): LONG + "\n\nEnd.",
    "<article><header><h1>Head</h1></header><p>One.</p><nav><a>up</a></nav><aside>More</aside></article><header>Top</header>": "Head\n\nOne.",
}


def test_pages_without_hints_and_with_misleading_names():
    for page, want in PAGES.items():
        assert html_blocks.main_text(page).split() == want.split() and html_blocks.main_text(page).count("\n\n") == want.count("\n\n"), page


def test_neighbours_decide_where_nothing_else_is_known():
    tree = html_blocks.grow_tree(html_blocks.LABELLED)
    own = lambda before, after: html_blocks.keeps(tree, (4, 1.0, *before, *after, 0, False))
    assert own((60, 0.0), (50, 0.0)) and not own((3, 1.0), (2, 1.0))


def test_odd_pages(spark):
    rows = [(1, "u", "<p>%s</p>" % LONG, 5), (1, "u", "<p>%s</p>" % LONG, 5), (2, None, None, 6), (None, "v", "<a<b>&amp;&#xD83D;" * 2000, 7)]
    got = html_blocks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 1] == [LONG.strip()] * 2 and all(r.n_chars == len(r.text) for r in got)
    assert html_blocks.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_verdicts_against_plain_distances(spark):
    """Rare languages are held against the words of all languages, counted in full."""
    rng = random.Random(6)
    tongues = {f"l{k}": [f"w{k % 7}x{j}" for j in range(30)] + [f"all{j}" for j in range(4)] for k in range(120)}
    docs = [(i, " ".join(rng.choices(tongues[f"l{i % 120}"], k=100)), f"l{i % 120}") for i in range(240)] + [(900, " ".join(rng.choices(tongues["l3"], k=100)), None)]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    counts = Counter(w for _, t, _ in docs for w in t.split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[: divergence.COMMON_WORDS]
    total = sum(counts.values())
    q = [counts[w] / total for w in top]
    q.append(1 - sum(q))
    for i, t, _ in docs:
        own = Counter(t.split())
        p = [own[w] / 100 for w in top]
        p.append(1 - sum(p))
        js = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2
        assert math.isclose(got[i].word_distance, math.sqrt(max(js, 0)), abs_tol=1e-9)


def test_fuzzy_lines_against_all_pairs_and_recall():
    """Of lines with one run of edits, at a similarity of 0.8 or more, nearly all share a band."""
    rng = random.Random(12)
    pairs = []
    for k in range(1500):
        a = prose(5000 + k, rng.randrange(4, 30))
        at, n = rng.randrange(len(a)), rng.randrange(1, 1 + len(a) // 12)
        pairs.append((a, a[:at] + "#" * n + a[at + n :]))
    left, right = pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])
    close = line_dedup.jaccard(left, right) >= 0.8
    bands = []
    for column in (left, right):
        points, edges = line_dedup.code_points(*common.text_bytes(column))
        bands.append(near_dedup.band_keys(line_dedup.signatures(points, edges[:-1], edges[1:]), line_dedup.BANDS, line_dedup.PER_BAND))
    shared = (bands[0] == bands[1]).any(axis=1)
    assert close.sum() > 500 and shared[close].mean() >= 0.99


def test_recall_of_near_copies_by_similarity():
    """DartMinHash bands: nearly all pairs at 0.8 or more, few far below."""
    texts = [prose(8000 + k, 200) + f" {k}" for k in range(400)]
    for share, least, most in ((0.02, 0.98, 1.0), (0.2, 0.0, 0.35)):
        rng = random.Random(int(share * 100))
        edited = [" ".join("edit%d" % rng.randrange(9999) if rng.random() < share else w for w in t.split()) for t in texts]
        score = near_dedup.weighted_jaccard(pa.array(texts), pa.array(edited))
        bands = []
        for column in (texts, edited):
            words, _, _, rows = common.word_hashes(*common.text_bytes(pa.array(column)))
            bands.append(near_dedup.band_keys(near_dedup.dart_minhash(*near_dedup.elements(words, rows), len(column)), near_dedup.BANDS, near_dedup.PER_BAND))
        shared = (bands[0] == bands[1]).any(axis=1)
        some = score >= 0.8 if least else score < 0.5
        assert some.sum() > 100 and least <= shared[some].mean() <= most


def test_warc_odd_pages(spark):
    rows = [(1, "u", "a" * 9000, 3), (1, "u", "a" * 9000, 3), (2, "u", "a" * 9000, 3), (None, "u", "a" * 9000, 3), (5, "u", "", 3), (6, None, None, 3)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(2)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter([(1, 9000, "revisit", 2)] * 2 + [(2, 9000, "response", None), (None, 9000, "revisit", 2), (5, 0, "revisit", 6), (6, 0, "response", None)])
