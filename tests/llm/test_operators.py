import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from locusframe.llm import common, decontamination, divergence, html_blocks, language_crf, line_dedup, linking, log_bilinear, mixing, near_dedup, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = [a + b for a in ("ra", "ti", "mo", "ke", "lu", "so", "ne", "da") for b in ("n", "ster", "ling", "dor", "vex", "pa")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, a long text, repeated rows and a clashing and dotted extra columns."""
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, prose(1, 80), "en", "a", 1), (3, prose(2, 120), None, "b", 1), (3, prose(2, 120), None, "b", 1), (4, prose(3, 30000), "en", None, 1), (5, "42 !!", "en", "a", 1)]
    return spark.createDataFrame([(*r, 9, 9, 9.0, 8) for r in rows], DOC + ", copy int, __n int, score double, `meta.x` int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_warc_round_trip_of_segments(spark):
    long = "é<p>" * 60_000
    rows = [(1, "http://a/1", long), (2, "http://a/2 x", long), (3, None, None), (4, "u", "WARC/1.1\r\n\r\nx"), (None, "v", "y")]
    got = {r.page_id: r for r in warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for page_id, _, html in rows:
        body = (html or "").encode()
        assert got[page_id].payload_bytes == len(body)
        assert got[page_id].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")


def test_warc_broken_segments_are_told(spark):
    one = ("<a>", "response", "u", 1, None, 1, None, bytearray(b"ab"))
    rows = [one, ("<a:3>", "continuation", "u", None, "<a>", 3, 6, bytearray(b"ef"))]
    assert not warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).first().intact
    rows.append(("<a:2>", "continuation", "u", None, "<a>", 2, None, bytearray(b"cd")))
    whole = warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).first()
    assert whole.intact and bytes(whole.block) == b"abcdef"
    assert warc.dechunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunked(b"3\r\nab") is None


def base_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_divergence_counts_against_brute_force(spark):
    texts = [None, "", "a b c a b c\n\n x\n x\n# x", prose(4, 300), "é ü\x0b€|| a\n\ta\n\ta", "a a a a a", prose(5, 400).replace(" ", "%%% ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(100 + i, prose(100 + i, 200), "en", "s", 0) for i in range(30)], DOC)
    got = {r.doc_id: r for r in divergence.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t)
    assert got[3].kept and not got[6].kept and not got[0].kept


def test_js_distance(spark):
    from pyspark.sql import functions as F

    p, q = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert spark.range(1).select(divergence.js_distance(p, q).alias("d"), divergence.js_distance(p, p).alias("e")).first() == (1.0, 0.0)


def test_leaks_against_brute_force(spark):
    items = [(i, prose(200 + i, n)) for i, n in enumerate([5, 9, 14, 30, 37, 59, 90, 200, 3])] + [(50, None)]
    docs = [(i, prose(300 + i, 20) + " " + t + " " + prose(400 + i, 900)) for i, t in items if t] + [(60 + i, prose(500 + i, 700)) for i in range(20)] + [(90, None)]
    half = items[4][1].split()
    docs.append((91, prose(9, 50) + " " + " ".join(half[:20]) + " " + prose(10, 50)))
    docs.append((92, prose(9, 50) + " " + " ".join([*half[:10], "changed", *half[11:]]).title() + " " + prose(10, 50)))
    want = set()
    for d, text in docs:
        for i, t in items:
            s = decontamination.word_tuples(t or "", 5, True)
            if s and len(s & decontamination.word_tuples(text or "", len(next(iter(s))))) >= 0.8 * len(s):
                want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()} == want
    assert (92, 4) in want and (91, 4) not in want
    clean = {r.doc_id for r in decontamination.without_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    scores, trans = rng.normal(size=(7, 3)).astype(np.float32), rng.normal(size=(3, 3))
    rows = np.array([0, 4, 4, 7])
    got = language_crf.marginals(scores, trans, rows)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True), atol=1e-5)


def test_every_language_is_learned(spark):
    """70 languages, each of words of its own; the rarest have the fewest documents."""
    rows = []
    for k in range(70):
        rng = random.Random(k)
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        rows += [(100 * k + n, " ".join(rng.choice(own) for _ in range(40)), "l%02d" % k, "s", 0) for n in range(12 if k < 64 else 8)]
    docs = spark.createDataFrame(rows, DOC).coalesce(2)
    model = language_crf.fit(docs)
    assert len(model.languages) == 70
    got = {r.doc_id: r.lang_pred for r in language_crf.predict(docs, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[2] >= "l64")


def test_dart_signature_estimates_weighted_jaccard():
    a, b = prose(7, 400), prose(7, 400).replace("ranran", "x")
    left, right = pa.array([a + " " + a[:900], a]), pa.array([b, a + " " + prose(8, 60)])
    exact = near_dedup.weighted_jaccard(left, right)

    def signature(c):
        words, _, _, rows = common.word_hashes(*common.text_bytes(c))
        return near_dedup.dart_minhash(*near_dedup.elements(words, rows), len(c), 2000)

    assert np.allclose((signature(left) == signature(right)).mean(axis=1), exact, atol=0.05)


def test_near_duplicates_against_brute_force(spark):
    rng, texts = random.Random(3), []
    for g in range(12):
        base = prose(600 + g, 150).split()
        for k in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(150)] = "edit%d" % rng.randrange(999)
            texts.append(" ".join(copy))
    texts += [None, "", "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, root = len(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(n) for j in range(i) if texts[i] and texts[j]]
    score = near_dedup.weighted_jaccard(pa.array([texts[i] for i, _ in pairs]), pa.array([texts[j] for _, j in pairs]))
    for (i, j), s in zip(pairs, score):
        if s >= 0.8:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: got[i].class_id for i in got} == {i: find(i) for i in range(n)}
    assert sum(r.kept for r in got.values()) == len({find(i) for i in range(n)}) == near_dedup.keep_one(docs).count()


def test_lines(spark):
    a, b = prose(20, 40), prose(21, 40)
    near = a[:120] + "X" + a[121:]
    rows = [(1, f"{a}\nshort\n{b}"), (2, f"{near}\nshort"), (3, f"{a}\n{prose(22, 40)}"), (4, None), (5, "")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "short" and got[3].text == prose(22, 40)
    assert (got[4].text, got[5].text, got[3].n_removed, got[1].n_removed) == (None, "", 1, 0)


def test_short_lines(spark, tmp_path):
    """Every line with a word counts in the query and the pipeline's stage; blank lines stay."""
    import corpus_pipeline
    from locusframe.llm import queries

    rows = [(1, "Les.\n\nAll rights reserved.\na"), (2, "Les.\n\n \nAll rights reserved.\nb"), (3, "All rights reserved!\nab\nLes.\nLes\n\n"), (4, "Les."), (5, "some other line"), (6, None), (7, "\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: rows[0][1], 2: "\n \nb", 3: "ab\nLes\n\n", 4: "", 5: rows[4][1], 6: None, 7: "\n"}
    assert {r.doc_id: r.text for r in queries.op10_fuzzy_lines(spark, str(tmp_path)).collect()} == want
    stage = corpus_pipeline.drop_repeated_lines(spark, common.table(spark, str(tmp_path), "documents"), "")
    assert {r.doc_id: r.text for r in stage.collect()} == {k: v for k, v in want.items() if k != 4}


def test_cells_join_what_all_pairs_join(spark):
    rng, rows = random.Random(9), []
    for hub in range(6):
        base = prose(90 + hub, 30)
        for k in range(3 + 7 * hub):
            at = [rng.randrange(len(base)) for _ in range(rng.randrange(0, 5))]
            text = "".join("#" if i in at else c for i, c in enumerate(base)) if k else ""
            rows.append((hub, 0, hub % 2, 100 * hub + k, 100 * hub + k // 2, rng.choice([1, 2, 3]), text))
    cells = spark.createDataFrame(rows, "hub long, i int, j int, node long, comp long, part int, text string")

    def groups(links):
        root = {r[3]: r[4] for r in rows}
        for a, b in links:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        return root

    pairs = [(a[3], b[3], a[6], b[6]) for a in rows for b in rows if a[0] == b[0] and a[5] & 1 and b[5] & 2 and a[4] != b[4]]
    close = line_dedup.jaccard(pa.array([p[2] for p in pairs]), pa.array([p[3] for p in pairs])) >= 0.8
    want = groups([p[:2] for p, c in zip(pairs, close) if c])
    got = [(r.a, r.b) for r in linking.compare_cells(cells, line_dedup.tokens, 0.8).collect()]
    assert groups(got) == want and len(set(want.values())) < len({r[4] for r in rows})
    assert len(got) <= len(rows)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_class_probabilities_are_normalised():
    model = log_bilinear.train([np.array([0, 1, 2, 3, 0, 1, 2]), np.array([1, 4, 0])], 3)
    table = 10 ** model.log10_probabilities(np.array([[0, 1], [3, 3], [4, 2]]))
    assert np.allclose(table.sum(axis=1), 1, atol=1e-5)
    ids, first = np.array([0, 1, 3, 2, 3]), np.array([0, 3])
    want = [np.log10(table) for table in [10 ** model.log10_probabilities(np.array([c])) for c in ([3, 3], [3, 0], [0, 1], [3, 3], [3, 2])]]
    assert np.allclose(log_bilinear.score_classes(model, ids, first), [w[0, i] for w, i in zip(want, ids)], atol=1e-5)


def test_every_text_and_rare_word_trains(spark):
    """A pair of rare words is learned wherever it stands, and the words of one class add up to its probability."""
    rows = [(i, " ".join(f"{random.Random(i).choice(WORDS)}{j % 9}" for j in range(300)) + " zzqah vvubo" * 1000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = np.ones(1 + log_bilinear.RARE)
    start, unigram = log_bilinear.begin(counts, 0, np.random.default_rng(8))
    one = log_bilinear.one_pass(docs, start, log_bilinear.Dictionary([], 0), unigram, 0)

    def ending(words):
        data, offsets = common.text_bytes(pa.array(words))
        return log_bilinear.ending_classes(data, offsets[:-1], offsets[1:]).tolist()

    seen = set(ending(sorted({w for _, t in rows for w in t.split()})))
    moved = np.abs(one.vectors - start.vectors).max(axis=1) > 0
    assert all(moved[1 + k] for k in seen) and moved[0]
    a, b = (1 + k for k in ending(["zzqah", "vvubo"]))
    context = np.array([[b, a], [a, b]])
    table = log_bilinear.LogBilinear(0, *one.parameters()).log10_probabilities(context)
    assert table[0, b] > table[1, b]


def test_training_does_not_switch_by_the_size_of_the_input(spark):
    """The same texts and shares of classes give the same model, whatever the number of tokens the counts add up to."""
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=200))) for i in range(20)], "doc_id long, text string").coalesce(1)
    fits = [log_bilinear.fit(docs, log_bilinear.Dictionary([], 0), np.full(1 + log_bilinear.RARE, c)) for c in (1e1, 1e3, 1e6)]
    for other in fits[1:]:
        assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(fits[0].parameters(), other.parameters(), strict=True))


def test_steps_of_training_against_plain_gradients():
    """Two mini-batches of noise-contrastive estimation, token by token."""
    rng = np.random.default_rng(3)
    n, noise, rate = 2 * log_bilinear.BATCH, 5, 0.1
    target, context = rng.integers(0, 9, n), rng.integers(0, 9, (n, log_bilinear.CONTEXT))
    model, unigram = log_bilinear.begin(np.bincount(target, minlength=12).astype(float), 3, rng)
    got = [x.copy() for x in model.parameters()]
    log_bilinear.descend(got, log_bilinear.squares(got), target, context, unigram, np.random.default_rng(5), noise, rate)
    want = [x.astype(float) for x in model.parameters()]
    sums = [np.full(x.shape, log_bilinear.START) for x in want]
    again = np.random.default_rng(5)
    order = again.permutation(n)
    drawn = np.minimum(np.searchsorted(np.cumsum(unigram), again.random((2, noise))), 11)
    for at, z in zip(np.split(order, 2), drawn, strict=True):
        r, c, q, b = want
        grads = [np.zeros_like(x) for x in want]
        for i in at:
            hidden = sum(r[context[i, j]] * c[j] for j in range(log_bilinear.CONTEXT))
            up = np.zeros_like(hidden)
            for w, sign in [(target[i], 1), *((w, -1) for w in z)]:
                g = sign / (1 + np.exp(sign * (hidden @ q[w] + b[w] - np.log(noise * unigram[w])))) / len(at)
                grads[2][w] += g * hidden
                grads[3][w] += g
                up += g * q[w]
            for j in range(log_bilinear.CONTEXT):
                grads[0][context[i, j]] += up * c[j]
                grads[1][j] += up * r[context[i, j]]
        for x, s, g in zip(want, sums, grads, strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    assert all(np.allclose(x, y, atol=1e-3) for x, y in zip(got, want, strict=True))


def test_scores_of_rare_words_depend_on_the_context(spark):
    """Same words, other order: only a model that tells rare words apart scores the trained order higher."""
    common = [(i, " ".join(f"w{j}" for j in range(520)) * 2) for i in range(20)]
    trained = [(100 + i, "zzqah vvubo " * 2000) for i in range(60)]
    docs = spark.createDataFrame([*common, *trained, (-1, "zzqah vvubo zzqah vvubo zzqah vvubo"), (-2, "zzqah zzqah zzqah vvubo vvubo vvubo")], "doc_id long, text string")
    keep, log_bilinear.VOCABULARY = log_bilinear.VOCABULARY, 0
    try:
        got = {r.doc_id: r for r in log_bilinear.score_texts(docs).collect()}
    finally:
        log_bilinear.VOCABULARY = keep
    assert abs(got[-1].base_score - got[-2].base_score) < 1e-9 and got[-1].score > got[-2].score + 0.1


def test_poisson_mean_and_piecewise_draws(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(mixing.copies(F.lit(0.7), F.col("id").cast("string"), 1).alias("a"), mixing.copies(F.lit(150.0), F.col("id").cast("string"), 1).alias("b"), mixing.copies(F.lit(0.0), F.col("id").cast("string"), 1).alias("c"))
    r = df.agg(F.avg("a"), F.var_pop("a"), F.avg("b"), F.var_pop("b"), F.max("c")).first()
    assert abs(r[0] - 0.7) < 0.06 and abs(r[1] - 0.7) < 0.08 and abs(r[2] - 150) < 1 and abs(r[3] - 150) < 12 and r[4] == 0


def test_main_text():
    page = '<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site.</div><article><h1>Head &amp; line</h1><p>One   two<br>three <b>four</b> five six seven eight nine ten.<p>Short.</p><div class="comments"><p>I like this article a lot, thanks.</p></div></article><aside><p>More to read here now</p></aside><footer>&copy; me</footer>'
    assert html_blocks.main_text(page) == "Head & line\n\nOne two three four five six seven eight nine ten.\n\nShort."
    assert html_blocks.main_text(None) == "" == html_blocks.main_text("<nav><a>x</a></nav>")


def test_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string")
    for docs in (odd, none):
        n = docs.count()
        assert toxicity.classify(docs, labels).count() == n
        assert divergence.judge(docs).count() == n
        assert language_crf.predict(docs, language_crf.fit(docs)).count() == n
        assert near_dedup.near_duplicates(docs).count() == n
        assert log_bilinear.score_texts(docs).count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        assert decontamination.find_leaks(docs, bench).count() == (1 if n else 0)
        mixing.mix_sources(docs).count()
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html_blocks.extract_main_text(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).first().text == ""
