"""The stages of the pipeline against plain Python, each on the rows that its predecessor kept."""

import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from locusframe.llm import common, decontamination, line_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars int, row string, gone int, kept int, score string, __row long, drawn int, `meta.x` int"
WORDS = [a + b for a in ("ra", "ti", "mo", "ke", "lu", "so", "ne", "da") for b in ("n", "ster", "ling", "dor", "vex", "pa")]
HATE = ["vilescum", "filthrot", "hatespit"]


def prose(seed, n, width=12):
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, n, width))


def shingles(text, n, chars):
    items = text if chars else text.split()
    if not items:
        return Counter()
    if len(items) < n:
        return Counter([text if chars else tuple(items)])
    return Counter(items[i : i + n] if chars else tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def alike(a, b, weighted):
    if weighted:
        return sum((a & b).values()) / max(1, sum((a | b).values()))
    return len(a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))


def groups(items, n, chars):
    """Smallest place of the component of each item, by all pairs."""
    sets, root = [shingles(x, n, chars) for x in items], list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if items[i].strip() and items[j].strip() and (items[i] == items[j] or (min(len(items[i]), len(items[j])) >= (n if chars else 0) and alike(sets[i], sets[j], not chars) >= 0.8)):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(2), str(tmp_path_factory.mktemp("tables"))
    texts = [prose(i, 40 + 7 * (i % 9)) for i in range(34)]
    toxic = [" ".join([prose(100 + i, 30), *rng.sample(HATE, 2)]) for i in range(24)]
    item = prose(900, 30).replace("\n", " ")
    shared = prose(901, 20, 20)
    texts[1] += "\n" + shared
    texts[2] += "\n" + shared.replace("a", "e", 2)
    words = texts[4].split()
    texts[3] = "\n".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3))  # the same words in other lines
    texts[5] = texts[6]
    texts[7] = prose(7, 20) + "\n" + item + "\n" + prose(8, 20)
    texts += [None, "", " \n ", "Les.\nLes.", "Les."]
    rows = [(i, t, "en", None if i % 7 == 0 else "s%d" % min(i % 5, 2), len(t or "")) for i, t in enumerate([*texts, *toxic])] + [(None, prose(55, 30), "en", "s0", 1)]
    rows.append(rows[9])
    spark.createDataFrame([(*r, "r", 1, 2, "s", 5, 6, 7) for r in rows], DOC).coalesce(1).write.parquet(f"{at}/documents.parquet")
    first = len(texts)
    labels = [(i, 1, int(i >= first)) for i in [*range(0, 34), *range(first, first + 24)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(902, 12))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, range(first, first + 24), item


def texts_of(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r.text is None) for r in rows)


def test_stages(spark, tables):
    at, toxic, item = tables
    docs = common.table(spark, at, "documents")
    want_columns, stage = docs.columns, dict(corpus_pipeline.STAGES)

    kept = common.stored(stage["toxicity"](spark, docs, at), "a")
    assert kept.columns == want_columns
    scored = toxicity.score(docs, toxicity.fit(docs, common.table(spark, at, "labels")), "s").collect()
    assert texts_of(kept.collect()) == texts_of([r for r in scored if r.s < 0.5])
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone <= set(toxic) and len(gone) >= 0.7 * len(toxic)

    before = kept.collect()  # one file, so in the order of the rows
    lines = [(i, k, x) for i, r in enumerate(before) for k, x in enumerate((r.text or "").split("\n")) if x.strip()]
    root = groups([x for _, _, x in lines], line_dedup.SHINGLE, True)
    drop = {(i, k) for n, (i, k, _) in enumerate(lines) if root[n] != n}
    want = []
    for i, r in enumerate(before):
        text = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (i, k) not in drop)
        if not any(a == i for a, _ in drop) or text.strip():
            want.append((-1 if r.doc_id is None else r.doc_id, text or "", text is None))
    kept = common.stored(stage["line_dedup"](spark, kept, at), "b")
    assert kept.columns == want_columns and texts_of(kept.collect()) == sorted(want) and drop
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text and r.doc_id in (2,))

    before = sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    root = groups([r.text or "" for r in before], 5, False)
    want = [r for i, r in enumerate(before) if root[i] == i]
    kept = common.stored(stage["near_dedup"](spark, kept, at), "c")
    assert texts_of(kept.collect()) == texts_of(want) and len(want) < len(before)

    before = kept.collect()
    of_item = decontamination.word_tuples(item)
    want = [r for r in before if len(of_item & decontamination.word_tuples(r.text or "")) < 0.8 * len(of_item)]
    kept = common.stored(stage["decontamination"](spark, kept, at), "d")
    assert kept.columns == want_columns and texts_of(kept.collect()) == texts_of(want) and len(want) == len(before) - 1

    before = kept.collect()
    n = Counter(r.source for r in before)
    total = sum(math.sqrt(x) for x in n.values())
    want = Counter()
    for r in before:
        key = str(r.doc_id) if r.doc_id is not None else "t" + hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"17|{key}|1".encode()).hexdigest()[:13], 16) / 16**13
        rate = len(before) * math.sqrt(n[r.source]) / total / n[r.source]
        p, cdf, k = math.exp(-rate), math.exp(-rate), 0
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        want[r.doc_id] += k
    mixed = stage["mixing"](spark, kept, at).collect()
    assert Counter(r.doc_id for r in mixed) == +want


def test_empty_documents(spark, tables, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0, name
