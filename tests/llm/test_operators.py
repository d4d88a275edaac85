"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import bpe, exact_dedup, language, media, packing, pii, simhash, substrings, tagger, toxicity, urls
from tessella.llm import _common
from tessella.llm._common import components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, rid int"
LONG = "Word by word the tale goes on. " * 9000 + "ünd" * 30000
TEXTS = ["Alpha beta gamma delta.", "Alpha  beta\ngamma delta.", "", None, "   \n", LONG, "Mail a.b@mail.example.com or +1 (386) 555-3733 and 1.2.3.4 now", "x", "Ünïcode ß 日本語 text 4242424242424242"]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, "en", "s", 0, True, 0.5, 7) for i, t in enumerate(TEXTS)]
    return [*made, made[0], (None, "Alpha beta gamma delta.", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none, rows):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows) and exact_dedup.exact_dedup(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[0]["keep_id"] == 1 and by[0]["group_size"] == 4 and by[1]["kept"] and not by[0]["kept"]
    assert by[2]["keep_id"] == by[3]["keep_id"] == by[4]["keep_id"] == 4
    assert by[5]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", LONG).encode()).hexdigest()


def test_substrings(spark, none):
    passage = " ".join(f"Word{i % 7} common text number {i}." for i in range(14))
    data = [(i, f"own start {i} here {passage} and the end {i}", None, None, None, None, None, None) for i in range(4)]
    got = substrings.repeated_passages(spark.createDataFrame([*data, (9, None, *[None] * 6), (10, "clean text alone.", *[None] * 6)], SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3] and all(r["keep_doc_id"] == 0 for r in got)
    for r in got:
        assert passage in data[r["doc_id"]][1][r["start"] : r["stop"]] or data[r["doc_id"]][1][r["start"] : r["stop"]] in passage
    assert substrings.repeated_passages(none).count() == 0
    assert substrings.remove("abcdef", [(4, 5), (1, 3)]) == "adf"


def test_substrings_to_the_word(spark):
    """Against brute force over all runs; passages start and end inside sentences, some hold no whole sentence."""
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(500)) + rng.choice(["", "", "", "", "", "."]) for _ in range(n)]
    shared = [words(n) for n in (51, 55, 60, 90, 39, 40)] + [[w.strip(".") for w in words(60)]]
    texts = [sum((part for k in rng.sample(range(7), 2) for part in (words(rng.randrange(30)), shared[k][rng.randrange(3) :])), []) + words(9) for _ in range(40)]
    texts += [texts[0], ["x", "y", "z"] * 40, words(30)]
    rows = [(i, rng.choice([" ", "\n"]).join(t)) for i, t in enumerate(texts)]
    n, seen, want = substrings.LEAST_WORDS, set(), set()
    for i, t in enumerate(texts):
        for j in range(len(t) - n + 1):
            run = tuple(t[j : j + n])
            if run in seen:
                want |= {(i, k) for k in range(j, j + n)}
            seen.add(run)
    got, whole = set(), dict(rows)
    for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        before, inside = whole[r["doc_id"]][: r["start"]].split(), whole[r["doc_id"]][r["start"] : r["stop"]].split()
        assert len(inside) == r["words"] and whole[r["keep_doc_id"]][r["keep_start"] :].split()[:n] == inside[:n]
        got |= {(r["doc_id"], len(before) + k) for k in range(len(inside))}
    assert got == want and len({i for i, _ in want}) > 30


def test_texts_without_repeats(spark, none):
    words = [f"word{i}" for i in range(30)]
    shared = " ".join(words[:12])
    rows = [(2, "start " + shared + "\u00e9nd  of it", 1), (1, shared, 2), (2, "start " + shared + "\u00e9nd  of it", 3), (None, f"x {shared} y {shared}", 4), (5, None, 5), (6, "", 6), (7, "alone", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long")
    got = {r["rid"]: (r["doc_id"], r["text"], [tuple(x) for x in r["removed"]]) for r in substrings.without_repeats(docs, 11).collect()}
    # The twelfth word of the rows 1 and 3 runs into other text, so eleven words are repeated there.
    eleven = len(" ".join(words[:11]))
    assert got[2] == (1, shared, []) and got[5] == (5, None, []) and got[6] == (6, "", []) and got[7] == (7, "alone", [])
    kept = "start " + " " + words[11] + "\u00e9nd  of it"
    assert sorted([got[1], got[3]], key=lambda r: len(r[1])) == [(2, "", [(0, len(rows[0][1]))]), (2, kept, [(6, 6 + eleven)])]
    assert got[4] == (None, "x  y ", [(2, 2 + len(shared)), (5 + len(shared), 5 + 2 * len(shared))])
    assert substrings.without_repeats(none).count() == 0
    clash = substrings.without_repeats(docs.selectExpr("*", "'kept' AS removed"), 11)
    assert clash.columns == ["doc_id", "text", "rid", "removed", "removed_"] and {r["removed"] for r in clash.collect()} == {"kept"}


def test_substrings_leave_little_on_disk(spark):
    """Once only the last join is to be done, neither the prints' tables nor the shuffles of finished jobs are left."""
    import os
    import time

    shared = _common.shared_dir(spark).removeprefix("file:")
    tables = lambda: {x for x in os.listdir(shared) if "prints-" in x and not x.startswith("repeated-")} if os.path.isdir(shared) else set()
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    had, n = tables(), shuffles()
    passage = " ".join(f"word{i}" for i in range(60))
    found = substrings.repeated_passages(spark.createDataFrame([(i, f"{i} {passage} {i}") for i in range(3)], "doc_id long, text string"))
    for _ in range(50):
        if shuffles() <= n:
            break
        time.sleep(0.2)
    assert tables() == had and shuffles() <= n
    assert sorted((r["doc_id"], r["words"]) for r in found.collect()) == [(1, 60), (2, 60)]


def test_pii_base_equals_patterns():
    rng = random.Random(5)
    for _ in range(400):
        t = "".join(rng.choice(["a", "1", "12", ".", "@", "+", " ", "-", "(", ")", "_", "b.c", "4242424242424242", "é", "\n"]) for _ in range(40))
        want = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        want += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == want


def test_tagger_gradient_and_training():
    p = {k: v.astype(np.float64) for k, v in tagger.start_weights(1).items()}
    made = [tagger.labelled(random.Random(i)) for i in range(2)]
    ids, tags = (np.stack([m[i] for m in made]).T for i in (0, 1))
    _, g = tagger.gradients(p, ids, tags)
    for k in ("fw", "out", "move"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        side = []
        for h in (1e-3, -1e-3):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += h
            side.append(tagger.gradients(q, ids, tags)[0])
        assert abs((side[0] - side[1]) / 2e-3 - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


def test_pii_operator(docs, none, rows):
    got = pii.find(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and (by[6]["n_email"], by[6]["n_ip"], by[6]["n_phone"], by[8]["n_card"]) == (1, 1, 1, 1)
    assert by[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and pii.find(none).count() == 0
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert hidden[6] == "Mail [EMAIL] or [PHONE] and [IP] now" and hidden[3] is None


def test_tagger_on_held_out_spans():
    """Recall and precision by kind on made-up text of another seed, whole operator: base spans, windows, reconciliation."""
    rng, model = random.Random(99), tagger.Tagger(tagger.trained())
    made = [tagger.labelled_text(rng, n) for n in [300] * 150 + [3000] * 15]
    texts = [x for x, _, _ in made]
    base = [pii.base_spans(t) for t in texts]
    hit, missed, wrong = ([0] * 4 for _ in range(3))
    for (_, _, gold), own, more in zip(made, base, pii.added_spans(model, texts, base)):
        found = set(own) | set(more)
        for k, a, b in gold:
            hit[k] += (k, a, b) in found
            missed[k] += (k, a, b) not in found
        for k, _, _ in set(more) - set(gold):
            wrong[k] += 1
    assert sum(hit) / (sum(hit) + sum(missed)) >= 0.9 and sum(hit) / (sum(hit) + sum(wrong)) >= 0.9
    assert all(h / (h + m) >= 0.8 for h, m in zip(hit, missed))
    prose = " ".join(tagger._word(rng) for _ in range(20_000))
    assert sum(map(len, pii.added_spans(model, [prose], [[]]))) <= 2


def test_bound_on_spans_is_exact():
    rng, model = random.Random(5), tagger.Tagger(tagger.start_weights(3))
    for share in (0.0, 0.3):
        ids = np.stack([tagger.symbols(tagger.labelled_text(rng, 80, share)[0][:80]) for _ in range(64)], axis=1).astype(np.int64)
        e = model.emissions(ids)
        e[:, 0] += rng.random() * 3
        tags, _ = model.decode(e.transpose(0, 2, 1))
        assert not ((tags > 0).any(axis=0) & ~model.may_tag(e)).any()
    x, _ = tagger._emit(tagger.start_weights(3), ids)
    assert np.allclose(model.emissions(ids).transpose(0, 2, 1), x, atol=1e-3)


def test_equal_windows_are_read_once():
    """Equal windows are read once, in one call or several, with the same spans as alone; the memory of them is bounded."""
    model, text = tagger.Tagger(tagger.trained()), "Mail ann.lee (at) example (dot) com now"
    reads, emissions = [], model.emissions
    model.emissions = lambda ids, *more: reads.append(ids.shape[1]) or emissions(ids, *more)
    alone = model.spans([text])[0]
    assert alone and model.spans([text, "no one", text, "no one", text]) == [alone, [], alone, [], alone] and reads == [1, 1]
    far = "x" * tagger.STRIDE + text
    assert [x[1:4] for x in model.spans([far])[0]][-1] == (alone[0][1], alone[0][2] + tagger.STRIDE, alone[0][3] + tagger.STRIDE)
    model.memory.update((i.to_bytes(4), []) for i in range(tagger.REMEMBERED))
    model.spans(["another one"])
    assert len(model.memory) == 1


def test_gates_are_the_same_however_large_the_sums():
    p, rng = tagger.start_weights(3), random.Random(6)
    ids = np.ascontiguousarray(tagger.symbols(tagger.labelled_text(rng, 100 * 16, 0.3)[0])[: 100 * 16].reshape(16, 100).T)
    for times in (1, 300):
        q = p | {"embed": p["embed"] * times}
        want, _ = tagger._emit({k: v.astype(np.float64) for k, v in q.items()}, ids)
        assert np.allclose(tagger.Tagger(q).emissions(ids).transpose(0, 2, 1), want, atol=1e-3)


def test_windows_are_decoded_together():
    """Few windows of each batch may hold a span; they are decoded together, not batch by batch."""
    model = tagger.Tagger(tagger.trained())
    code = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    texts = ["Mail ann.lee (at) example (dot) com now" if i % 300 == 0 else f"plain words go {code(i)} and on and on there" for i in range(3 * tagger.BATCH)]
    assert len({*map(len, texts)}) == 1
    calls, decode = [], model.decode
    model.decode = lambda e: calls.append(e.shape[1]) or decode(e)
    found = model.spans(texts)
    assert all(bool(x) == (i % 300 == 0) for i, x in enumerate(found)) and len(calls) == 1 and not any(model.spans(["", ""]))


def test_windows_do_not_depend_on_others():
    """What is found in a text, and how surely, is the same whatever texts go with it; decoding many spans takes little memory."""
    import tracemalloc

    model, rng = tagger.Tagger(tagger.start_weights(3)), random.Random(8)
    model.bias = model.bias + np.array([0.0] + [0.3] * (tagger.TAGS - 1), np.float32)
    texts = [tagger.labelled_text(rng, n, 0.4)[0][:n] for n in (1, 7, 40, 200, 900, 2047, 2048, 2060, 5000)]
    for alone, beside in zip((model.spans([t])[0] for t in texts), model.spans(texts)):
        assert [x[1:] for x in alone] == [x[1:] for x in beside] and np.allclose([x[0] for x in alone], [x[0] for x in beside], atol=1e-5)
    many = [tagger.labelled_text(rng, 400, 0.5)[0][:400] for _ in range(512)]
    tracemalloc.start()
    assert sum(map(len, model.spans(many))) > 1000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * (4 * 400 * tagger.TAGS * len(many))


def test_workers_keep_little():
    """One batch of emissions at a time, and nothing of the operators that a worker served before."""
    import tracemalloc

    model, texts = tagger.Tagger(tagger.start_weights(3)), [f"{i:06} words " * 30 for i in range(3 * tagger.BATCH)]
    model.bias = model.bias + np.array([50.0] + [0.0] * (tagger.TAGS - 1), np.float32)
    tracemalloc.start()
    assert not any(model.spans(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.7 * (4 * (360 + tagger.PAD) * tagger.TAGS * tagger.BATCH)
    _common.kept("packing")["x"] = 1
    assert _common.kept("packing") == {"x": 1} and _common.kept("pii") == {} and _common.kept("packing") == {}


def test_spans_at_every_alignment():
    """A span of up to 64 characters is found wherever windows cut the text, and windows cover every text."""
    model = tagger.Tagger(tagger.trained())
    span = "maria.gonzalez (at) example (dot) com"
    prose = " ".join(tagger._word(random.Random(i)) for i in range(1200))
    first = tagger.STRIDE - 60
    cut = [next(j for j in range(i, i + 40) if prose[j] == " ") for i in range(first, first + 200, 4)]
    texts = [prose[:j] + " " + span + ", " + prose[first + 240 :] for j in cut]
    found = pii.added_spans(model, texts, [[] for _ in texts])
    assert sum((0, t.index(span), t.index(span) + len(span)) in f for t, f in zip(texts, found)) >= 0.9 * len(texts)
    for n in (0, 1, 2047, 2048, 2049, 4000, 4001, 50_000):
        s = tagger.starts(n)
        assert all(b - a <= tagger.STRIDE for a, b in zip(s, s[1:])) and (not n or s[0] == 0 and s[-1] + tagger.WINDOW >= n)


def test_language(docs, none, rows):
    counts = [("en", w, 5) for w in "the and alpha beta gamma word tale goes".split()] + [("de", w, 5) for w in "der und ünd die nicht".split()]
    model = language.Model.fit(counts)
    got = {r["doc_id"]: r for r in language.languages(docs, model).collect()}
    assert got[0]["lang_pred"] == "en" and got[3]["lang_pred"] == got[2]["lang_pred"] == "und" and 0 <= got[5]["score"] <= 1
    assert model.predict("undder")[0] == "de" and model.predict("12 34") == ("und", 0.0)
    assert language.languages(none).count() == 0 and language.fit(none).langs == []
    assert language.keep_known(docs, model).count() == len(rows) - 3
    assert [model.predict(x)[0] for x in ("½ ² Ⅷ", "", "日本", "a²")] == ["und", "und", "de", "en"]


def test_language_learns_rare_ones_and_is_right(spark):
    """A language of few rows is learned beside a large one; held-out accuracy over the table."""
    made = [(i, f"the words of row {i} and others", "en") for i in range(400)] + [(1000 + i, f"die wörter der zeile {i} und andere", "de") for i in range(8)]
    model = language.fit(spark.createDataFrame(made, "doc_id long, text string, lang string"), 5)
    assert model.langs == ["de", "en"] and model.predict("zeile und wörter")[0] == "de"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.languages(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_toxicity(spark, docs, none, rows):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, labels = [], []
    for i in range(300):
        y = int(i % 5 == 0)
        texts.append(" ".join([word() for _ in range(20)] + ["moronic", "idiotic"] * y))
        labels.append(y)
    index = toxicity.Index.fit(texts, labels)
    assert index.score("quite moronic text")[0] >= 0.5 > index.score("a fair text")[0]
    v = index.vector(texts[0])
    scores = sorted(((-round(float(sum(x * index.dense[t, i] for t, x in v.items())), 12), i) for i in range(index.size)))[:5]
    assert [i for _, i in index.nearest(v, 5)] == [i for _, i in scores]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, empty).count() == len(rows) and toxicity.toxicity(none, empty).count() == 0


def test_toxicity_index_travels():
    import pickle

    index = toxicity.Index.fit(["a fool and a knave", "a fine day and a walk", "such fools", "days of walks"] * 8, [1, 0, 1, 0] * 8)
    again = pickle.loads(pickle.dumps(index))
    texts = ["what a fool", "a walk", "", None, "knave fools day"]
    assert again.scores(texts) == index.scores(texts) and again.scores(texts)[0] == index.score("what a fool")


def test_toxicity_searches_all_terms():
    """Every example and term is in the index, and a copy of an example finds it though no term of it tells labels apart."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(15)) for _ in range(200)]
    labels = [int(i % 10 == 0) for i in range(200)]
    index = toxicity.Index.fit(texts, labels)
    assert index.size == 200 and set(index.vocabulary) == {t for x in texts for t in toxicity.terms(x)}
    for i, x in enumerate(texts):
        cosine, place = index.nearest(index.vector(x), 1)[0]
        assert index.ids[place] == i and abs(cosine - 1) < 1e-9
    dense, v = index.dense, index.vector(texts[7] + " " + texts[8])
    all_of = sum(x * dense[t] for t, x in v.items())
    want = sorted(range(index.size), key=lambda i: (-round(all_of[i], 12), i))[:24]
    assert [i for s, i in index.nearest(v)] == [i for i in want if all_of[i] > 0]
    # Whole texts against brute force, with blocks and dense terms of other sizes.
    for block, common in ((8, 5), (128, 3072)):
        toxicity.COMMON, kept = common, toxicity.COMMON
        other = toxicity.Index(index.vocabulary, [index.arrays(texts[i]) for i in index.ids], [labels[i] for i in index.ids], 0.1, index.ids, block)
        toxicity.COMMON = kept
        for near, i in zip(other.search([index.arrays(texts[i] + " " + texts[-i]) for i in range(60)], 7), range(60)):
            v = index.vector(texts[i] + " " + texts[-i])
            full = sum(x * dense[t] for t, x in v.items())
            assert [j for _, j in near] == sorted(range(200), key=lambda j: (-round(full[j], 12), j))[:7]
            assert np.allclose([c for c, _ in near], [full[j] for _, j in near])


def test_toxicity_reads_blocks_side_by_side_as_one_stretch():
    """A term's postings in neighbouring blocks are found by two places, not by two for each block."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = [" ".join(rng.sample(words, 12)) for _ in range(400)]
    index = toxicity.Index.fit(texts, [i % 2 for i in range(400)])
    toxicity.COMMON, kept = 0, toxicity.COMMON
    index = toxicity.Index(index.vocabulary, [index.arrays(texts[i]) for i in index.ids], [i % 2 for i in index.ids], 0.5, index.ids, 4)
    toxicity.COMMON = kept
    dense, at, begin, read = index.dense, index.arrays(" ".join(words[:40])), index.begin, []

    class Begin:
        def __getitem__(self, i):
            read.append(np.size(i))
            return begin[i]

    index.begin = Begin()
    near = index.search([at], 200)[0]
    full = at[1] @ dense[at[0]]
    assert np.allclose([c for c, _ in near], np.sort(full)[::-1][: len(near)]) and len(near) == 200
    assert sum(read) < len(at[0]) * index.blocks


def test_media(spark, none):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    passage = noise(40_000)
    texts = [*TEXTS, passage, passage, noise(9_000) + passage + noise(7_000), passage + noise(5), noise(3_000) * 9, TEXTS[0]]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, True, 0.5, 7) for i, t in enumerate(texts)] + [(0, texts[0], *[None] * 6)], SCHEMA)
    lists, chunks = media.store(docs)
    # Ownership against a dict: each distinct chunk is stored once, with its row or in the chunk table.
    files = [media.wav(media.payload(t)[0]) for t in texts] + [media.wav(media.payload(texts[0])[0])]
    want = {}
    for f in files:
        ends = media.cuts(f)
        for a, b in zip([0, *ends], ends):
            want[hashlib.sha256(f[a:b]).digest()] = f[a:b]
    held = [(bytes(r.digest), bytes(r.bytes)) for r in chunks.collect()]
    held += [(bytes(d), bytes(c)) for r in lists.collect() for d, c in zip(r.digests, r.chunks) if c is not None]
    assert len(held) == len(want) and dict(held) == want and chunks.count() > 8
    got, whole = media.described((lists, chunks)).collect(), media.files((lists, chunks)).collect()
    assert len(got) == len(whole) == len(texts) + 1
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        body = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest())
        assert (r["media_bytes"], r["media_sha256"]) == (len(body) + 44, hashlib.sha256(media.wav(body)).hexdigest())
        x = np.frombuffer(body, np.uint8).astype(float)
        assert r["tail_crc32"] == zlib.crc32(body[-16:]) and r["feature"].startswith(f"mean={x.mean():.4f};rms={((x - 128) ** 2).mean() ** 0.5:.4f};zc=")
    assert sorted((r["doc_id"], bytes(r["media"])) for r in whole) == sorted(zip([*range(len(texts)), 0], files))
    assert media.described(media.store(none)).count() == 0
    data = random.Random(0).randbytes(200_000)
    ends = media.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))
    shifted = media.cuts(b"abc" + data)
    assert len({e + 3 for e in ends} & set(shifted)) > len(ends) // 2


@pytest.mark.parametrize("chunk, overlap, deal", [(1 << 12, 1 << 7, 1 << 16), (40, 8, 60), (7, 2, 9), (7, 2, 1 << 16)])
def test_bpe_round_trip(spark, chunk, overlap, deal):
    import base64

    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = [*TEXTS, "a" * 300, "  lead\n\n\n  x  " * 30, "it's 12345 we'll   go " * 9]
    if chunk < 1000:
        texts = [t for t in texts if t is not LONG]
    rows = [*enumerate(texts), (0, texts[0])]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), ranks, P.PATTERN, chunk, overlap, deal=deal).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    for r in got:
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_urls(spark):
    data = ["http://A.example.COM/en/7x?q", "https://b.com/en/1#t", "ftp://example.net/de/8", "x://net/de/9", "no scheme", None, "http://notcom/en/", "http://org/es/?a", "a://b://c", "http://" + "a." * 2000 + "com/en/"]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(list(enumerate(data)), "page_id long, url string")).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", None, None, None, "org/es/", None, "com/en/"]
    assert got[0]["verdict"] == "allow" and got[2]["verdict"] == "block" and got[5]["host"] == "" and got[0]["host"] == "a.example.com"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def near(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_fingerprint_bits():
    import xxhash

    for t in [*TEXTS, "one two", "One  TWO three", "É é Two three", "a a a a a", None]:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_links(spark, bucket):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    for _ in range(160):
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    place = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in simhash.links(df, bucket).collect():
        a, b = sorted((root(place[r["u"]]), root(place[r["v"]])))
        parent[b] = a
    assert [root(i) for i in range(len(fps))] == near(fps)


def test_simhash_operator(docs, none, rows):
    got = simhash.simhash_dedup(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[0]["component_id"] == by[1]["component_id"] == by[None]["component_id"] == 0 and by[2]["fingerprint"] == "0" * 16
    assert simhash.simhash_dedup(none).count() == 0


def best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(size - n)
    return len(free), sorted(free)


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_sweep_is_the_same_in_any_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.randint(1, 12), rng.random() < 0.5, i, 0) for i in range(300)]
    state = spark.createDataFrame([(*r, [r[0]]) for r in rows], "value long, gap boolean, id long, cum long, lens array<int>")
    got = packing.stitched(packing.table(packing.swept(state, ranges), "swept")).collect()
    waiting, pairs = [], []
    for value, gap, i, *_ in sorted(rows):
        if not gap:
            waiting.append(i)
        elif waiting:
            pairs.append((waiting.pop(), i))
    assert sorted((r["id"], r["sid"]) for r in got if r["kind"] == packing.PAIR) == sorted(pairs)
    assert sorted(r["id"] for r in got if r["kind"] == packing.LEFT) == sorted(waiting)
    assert sorted(r["sid"] for r in got if r["kind"] == packing.SPARE) == sorted(i for _, gap, i, *_ in rows if gap and i not in dict(map(reversed, pairs)))


@pytest.mark.parametrize("kind", ["mixed", "thirds", "halves", "tiny", "equal"])
def test_placement(spark, kind, monkeypatch):
    rng, size = random.Random(4), 64
    of = {"mixed": lambda: min(size, int(rng.expovariate(0.08)) + 1), "thirds": lambda: 22, "halves": lambda: 33, "tiny": lambda: rng.randint(1, 2), "equal": lambda: 9}[kind]
    lengths = [of() for _ in range(400)]
    parts = spark.createDataFrame([*enumerate(lengths)], "rid long, length long").repartition(3)
    results = []
    monkeypatch.setattr(packing, "UNIT", 8)
    for rows in (50_000, 110):
        monkeypatch.setattr(packing, "ROWS", rows)
        got = packing.placed(parts, size).collect()
        assert sorted((r["rid"], r["length"]) for r in got) == [*enumerate(lengths)]
        filled = {}
        for r in sorted(got, key=lambda r: r["offset"]):
            assert filled.get(r["sequence_id"], 0) == r["offset"]
            filled[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(filled.values()) <= size and len(filled) <= 1.02 * best_fit(lengths, size)[0] + 1
        results.append(sorted((r["rid"], r["sequence_id"], r["offset"]) for r in got))
    assert results[0] == results[1]


def test_vocabulary_entries_encode_to_themselves():
    import json

    path = P.path("word_bpe_49k.json")
    enc = packing.Encoder.load(path)
    for token, i in json.load(open(path))["model"]["vocab"].items():
        raw = bytes(packing._BYTE_OF[c] for c in token.removesuffix("</w>"))
        assert enc.merges(raw + b"\xff" * token.endswith("</w>")) == [i]


def test_packing(spark, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, size = Tokenizer.from_file(path), 50
    texts = [*TEXTS[:5], *TEXTS[6:], "ΣΑΣ İstanbul don't a\x85b \x1c ﬁ ½ ²", "a<|endoftext|>b", "<|endoftext|>", "x <|StartOfText|> <|startoftext|><|endoftext|>y", LONG[:3000], LONG[:3000], " ".join(f"w{i}" for i in range(24))]
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert want[texts.index("<|endoftext|>")] == [49407, 1]
    rows = [*enumerate(texts), (0, texts[0]), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, True, 0.5, 7) for i, t in rows], SCHEMA)
    got = packing.pack(docs, path, size, tokens=True).collect()
    # Every piece of every row, by brute force: ids, start, length, checksum.
    ids = [(i, want[texts.index(t)] if i is not None else [*lib.encode(t, add_special_tokens=False).ids, 1]) for i, t in rows]
    pieces = [(i, k, k * size, x[k * size : (k + 1) * size]) for i, x in ids for k in range(-(-len(x) // size))]
    key = lambda r: (r[0] is None, r)
    assert sorted([(i, k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), np.array(x, "<u4").tobytes()) for i, k, a, x in pieces], key=key) == sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got], key=key)
    filled = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= size and len(filled) <= best_fit([len(x) for *_, x in pieces], size)[0] + 1
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("kind", ["chain", "stars", "random", "none"])
def test_components_reach_the_least_node(spark, kind):
    rng = random.Random(3)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)],
        "stars": [(i, i % 7) for i in range(7, 80)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
        "none": [(5, 5)],
    }[kind]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for u, v in pairs if u != v for x in (u, v)}
    assert got == {x: root(x) for x in linked}
