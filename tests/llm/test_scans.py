"""License scans, vector codes and phrases against brute force and their SQL, and on rows of every odd kind."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pytest

from tessella.llm import codes, licenses, phrases, queries
from tessella.llm._common import joined_by

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, label int, score double, n long, hash long, rank int"


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_vector_codes", "op13_phrase_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DIR)
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    cols = sorted(got.columns)
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    want = sorted(str([plain(dict(zip(names, r))[c]) for c in cols]) for r in res.fetchall())
    assert want and want == sorted(str([plain(r[c]) for c in cols]) for r in got.collect())


# --- licenses ------------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stand(ws, phrase):
    p = phrase.split()
    return [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]


def scanned(texts):
    """The scan by its definition, over dictionaries."""
    cut = [words(t) for t in texts]
    df = Counter(w for ws in cut for w in set(ws))
    out = []
    for ws in cut:
        base = [(i, label) for p, label in licenses.BASE for i in stand(ws, p)]
        best = {}
        for t, (_, text, musts) in enumerate(licenses.TEMPLATES):
            tw = text.split()
            rare = sorted(range(len(tw)), key=lambda q: (df[tw[q]], q))[: min(licenses.RARE, math.ceil(len(tw) * 3 / 5))]
            weight = {q: 1 + math.log((1 + len(texts)) / (1 + df[tw[q]])) for q in rare}
            spots = {(q, (p - q) // licenses.SLACK) for q in rare for p, w in enumerate(ws) if w == tw[q]}
            for s in {s for _, s in spots}:
                share = round(sum(weight[q] for q in rare if (q, s) in spots or (q, s + 1) in spots) / sum(weight.values()), 9)
                begins = [{(i - next(q for q in range(len(tw)) if tw[q : q + len(m.split())] == m.split())) // licenses.SLACK for i in stand(ws, m)} for m in musts]
                if share >= licenses.ENOUGH and all({s, s + 1} & b for b in begins):
                    best[t] = max(share, best.get(t, 0))
        labels = {label for _, label in base} | {licenses.TEMPLATES[t][0] for t in best}
        at = [i for i, _ in base]
        out.append((len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(max([0.5 if base else 0.0, *best.values()]), 6)))
    return out


def test_licenses_by_brute_force(spark):
    rng = random.Random(4)
    noise = "the of software a license this is work under and version words free in 3 by public".split()
    texts = [None, "", "   ", "Ünï GNU General Public License,gnu general\npublic license", "cc-by CC BY cc", "mit. LICENSE mit license", "x" * 300000, ("noise words here " * 60000) + licenses.TEMPLATES[7][1]]
    for t in range(60):
        own = [w for _ in range(rng.randrange(1, 3)) for w in rng.choice(licenses.TEMPLATES)[1].split() + rng.choices(noise, k=rng.randrange(20))]
        for _ in range(rng.randrange(12)):  # words go, come or change
            i = rng.randrange(len(own))
            own[i : i + rng.randrange(2)] = rng.choices(noise, k=rng.randrange(2))
        texts.append(rng.choice([" ", ", ", "\n * "]).join(w.upper() if rng.random() < 0.2 else w for w in own))
    texts += [texts[20], texts[20]]
    rows = [(i, t, "en", 1, 0.5, 3, 4, 5) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = scanned(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum("," in w[5] for w in want) > 5 and any(w[5] and not w[4] for w in want)
    again = licenses.scan(spark.createDataFrame([*rows[:5], rows[4], (None, *rows[4][1:])], SCHEMA)).collect()
    assert len(again) == 7 and sum(r["labels"].startswith("cc-by") for r in again) == 3
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_are_cut_alike_in_parts(monkeypatch):
    ids = licenses.word_ids()
    text = "MIT license, ünder  the GNU\x00General public-license " * 40
    want = licenses.words_of(text, ids)
    assert want.tolist() == [ids.get(w.encode(), -1) for w in words(text)]
    for part in (1, 2, 7, 64):
        monkeypatch.setattr(licenses, "PART", part)
        assert licenses.words_of(text, ids).tolist() == want.tolist()


# --- vector codes --------------------------------------------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """k-means by its definition on Python integers."""
    keep = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    keep = [(i, [math.floor(codes.SCALE * x) for x in e], label) for i, e, label in keep]
    order = sorted(keep, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[1], p) for r in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[near(r[1], p)[1] for p in range(parts)] for r in order]
        new = [[list(e) for e in b] for b in books]
        for p, k in product(range(parts), range(len(books[0]))):
            own = [cut(r[1], p) for r, a in zip(order, at) if a[p] == k]
            if own:
                new[p][k] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    end = [[near(r[1], p) for p in range(parts)] for r in order]
    errors = [sum(d for d, _ in e) for e in end]
    by = Counter()
    for r, e in zip(order, errors):
        by[r[2]] += e
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in e), error, by[r[2]], name) for r, e, error in zip(order, end, errors)), key=str)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, n int"


@pytest.mark.parametrize("n", [1, 5, 300])
def test_codes_by_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 37)
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 16)], int(i) % 3 if i % 7 else None) for i in rng.permutation(n)]
    rows += rows[:2] + [(1000 + i, rows[0][1], 1) for i in range(n)] + [(None, [0.25] * 16, None)]
    bad = [(0, None, 1), (1, [0.5] * 15 + [None], 1), (2, [float("nan")] + [0.5] * 15, 1), (3, [float("-inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 9, 9) for r in rows + bad], VECTORS)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compress(df.repartition(4)).collect()]
    assert sorted(got, key=str) == coded(rows, 8, 16, 6)


def test_codes_without_rows_or_sense(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert codes.compress(make([])).count() == 0 and codes.compress(make([(1, None, 2)])).count() == 0
    for rows, text in (([(1, [0.5] * 12, 1)], "equal parts"), ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], "several lengths"), ([(1, [3e38] * 8, 1)], "too large")):
        with pytest.raises(Exception, match=text):
            codes.compress(make(rows).coalesce(1)).collect()


def test_joined_by_splits_hot_keys(spark):
    keys = [None] * 400 + [1] * 300 + list(range(2, 900))
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    small = big.groupBy("k").count().withColumnRenamed("count", "rows").selectExpr("k", "rows", "rows * 2 AS twice")
    got = joined_by(big, small, "k")
    n = Counter(keys)
    assert got.columns == ["k", "i", "twice"] and sorted(map(tuple, got.collect()), key=str) == sorted(((k, i, 2 * n[k]) for i, k in enumerate(keys)), key=str)


# --- phrases -------------------------------------------------------------------------------------------------------


def mined(docs, least, top, most=4):
    """Collocations by counting every phrase in a dictionary."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, most + 1) for i in range(len(ws) - m + 1))
    often = {k: a for k, a in f.items() if a >= least}
    out = []
    for (lang, ws), a in often.items():
        if len(ws) < 2:
            continue
        longer = [b for (x, v), b in often.items() if x == lang and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        score, k = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.append((lang, score, a, " ".join(ws), f[lang, ws[:k]], f[lang, ws[k:]]))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        ranked += [(lang, i, r[3], r[2], r[4], r[5], n[lang], r[1]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


@pytest.mark.parametrize("shard, top", [(60, 2000), (1 << 20, 2000), (500, 7)])
def test_phrases_by_brute_force(spark, shard, top):
    rng = random.Random(9)
    vocab = ["The", "of", "wörd", "日本", "a-b", "x", "'s", "Ω", "\x0bq", "e f"]
    texts = [(" ".join(rng.choices(vocab, [9, 8, 3, 2, 2, 2, 1, 1, 1, 1], k=rng.randrange(60))).replace("x", rng.choice(["x", "x,", ". \t", "X\n"])), rng.choice(["en", "de", "und", None])) for _ in range(80)]
    texts += [(None, "en"), ("", None), ("of the of the of the of the " * 30, "en"), ("solo", "xx"), texts[3], texts[3], ("a " * 900, "fr")]
    docs = spark.createDataFrame([(i, t, lang, 1, 0.5, 3, 4, 5) for i, (t, lang) in enumerate(texts)], SCHEMA).repartition(4)
    got = sorted(map(tuple, phrases.collocations(docs, least=5, top=top, shard=shard).collect()))
    assert got == mined(texts, 5, top) and len(got) > 20
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_intervals_count_phrases():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 50, 400):
        ids = rng.integers(0, 4, n).astype(np.int32)
        order, shared = phrases.suffixes(ids, 4)
        for m in (1, 2, 3, 4):
            at, count = phrases.phrases(ids, order, shared, m)
            want = Counter(tuple(ids[i : i + m]) for i in range(n - m + 1) if (ids[i : i + m] > 0).all())
            assert {tuple(ids[a : a + m]): c for a, c in zip(at, count)} == want


@pytest.mark.parametrize("deal, least", [(4, 4), (12, 4), (20, 300)])
def test_filter_passes_what_is_frequent(spark, deal, least):
    keys = np.array([random.Random(1).getrandbits(64) for _ in range(1)] + [random.Random(i).getrandbits(64) for i in range(2, 4001)], np.uint64)
    rng = np.random.default_rng(deal)
    total, rows = np.zeros(len(keys), int), []
    for _ in range(5):
        n = rng.integers(0, 2 * least // 3, len(keys))
        total += n
        rows += [r for b in phrases.dealt(keys[n > 0], n[n > 0], deal, least) for r in b.to_pylist()]
    bits = phrases.frequent(spark.createDataFrame([(r["bucket"], bytearray(r["keys"]), bytearray(r["counts"])) for r in rows], phrases.DEALT), deal, least)
    ok = phrases.passes(bits, keys)
    assert ok[total >= least].all() and ok[total < least].mean() < 0.1 and (total < least).sum() > 100


def test_products_beyond_64_bits(spark):
    big = 6 * 10**18
    often = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big), ("en", "a b", big - 1), ("en", "a b c", big * 4 // 5 - 1), ("en", "b c", big), ("en", "c", big)], "lang string, phrase string, f long")
    got = {r["phrase"]: r for r in phrases.scored(often).collect()}
    assert got["a b"]["score"] == 2000000 * (big - 1) // (2 * big + 7) and "b c" in got
    assert "a b" not in {r["phrase"] for r in phrases.scored(often.union(spark.createDataFrame([("en", "a b d", big * 4 // 5 + 1), ("en", "b d", big), ("en", "d", big)], often.schema))).collect()}


def test_a_shard_is_a_row_group_of_its_own(spark, tmp_path):
    """Spark reads and writes a row group's rows in one buffer, and shards are rows of megabytes."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(f"one two three four five six {i}", "en") for i in range(300)], "text string, lang string").coalesce(1)
    made = phrases.shards(docs, 200)
    held = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
    assert sum(m.num_rows for m in held) > 5
    assert all(m.row_group(i).num_rows == 1 for m in held for i in range(m.num_row_groups))
