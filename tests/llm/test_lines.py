"""Lines and paragraphs that repeat, against brute force and SQL."""

import random
import re

import duckdb
import pytest

from tessella.llm import queries, substrings

SCHEMA = "doc_id long, text string, rid int, h string, start int"


def later_copies(rows, mark):
    """{(doc_id, text, start, stop): (keep_doc_id, keep_start)} of rows (doc_id, text) in their order."""
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        at = 0
        for piece in re.split(f"({mark})", text or "")[::2]:
            end = re.compile(mark).match(text or "", at + len(piece))
            stop = end.end() if end else at + len(piece)
            unit = " ".join(piece.lower().split())
            if unit:
                if unit in seen:
                    out.append((doc, at, stop, *seen[unit]))
                else:
                    seen[unit] = (doc, at, stop)
            at = stop
    return sorted(out, key=str)


def texts():
    rng = random.Random(5)
    pool = ["The same line.", "  the SAME\tline. ", "Énd of it", "x", "", "   ", "long " * 50, "日本語 line"]
    made = [(i, "".join(rng.choice([*pool, f"own {i} {k}"]) + rng.choice(["\n", "\n", "\n\n", "\n \n"]) for k in range(rng.randrange(12)))) for i in range(40)]
    return [*made, (50, None), (51, ""), (52, "\n\n"), (53, "hot line\n" * 3000 + "the end"), (54, "no break at all"), (None, "the same line.\nhot line")]


@pytest.mark.parametrize("mark", [substrings.LINE, substrings.PARAGRAPH])
def test_repeated_units(spark, mark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "h", 2) for r in rows], SCHEMA)
    got = substrings.repeated_units(docs, mark)
    assert got.columns == ["doc_id", "start", "stop", "keep_doc_id", "keep_start", "keep_stop"]
    want = later_copies(rows, mark)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 50
    assert substrings.repeated_units(docs.limit(0), mark).count() == 0


def test_rows_that_share_a_doc_id_are_copies(spark):
    docs = spark.createDataFrame([(1, "a line of it\nanother"), (1, "a line of it\nanother")], "doc_id long, text string")
    assert sorted((r["start"], r["stop"]) for r in substrings.repeated_units(docs).collect()) == [(0, 13), (13, 20)]


def test_lines_and_passages_go_together(spark):
    """Nothing that goes is lost, and no line stays twice."""
    rng = random.Random(9)
    passage = " ".join(f"word{i}" for i in range(20))
    rows = [(i, f"first {i}\nCommon line\nown {i} starts {passage} and ends {rng.random()}\n{passage}\ncommon  line") for i in range(12)]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 15, substrings.LINE).collect()}
    assert len(got) == 12
    whole = " ".join(r["text"] for r in got.values()).lower().split()
    assert {w for _, t in rows for w in t.lower().split()} == set(whole) and whole.count("common") == 1 and whole.count("word7") == 1
    for i, text in rows:
        spans = [tuple(x) for x in got[i]["removed"]]
        assert spans == sorted(spans) and all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
        assert substrings.remove(text, spans) == got[i]["text"]


def test_lines_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(substrings.SQL.replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    got = [tuple(r) for r in queries.QUERIES["substring_dedup_lines"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
