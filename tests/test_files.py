"""FASTA files read in splits against a parser that goes line by line."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import files

from . import brute

PLAIN = ">one first\nACGT\nac-t\n>two\nAC\nGTAC\nGT\n>\nACGTACGT\n>one again\n\nACGTACGT\n"


def rows(spark, path, split=1 << 27):
    """The rows of files that are read in splits of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    taxa = files.read_alignment(spark, str(path)).select("aln_id", "taxon_idx", "taxon_id", "seq")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return sorted(taxa.collect())


def wanted(text):
    return [(i, n, files.capital(s)) for i, (n, s) in enumerate(brute.parse_fasta(text))]


def test_every_cut_gives_the_same_rows(spark, tmp_path):
    """Splits of one byte each, so every byte of the file begins one, and some longer ones."""
    (tmp_path / "a.fasta").write_text(PLAIN)
    for n in (1, 2, 5, 23):
        assert [r[1:] for r in rows(spark, tmp_path / "a.fasta", n)] == wanted(PLAIN), n


@pytest.mark.parametrize(
    "text",
    [
        PLAIN.replace("\n", "\r\n"),
        PLAIN.replace("\n", "\r"),
        "\n \n" + PLAIN,
        "\r\n\r\n" + PLAIN.replace("\n", "\r\n"),
        PLAIN.rstrip("\n"),
        ">a b>c\nAC>GT\n>>d\nACCGT\n",
        "> spaced name\nstraße\n> x\nAC GT AA\n",
        ">only\n",
        ">a\n>b\n\n\n",
        ">",
        "",
        "\n\n",
    ],
)
def test_odd_files(spark, tmp_path, text):
    (tmp_path / "a.fasta").write_bytes(text.encode())
    for n in (3, 1 << 20):
        assert [r[1:] for r in rows(spark, tmp_path / "a.fasta", n)] == wanted(text), n


@pytest.mark.parametrize(("text", "said"), [("ACGT\n>a\nACGT\n", "starts with >"), (">a\nACGT\n>b\nACG\n", "unequal"), (">a\nACGT\n>\n", "unequal"), ("\n>a\nACGT\n>b\n\n", "unequal")])
def test_faulty_files(spark, tmp_path, text, said):
    (tmp_path / "a.fasta").write_text(text)
    for n in (4, 1 << 20):
        with pytest.raises(Exception, match=said):
            rows(spark, tmp_path / "a.fasta", n)


def test_many_files(spark, tmp_path):
    """Files keep their own places, whatever splits they are read in."""
    texts = {f"f{k}.fasta": "".join(f">t{i}\n{'ACGT' * (k + 1)}\n" for i in range(40)) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = rows(spark, tmp_path, 100)
    for name, text in texts.items():
        assert [r[1:] for r in got if r[0].endswith(name)] == wanted(text)


def test_document_sequences_without_cutting_texts(spark, tmp_path):
    """The same as letters put together again, for odd letters, empty texts and ids that several rows share or that are null."""
    from tessella.functions.alphabet import PROTEIN
    from tessella.sources import report
    from tessella.sources import tables as src

    texts = [(1, "Acdıſßﬁ \n\r x-\U0001f600k" * 9), (2, ""), (3, None), (4, "acd"), (4, "wxyzw"), (None, "aa"), (None, "ccc"), (5, "  "), (6, "b\u0000J")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    letters = src.documents_letters(spark, str(tmp_path))
    letters = letters.withColumn("residue", F.when(F.col("residue").isin(*PROTEIN), F.col("residue")).otherwise("-"))
    made = src.documents_sequences(spark, str(tmp_path))
    got = sorted(map(str, made.collect()))
    assert len(got) == 5 and got == sorted(map(str, report.sequences(letters).collect()))
