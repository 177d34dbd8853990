"""Postings are gathered where the texts are read: what is sent and sorted follows the terms of some thousands of blocks, not the words."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions.text import blocks, terms, terms_of
from marlstone.operators.segments import Projection, split

from .test_growth import _stages

TEXTS = [
    "", "Plain words, 1,000.50 and a1_b don't 'quote' 3.x 4.", "l’été n'est pas; Ärger ß ẞ", "İstanbul'da IĞDIR ıI", "ΣΑΣ ΟΔΟΣ σας 12.5abc", "央行加息 AI 3.5%，々〇",
    "ＡＩ：加息 x² ½ ﬁn", "é combining ñ ñ", "𝔘𝔫𝔦 \U00020000 x", "a b\x1cc\xa0d​e", "ǅ ŉ Ŀ ſ Ѐѐ Ѣ", "٣٫٥ ٣.٥ 1.２", "don''t a'’b _'_ 1.2.3. ,4", "Ⅷ ⅷ ㊀ ªº µ",
]


def test_words_are_those_of_terms(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", terms("text").alias("t")).collect()
    assert [(r["text"], terms_of(r["text"])) for r in rows] == [(r["text"], r["t"]) for r in rows]


@pytest.mark.parametrize("text", ["# One\nx\n\n## Two\n" + "y " * 2000 + "\n\nz", "## PDF 第 2 页\nü 𝔘\n" + "w" * 1900, "no mark " * 700, "\n\n", "", None])
def test_split_gives_the_blocks(spark, text):
    docs = spark.createDataFrame([("a", "1", text)], "document_id string, revision_id string, text string")
    got = sorted(tuple(r)[2:] for r in split(docs).collect())
    assert got == [(k, *b) for k, b in enumerate(blocks(text or ""))]


def test_terms_are_sent_not_words(spark, tmp_path):
    """400 documents of 240 words, but 60 different ones: few rows are sent, where there are 96,000 words."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(240)), lambda k: F.concat(F.lit("word"), (k * 7 + F.col("id")) % 60)))
    empty = F.array().cast("array<string>")
    docs = spark.range(0, 400, 1, 4).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit("1").alias("revision_id"), F.lit("Head").alias("title"), empty.alias("tags"), empty.alias("tickers"), empty.alias("companies"), text.alias("text"))
    before, made = _stages(spark), Projection.create(spark, f"{tmp_path}/p")
    made.refresh(docs)
    assert 0 < max(s.shuffleWriteRecords() for k, s in _stages(spark).items() if k not in before) < 5000
    found = made.lookup(["word3"])
    assert found.count() == found.select("document_id").distinct().count() and found.agg(F.sum(F.size("positions"))).first()[0] == 400 * 4
    made.compact()
    again = made.lookup(["word3"])
    assert again.exceptAll(found).count() == 0 and found.exceptAll(again).count() == 0
