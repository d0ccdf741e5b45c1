from __future__ import annotations

from watchlake.llm import quality

DOCUMENTS = [
    "„Wir gehen heute nicht in die Stadt.“\n„Dann bleiben wir alle eben zu Hause!“",
    "« Nous irons demain à la mer . »\n«\u00a0Tu viendras avec nous ce soir\u00a0?\u00a0»",
    "यह पहली पंक्ति बहुत अच्छी है।\nयह दूसरी पंक्ति भी बहुत अच्छी है॥",
    "هل تذهب معنا اليوم إلى السوق؟\nمتى سوف تعود إلى البيت غدا؟",
    "一 二 三 四 五 六「七 八。」\n一 三 五 七 九 十「百 千！」\u3000",
    "The first line ends with a blank.\u00a0\nThe second one ends with two of them.\u202f\u00a0",
]


def test_sentence_ends_of_any_script(spark):
    """Clean documents lose nothing; a line without an end still falls."""
    df = spark.createDataFrame(list(enumerate([*DOCUMENTS, DOCUMENTS[2] + "\nयह पंक्ति बहुत लम्बी है और"])), "doc_id int, text string")
    found = {r["doc_id"]: r["quality"] for r in quality.line_first(df).collect()}
    for i, text in enumerate(DOCUMENTS):
        assert found[i]["n_lines_removed"] == 0 and found[i]["kept"] and found[i]["text"] == text, i
    assert found[len(DOCUMENTS)]["n_lines_removed"] == 1
    assert found[len(DOCUMENTS)]["text"] == DOCUMENTS[2]


def test_sql_agrees(spark):
    """The pattern means the same to RE2."""
    import duckdb

    for line in (x for text in DOCUMENTS for x in text.split("\n")):
        assert duckdb.execute("SELECT regexp_matches(?, ?)", [line, quality.END_PUNCTUATION]).fetchone()[0], line
