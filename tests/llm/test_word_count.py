import re

from ledgerline.llm.common import word_count


def test_words_are_counted_without_an_array_of_them(spark):
    texts = [None, "", " ", "a", "\x0b\x0c\r\n\t ", " é\xa0日本 ww\x0bw😀 x\x85y z $1 \\", "w w  ww\n" * 50, "\x1f\x1c a\x00b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", word_count("text").alias("n"))
    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert "extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
