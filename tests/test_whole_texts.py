"""Text functions work on whole texts."""

from pyspark.sql import functions as F

from convoweave.functions import cleaning as C
from convoweave.functions import rendering as R


def test_texts_are_escaped_whole(spark):
    text, title = 'a "b" \\ c\n' * 100 + 'end"', "word " * 60 + "end"
    df = spark.createDataFrame([(text, title)], "text string, title string")
    yaml, clean, name = df.select(R.escape_yaml(F.col("text")), C.clean_title(F.col("title")), R.sanitize_filename(F.col("title"))).first()
    assert yaml == text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ")
    assert clean == title and 0 < len(name) <= 200


def test_fences_are_kept_whatever_the_text_holds(spark):
    text = " a  \u0000 b\n\n\n\nc ```x\n\n\n  y``` \u0000  d  \n ```z```  "
    got = spark.createDataFrame([(text,), (None,), ("",), ("  \n ",)], "t string").select(C.normalize_whitespace(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a \u0000 b\n\nc ```x\n\n\n  y``` \u0000 d\n```z```", None, "", ""]
    blank = spark.createDataFrame([("a",), (" \n\t",), ("",), (None,)], "t string").select(C.not_blank(F.col("t"))).collect()
    assert [r[0] for r in blank] == [True, False, False, False]
