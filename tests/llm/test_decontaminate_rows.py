"""decontaminate by rows: repeated and null ids."""

import random

from convoweave.llm import decontamination


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def test_clean_rows_stay_beside_dirty_ones_of_their_id(spark):
    item = prose(1, 30)
    clean = [(None, prose(2, 60)), (None, prose(3, 60)), (None, None), (5, prose(4, 60)), (6, prose(5, 60))]
    dirty = [(None, prose(6, 40) + " " + item), (5, item + " " + prose(7, 40)), (5, item)]
    docs = spark.createDataFrame(dirty + clean, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = [tuple(r) for r in decontamination.decontaminate(docs, bench).collect()]
    assert sorted(kept, key=repr) == sorted(clean, key=repr)
