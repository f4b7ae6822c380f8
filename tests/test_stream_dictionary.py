"""A stream's dictionary equals the batch one whatever the order of files and restarts."""

import random

from helixframe.operators import compare, dictionary
from helixframe.schemas import PAIR
from helixframe.streaming import dictionary as sd
from helixframe.streaming.scoring import read_pair_stream


def test_any_order_and_restart(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice("ABCDEFGHIJ") * r.randint(1, 3), r.choice("ABCDEFGHIJ") * r.randint(1, 3)) for i in range(60)] + [(60, None, "A")]
    want = dictionary.sequences(spark.createDataFrame(rows, PAIR).filter("seq_a is not null"), 7)
    parts = [rows[i::4] for i in range(4)]
    r.shuffle(parts)
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for n, part in enumerate(parts):
        spark.createDataFrame(part, PAIR).coalesce(1).write.mode("append").parquet(folder)
        if n != 1:  # two files in one run, then restarts from the checkpoint
            query = sd.write_dictionary_stream(read_pair_stream(spark, folder, 1), out, mark)
            assert query.awaitTermination(120) and query.exception() is None
    assert compare.same_rows(sd.read_dictionary(spark, out, 7), want)
