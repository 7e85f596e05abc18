"""TextGrid tiers by plain searches against the regular expression that they stand for, and how often files are read."""

import random
import re

from colloquy.sources import textgrid

TIER = re.compile(r'name = "words"(.*?)(?:[^\n]*name = "phones"|\Z)', re.S)


def test_tiers_are_those_of_the_expression(spark):
    rng = random.Random(4)
    parts = ['name = "words"', 'name = "phones"', "\n", "\n", "    item [2]:", "intervals [1]:", "é", " x", "name = ", '"words"']
    values = ["", 'name = "words"', *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300))]
    found = spark.createDataFrame([(v,) for v in values], "value string").select("value", textgrid._words_tier("value").alias("tier")).collect()
    assert all(r["tier"] == (m.group(1) if (m := TIER.search(r["value"])) else "") for r in found) and len(found) == len(values)


def test_fallback_words_scan_files_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    one = lambda k: f'        intervals [{k}]:\n            xmin = {k}.0\n            xmax = {k}.5\n            text = "w{k}"\n'
    files = spark.createDataFrame([("a", 'name = "words"\n' + one(1) + one(2)), ("b", "none")], "path string, value string")
    said = spark.createDataFrame([("a", 0, "W1"), ("a", 1, "W2"), ("b", 0, "X")], "path string, word_idx long, text string")
    out = textgrid.fallback_words(files.mapInArrow(seen, files.schema), said, 10.0)
    assert sorted(map(tuple, out.collect())) == [("a", 0, "W1", 11.0, 11.5), ("a", 1, "W2", 12.0, 12.5), ("b", 0, "X", 10.0, 10.5)]
    assert read.value == 4  # for the scan and for the paths with a tier; once 6
