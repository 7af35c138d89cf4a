"""The pipeline's near-dedup stage against brute force over five-word sets."""

import random

from near import least_ids


def test_stage_keeps_one_of_texts_at_four_fifths(spark):
    from quarry.llm.simhash import dedup_stage

    random.seed(10)
    rows, n = [], 0
    for _ in range(8):
        text = [random.choice("abcdefghijklmnop") * random.randint(1, 3) for _ in range(random.choice([6, 40, 120]))]
        for _ in range(12):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(random.choice([0, 1, 1, 2, 4])):
                text[random.randrange(len(text))] = random.choice("qrstuv") * 3
    line = "one common line of nine words in every text"
    rows += [(n + k, f"{line} " + " ".join(random.choice("abcdefgh") * 2 for _ in range(5))) for k in range(30)]
    random.shuffle(rows)
    want = least_ids(rows)
    got = dedup_stage(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {r.doc_id for r in got.collect()} == want and len(want) < len(rows)
