"""Small tables with everything that real ones throw at an operator."""

from __future__ import annotations

import random

WORDS = "the of and river stone cold bright under green walk seven house letter open slow night".split()


def prose(seed: int, n: int) -> str:
    random_ = random.Random(seed)
    return " ".join(random_.choice(WORDS) + str(random_.randrange(40)) for _ in range(n))


LONG = prose(99, 6000)
BASE = prose(1, 120)
PASSAGE = prose(2, 60)
TEXTS: list[tuple[int | None, str | None]] = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("river", "Stone", 1)),
    (4, ""),
    (5, None),
    (6, "  \t \n "),
    (7, "one"),
    (8, "one two"),
    (9, prose(3, 50) + " " + PASSAGE + " " + prose(4, 30)),
    (10, PASSAGE + " " + prose(5, 40)),
    (11, LONG),
    (11, LONG),
    (None, prose(6, 30)),
    (None, None),
    (12, prose(7, 35)),
    (13, "naïve élan ▁ 日本 \U0001f600 " + prose(8, 20)),
    (14, PASSAGE + "\n" + PASSAGE),
]


def docs(spark, rows=TEXTS):
    """Documents, with columns whose names an operator may want for itself."""
    full = [(i, t, "en", "src0", len(t or ""), 0.5, 7) for i, t in rows]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score DOUBLE, component_id INT"
    return spark.createDataFrame(full, schema)
