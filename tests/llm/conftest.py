import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    if schema == DOCS:
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, schema)


def saved(spark, tmp_path, rows, schema=DOCS):
    """The same as files, as the operators that read their input twice need them."""
    path = str(tmp_path / f"in{random.randrange(1 << 60)}")
    make(spark, rows, schema).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def words():
    r = random.Random(8)
    pool = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(4000)]
    return lambda n, seed: random.Random(seed).choices(pool, k=n)
