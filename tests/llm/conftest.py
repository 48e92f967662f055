import random

import pytest

#: Columns of other meaning whose names the operators use inside.
CLASH = "size long, key string, n int, rep long, shard int, root string, text_crc32 string, score double, copy int, start int"


def words(rng, n):
    return " ".join(rng.choice(("the", "of", "and", "that", "Haus", "und", "einen", "el", "que", "niño", "voilà", "été", "x1", "it's", "a,b", "!!")) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.choice((1, 3, 5, 8, 20, 60, 200))) for _ in range(60)]
    near = [" ".join(w if i != 7 else "changed" for i, w in enumerate(base[k].split())) for k in range(20)]
    odd = [None, "", " ", "\n\t", "12345 67", "!!!", "A b C d", "a B c D", "日本語 のテキスト", "x" * 3000, "one\n\ntwo  three\r\nfour", "<|endoftext|> a<|endoftext|>b", "▁ ▁▁a", "\x1c \xa0   z"]
    return base + base[:10] + near + odd + [words(rng, 30_000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, (None, "en", "de", "es")[i % 4], (None, "b", "a", "ü", "c")[i % 5 if i % 3 else 1], None if t is None else len(t)) + (1, "k", 2, 3, 4, "r", "c", 0.5, 6, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASH).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
