import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("v", T.StringType()),
    T.StructField("comp", T.DoubleType()), T.StructField("a.b", T.StringType()),
])
SYLLABLES = {
    "xx": "the and of ing ter ion ha re on st wh".split(), "yy": "qua lor ipsu dol amet zu vi pos cor ela nim".split(),
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every odd case: nulls in every column, empty, blank and long texts, repeated rows, an id with
    two texts, near copies, and lines that many documents share."""
    rng = random.Random(5)
    out = []
    shared = "This line stands in very many of the documents, as boilerplate does"
    for i in range(120):
        lang = "xx" if i % 3 else "yy"
        text = "\n".join(prose(rng, lang, rng.randint(5, 30)).capitalize() + "." for _ in range(rng.randint(1, 5)))
        if i % 4 == 0:
            text += f"\n  \t{shared.upper() if i % 8 else shared} \r\nshort line"
        out.append((i, text, lang, f"src{i % 2}", i, None, float(i), "x"))
    base = prose(rng, "xx", 90).split()
    for i in range(200, 230):  # near copies, some just below the threshold
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = prose(rng, "xx", 1)
        out.append((i, " ".join(words), "xx", "src0", None, "c", None, None))
    out += [
        (300, None, None, None, None, None, None, None), (301, "", "xx", None, 1, "", 0.0, ""), (302, " \n\t\n ", "yy", "src1", 1, "", 0.0, ""),
        (303, "one two", "xx", "src1", 1, "", 0.0, ""), (304, "One  TWO", "xx", "src1", 1, "", 0.0, ""), (305, "12 34 !!", "xx", "s", 1, "", 0.0, ""),
        (306, prose(rng, "yy", 20000), "yy", "src1", 1, "", 0.0, ""), (307, "same " * 400, "yy", "src1", 1, "", 0.0, ""),
        (None, shared + "\nno id here", "xx", "src0", 1, "", 0.0, ""), (308, "x" * 3000 + " Σς ÀÉ é <|endoftext|>" + shared, "xx", "s", 1, "", 0.0, ""),
    ]
    out += [out[0], out[0], out[4]]  # repeated rows
    out.append((7, out[8][1], "xx", "src0", 1, "", 0.0, ""))  # one id, two texts
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
