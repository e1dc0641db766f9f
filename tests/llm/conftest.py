import random

import pytest

LONG = " ".join(f"word{i}" for i in range(120_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, slot string, SHARD int, size string, copies int, taken int, target int, source_size int, keep string, tail int, leaks string, secrets int, licenses int, n_sentences int, removed int, sid int, prefixes string, class_id int, text_key string, `a.b` int, __slots int, __slot_x string, __sid string, __msize int, _likely string, __scanbase int, __leakid int, __gradex int, __MKEY string, __keep int, __ int"


def row(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, 0, "s", 1, "z", 2, 3, 4, 5, "k", 6, "l", 7, 8, 9, 10, 11, "p", 12, "t", 13, 14, "x", "keepme", 15, "w", 16, 17, 18, "K", 19, 20)


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows, among columns whose names clash with results."""
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."
    same = prose(80)
    return [row(1, None), row(2, ""), row(3, "   \n\t"), row(4, "!!! ???"), row(5, LONG), row(6, same), row(6, same), row(7, same, None), row(None, prose(50)), row(None, None, None), row(None, same, None), row(8, "one"), row(9, "one", ""), row(10, prose(60)), row(None, "!!! ???"), row(11, "é ñ ß 漢字 \U0001f600 \x00 x")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


#: Columns that no operator's results are named like: they must come out as they went in.
EXTRA = {"lang": "en", "a.b": 13, "__slots": 14, "__slot_x": "x", "__sid": "keepme", "__msize": 15, "_likely": "w", "__scanbase": 16, "__leakid": 17, "__gradex": 18, "__MKEY": "K", "__keep": 19, "__": 20}


def keeps_extra_columns(rows):
    return all(r[c] == value for r in rows for c, value in EXTRA.items())


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
