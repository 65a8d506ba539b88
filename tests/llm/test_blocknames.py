import hashlib
import random
import re

import pytest

from peptora.llm import blocknames
from peptora.llm.common import ranked

SCHEMA = "doc_id long, text string, name string, row string, kept int, `odd name` struct<`a b`: int>"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def rows_of(texts):
    return [(i, t, "n", "r", 7, (1,)) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("ab ä\n日") for _ in range(n))
    base = [make(n) for n in (1, 3, 4, 5, 8, 9, 16, 17, 40, 41, 300)]
    out = [None, "", " \t\n\x0b\x0c\r", " ", *base, *base, *(" ".join(t) for t in base), base[-1] + "a", base[-1][:-9], "x" * 5000, "x" * 5000 + " ", "x" * 5001, *["hot text"] * 40]
    rng.shuffle(out)
    out = list(enumerate(out))
    return [*out, (None, "hot text"), (3, "hot  text"), (3, "hot  text"), out[4], out[4]]


def plain(texts):
    """doc_id, keep_id, size, kept, digest of each row, sorted."""
    groups = {}
    for i, t in texts:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for bare, rows in groups.items():
        rows.sort()
        out += [(i, rows[0][3], len(rows), k == 0, hashlib.sha256(bare.encode()).hexdigest()) for k, (_, _, _, i) in enumerate(rows)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "bits"), [(4, 64), (8, 5), (1024, 64)])
def test_groups_are_those_of_equal_texts(spark, texts, size, bits):
    few = texts if bits == 64 else [x for x in texts if len(x[1] or "") < 20]
    docs = spark.createDataFrame(rows_of(few), SCHEMA).repartition(3)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["sha"].hex()) for r in blocknames.exact_groups(docs, size=size, bits=bits).collect()]
    assert sorted(got, key=str) == plain(few)


def test_equal_hashes_of_different_blocks_are_told_apart(spark):
    docs = spark.createDataFrame(rows_of(enumerate("abcdefghij" * 2)), SCHEMA)
    assert blocknames.shared_blocks(docs, 4, 0, 2).where("forms > 1").count()
    assert {r["group_size"] for r in blocknames.exact_groups(docs, size=4, bits=4).collect()} == {2}


def test_copies_go_with_all_columns_kept(spark, texts):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(2)
    got = blocknames.drop_copies(docs, 4)
    assert got.schema == docs.schema
    rows = got.collect()
    assert {r["odd name"]["a b"] for r in rows} == {1}
    assert len(rows) == len({SPACE.sub("", t or "") for _, t in texts}) == len({SPACE.sub("", r["text"] or "") for r in rows})
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(x[0]) for x in plain(texts) if x[3])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert not blocknames.exact_groups(docs).collect()
    assert not blocknames.drop_copies(docs).collect()


def test_ranks_are_dense_and_in_order(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("1000 - id as x", "id % 3 as y").repartition(5)
    got = [(r["x"], r["n"]) for r in ranked(df, ["x"], "ranked", "n").collect()]
    assert sorted(got) == [(k + 1, k) for k in range(1000)]
