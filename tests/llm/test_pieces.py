import math
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from peptora.llm import pieces

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
RNG = random.Random(2)
TEXTS = [
    None, "", " ", "a", "a" * 500, " " * 90, "日本語のテキスト、" * 30, "aaaa bbbb    cccc\n\n\t dd" * 10, "Ünïcode it's 日本語 e\u0301 \u00a0 end \U0001f600",
    "".join(RNG.choice("ab é\n!日😀") for _ in range(600)), "http://www.example.com/the/and/of/internationalization" * 5, "The cat sat on the mat, and then the dog sat on the log. " * 20,
]


@pytest.fixture(scope="module")
def bpe():
    return pieces.public_model()


@pytest.fixture(scope="module")
def unigram(bpe, tmp_path_factory):
    """The same pieces as a unigram model with log-probabilities by Zipf's law."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(bpe, "rb").read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    for k, p in enumerate(proto.pieces):
        if p.type == p.NORMAL:
            p.score = round(-math.log(k + 1) * 256) / 256
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_are_the_library_s(spark, kind, request):
    path = request.getfixturevalue(kind)
    library, m = SentencePieceProcessor(model_file=path), pieces.model(path)
    every = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + TEXTS
    every = [t for t in every if t and pieces.SPACE not in t and len(t) < 20_000]
    assert len(every) > 150
    for t, ids in zip(every, library.encode(every)):
        assert m.encode(t).tolist() == ids


@pytest.mark.parametrize("chunk, block", [(1, 5), (7, 3), (60, 2), (1000, 64)])
def test_scan_is_one_pass(spark, bpe, chunk, block):
    texts = [t[:150] if chunk == 1 else t for t in TEXTS if t]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string")
    got = {r["key"]: r["ids"] for r in pieces.scan_chunks(rows, bpe, chunk, block).collect()}
    assert got == {str(k): pieces.model(bpe).encode(t).tolist() for k, t in enumerate(texts)}


def test_scan_of_a_unigram_model_is_the_best_path(spark, unigram):
    m = pieces.model(unigram)
    texts = [t for t in TEXTS if t]
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "key string, text string")
    got = {r["key"]: r["ids"] for r in pieces.scan_chunks(rows, unigram, 60, 2).collect()}
    worth = lambda ids: sum(m.processor.get_score(k) for k in ids if not m.processor.is_byte(k))
    for k, t in enumerate(texts):
        one = m.encode(t).tolist()
        assert worth(got[str(k)]) == worth(one) and m.decode(got[str(k)]) == m.decode(one)


def test_long_and_short_merges_agree(bpe):
    m = pieces.model(bpe)
    for t in filter(None, TEXTS):
        t = pieces.escaped(t)[:400]
        assert m._merged_long(list(t)) == [x for w in [t] for x in plain_merge(m, w)]


def plain_merge(m, text):
    s = list(text)
    while True:
        found = [(m.rank[a + b], k) for k, (a, b) in enumerate(zip(s, s[1:])) if a + b in m.rank]
        if not found:
            return s
        k = min(found)[1]
        s[k : k + 2] = [s[k] + s[k + 1]]


def test_round_trip_with_any_columns(spark):
    """Null and empty texts, repeated rows, and columns that are called like the operator's own."""
    rows = [(k, t, k, "x", None) for k, t in enumerate(TEXTS)] + [(1, "", 1, "x", None), (4, "a" * 500, 4, "x", None), (None, "no id", 0, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, key string, _ string").repartition(3)
    ids = pieces.encode(docs, giant=100, chunk=64)
    assert ids.columns == ["doc_id", "row", "key", "_", "ids"]
    back = pieces.decode(ids)
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter((i, t or "", r, k, x) for i, t, r, k, x in rows)
    said = {(r["doc_id"], r["n_ids"], r["ids_crc32"], r["decoded_sha256"]) for r in pieces.encode(docs, giant=100, chunk=64, summary=True).collect()}
    assert said == {(r["doc_id"], r["n_ids"], r["ids_crc32"], r["decoded_sha256"]) for r in pieces.encode(docs, giant=10**9, summary=True).collect()}
    assert pieces.encode(docs.limit(0)).count() == 0 and pieces.decode(pieces.encode(docs.limit(0))).count() == 0
