import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_lzprint import plain_fingerprint

from peptora.llm import lzprint, ogg, packing, quality, simhash, substring, toxicity, urlrules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["ka", "lo", "mi", "ter", "en"]) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    words = base.split()
    out = [None, "", "  \n\t ", "a", "One two  three\tfour\x0bfive", base, base, base.replace("the", "thee", 1), prose(2, 120), prose(3, 5000), "x" * 40_000]
    out += [" ".join(prose(10 + k, 20 + k).split() + words[k * 5 : k * 5 + 90] + prose(40 + k, 30).split()) for k in range(8)]
    out += ["the " * 200, "the " * 150, "Ünïcode ▁ <|endoftext|> it's 日本語 e\u0301 \u00a0 end"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts] + [(5, texts[5][1], "en", "s", 1), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash


def naive_simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(docs, texts, empty):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    for i, t in texts:
        assert (i, f"{naive_simhash(t):016x}") in got
    assert got[(1, "0" * 16)] == 0 and got[(2, "0" * 16)] == 0  # no words: linked like any other
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("scheme,group", [("halves", simhash.GROUP), ("thirds", simhash.GROUP), ("halves", 16)])
def test_simhash_links_are_complete(spark, scheme, group):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scheme=scheme, group=group)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 4 and want[signed[a]] != want[signed[b]]:
                    low = min(want[signed[a]], want[signed[b]])
                    want[signed[a]] = want[signed[b]] = low
                    changed = True
    groups = lambda of: {frozenset(x for x in signed if of(x) == r) for r in {of(x) for x in signed}}
    assert groups(lambda x: root.get(x, x)) == groups(want.get)


def plain_simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_component_ids_end_to_end(spark, texts):
    """Whole sf0.001 and the odd texts, with null and repeated ids: fingerprints, links and smallest ids by their definitions."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(100_000 + i, t) for i, t in texts] + [(None, rows[3][1]), (7, rows[90][1]), (5, rows[5][1])]
    rng = random.Random(4)
    for k in range(30):  # chains of light edits
        words = rows[k + 40][1].split()
        for j in range(3):
            words[rng.randrange(len(words))] = "edited"
            rows.append((200_000 + 10 * k + j, " ".join(words)))
    fps = [plain_simhash(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}
    find = lambda f: f if root[f] == f else find(root[f])
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    want = Counter((i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, fps))
    for scheme in ("halves", "thirds"):
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scheme=scheme).collect()
        assert Counter(map(tuple, got)) == want
    assert len(set(least.values())) < len(distinct)


def test_large_anchor_group():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    near = fps[:50] ^ np.uint64(0b1011)
    every = np.unique(np.concatenate([fps, near]))
    a, b = simhash.link_groups(np.zeros(len(every), np.int64), every, 4)
    assert len(a) == len(b) == 50


# Quality and toxicity


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        toxic = i % 5 == 0
        t = prose(i, 40) + (" !!! " + "%%% " * 6 if bad else "") + (f" {['stinker', 'rotter', 'stinkhead'][i % 3]} indeed" if toxic else "")
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator,column,modulus,held", [(quality.score_documents, "quality", 4, 2), (toxicity.score_documents, "toxic", 5, 0)])
def test_classifiers_hold_out(spark, empty, operator, column, modulus, held):
    rows, labels = labelled(spark)
    extra = spark.createDataFrame([(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, "text", None, None, None), (3, "again", "en", "s", 5)], SCHEMA)
    got = operator(rows.union(extra).withColumn("score", F.lit("clash")), labels).collect()
    assert len(got) == 404
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    kept = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["text"] != "again" and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in kept]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert operator(empty, labels).count() == 0
    assert operator(rows, labels.where("doc_id < 0")).where(F.col("score").isNull()).count() == 0


def test_held_labels_are_not_learnt(spark):
    rows, labels = labelled(spark, 120)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    flipped = labels.withColumn("quality", F.when(fold == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: {r["doc_id"]: r["score"] for r in quality.score_documents(rows, l).collect()}
    assert score(labels) == score(flipped)


# Ogg


def naive_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c >> 31 else c << 1
    return c


def test_ogg_round_trip(docs, texts, empty):
    got = {r["doc_id"]: r for r in ogg.media_features(ogg.ogg_column(docs)).collect()}
    for i, t in texts:
        body = (t or "").encode()
        payload = body + b" " * (-len(body) % 192 if body else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["bad_pages"] == 0 and r["seconds"] == len(payload) / ogg.RATE
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    assert ogg.media_features(ogg.ogg_column(empty)).count() == 0


def test_ogg_pages_checksums_and_losses():
    assert ogg.page_crc(b"some page") == naive_crc(b"some page")
    packets = [(b"head", 0), (b"", 1), (b"x" * 255, 2), (b"y" * 70_000, 3), (b"z" * 510, 4)]
    data = b"".join(ogg.pages_of(packets, 9))
    s = ogg.read_ogg(data)["streams"][9]
    assert s["packets"] == [p for p, _ in packets] and s["pages"] == 3 and s["ended"]
    broken = bytearray(data)
    broken[40_000] ^= 1
    found = ogg.read_ogg(bytes(broken))
    assert found["bad_pages"] == 1 and b"y" * 70_000 not in found["streams"][9]["packets"] and found["streams"][9]["packets"][-1] == b"z" * 510
    assert ogg.read_ogg(b"no ogg at all")["streams"] == {}


def test_ogg_packet_rows(spark):
    media = spark.createDataFrame([(1, bytearray(ogg.write_ogg(b"q" * 2000))), (2, None), (3, bytearray(b"junk"))], "doc_id long, media binary")
    rows = ogg.packet_rows(media).collect()
    assert {(r["doc_id"], r["serial"]) for r in rows} == {(1, 1), (1, 2)} and sum(len(r["bytes"]) for r in rows if r["serial"] == 1 and r["packet"] > 0) == 2112
    assert {r["doc_id"]: r["n_bytes"] for r in ogg.media_features(media).collect()} == {1: 2000, 2: None, 3: None}


# Packing


def test_plan_is_best_fit():
    rng = random.Random(3)
    counts = Counter(rng.choice([rng.randint(1, 2048), 700, 2048]) for _ in range(3000))
    bins, free = 0, []
    for length in sorted(counts.elements(), reverse=True):  # one by one
        at = min((r for r in free if r >= length), default=None)
        if at is None:
            bins += 1
            at = 2048
        else:
            free.remove(at)
        free.append(at - length)
    plan = packing.plan_slots(dict(counts))
    made, used = 0, {}
    for length, first, last, seq, place, each in plan:
        for rank in range(first, last):
            k = rank - first
            used.setdefault(seq + k // each, []).append((place + k % each * length, length))
    assert sum(map(len, used.values())) == 3000 and len(used) == bins
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_ids_and_slots(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    rows = packing.pack_documents(docs).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, t in [*texts, (None, "no id")]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[i, at // 2048] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert got == want and len(rows) == len(want) + 1  # doc 5 stands twice
    spots = {}
    for r in rows:
        spots.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spots.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    assert packing.pack_documents(empty).count() == 0
    # Parts of two pieces give each piece a place of its own too, in as many sequences.
    found = docs.sparkSession.createDataFrame([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], "doc_id long, piece int, start long, length int, ids_crc32 long").cache()
    again = packing.pack(found, share=2).collect()
    assert len({r["sequence_id"] for r in again}) == len(spots) and len({(r["sequence_id"], r["offset"]) for r in again}) == len(rows)
    assert packing.pieces(docs.where("doc_id = 3"), with_ids=True).first()["ids"][-1] == 0


def test_other_tokenizers_get_whole_texts():
    """A byte-level vocabulary keeps case and white space: nothing of the word by word way holds for it."""
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing.WordEncoder(path)
    assert not encoder.by_word and packing.WordEncoder(packing.public_vocabulary()).by_word
    for t in ("The CAT  sat,\n\non it's mat", "", "x" * 300):
        want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t.encode()).tolist() == want and next(encoder.encode_all([t.encode()])).tolist() == want


@pytest.mark.parametrize("name", ["rest", "body", "_body", "spans", "_spans", "stack", "best", "_best", "c0", "n", "removed_", "label", "key"])
def test_columns_of_any_name_stay(spark, name):
    docs = spark.createDataFrame([(k, prose(k, 30), f"v{k}") for k in range(20)], f"doc_id long, text string, `{name}` string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(f"http://a.net/{k}", f"v{k}") for k in range(3)], f"url string, `{name}` string")
    want = sorted(f"v{k}" for k in range(20))
    for got in (quality.score_documents(docs, labels), toxicity.score_documents(docs, labels), substring.remove_repeats(docs)):
        assert sorted(r[name] for r in got.collect()) == want
    got = urlrules.judge_urls(pages, urlrules.rule_table(spark))
    assert got.columns == ["url", name, "host", "path", "rule", "verdict"] and sorted(r[name] for r in got.collect()) == ["v0", "v1", "v2"]


# Fingerprints


@pytest.mark.parametrize("parts", [1, 3])
def test_lempel_ziv(docs, texts, empty, parts):
    rows = lzprint.compare_neighbours(docs.where("text != 'no id'").dropDuplicates(["doc_id"]).union(docs.where("text is null")), parts).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    sign = lambda t: plain_fingerprint(t).astype(">u2")
    for k, (i, t) in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["fingerprint"] == sign(t).tobytes().hex() and got[i]["edited_fingerprint"] == sign(edited).tobytes().hex()
        assert got[i]["near_next"] == lzprint.likeness(sign(t), sign(after))
    assert lzprint.compare_neighbours(empty, parts).count() == 0
    assert lzprint.compare_neighbours(docs.where("doc_id = 8"), parts).first()["near_next"] == 1.0


# Substring removal


def naive_removal(texts, window):
    first, out = {}, {}
    for i, t in texts:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


@pytest.mark.parametrize("window", [50, 12, 3])
def test_substring_removal(docs, texts, empty, window):
    got = substring.remove_repeats(docs.withColumn("kept", F.lit(1)), window).collect()
    want = naive_removal(texts, window)
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], sum(x["last"] - x["first"] for x in r["removed"]), r["kept"]) == want[r["doc_id"]]
    assert any(n for _, n, _ in want.values())
    assert substring.remove_repeats(empty, window).count() == 0


@pytest.mark.parametrize("line", ["Is onhe. ", "the ", prose(5, 30) + " "])
def test_a_line_said_over_and_over_is_a_stretch(spark, line):
    said = [prose(50 + k, 20) + " " + line * 300 + prose(70 + k, 20) + " " + line * (40 + k) for k in range(12)]
    texts = list(enumerate([*said, prose(90, 100), *said[:2]]))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = naive_removal(texts, 50)
    for r in substring.remove_repeats(docs).collect():
        assert (r["n_words"], sum(x["last"] - x["first"] for x in r["removed"]), r["kept"]) == want[r["doc_id"]]
    places = sum(max(0, n - 49) for n, _, _ in want.values())
    assert substring.repeated_spans(docs).count() < places / 4


def test_stretches_cover_the_places_of_their_windows():
    rng = np.random.default_rng(4)
    for _ in range(200):
        at = np.unique(rng.integers(0, 300, rng.integers(1, 120)))
        one, two = rng.integers(0, 3, (2, len(at))).astype(np.uint64)
        window = int(rng.integers(1, 30))
        want, got = {}, {}
        for a, x, y in zip(at, one, two):
            want.setdefault((x, y), set()).update(range(a, a + window))
        for first, last, x, y in zip(*substring.stretches(at, one, two, window)):
            assert not got.setdefault((x, y), set()) & set(range(first, last))
            got[x, y].update(range(first, last))
        assert got == want


# URL rules


def test_url_rules(spark):
    rules = [("net", "/"), ("example.net", "/en/"), ("a.example.net", "/en/x"), ("org", "/fr/"), ("com", ""), ("b.com", "/q")]
    rng = random.Random(2)
    hosts = ["net", "example.net", "EXAMPLE.net", "a.example.net", "z.a.example.net", "badexample.net", "org", "x.org", "com", "b.com", "ab.com", "example.net:80", "", "..net", "net."]
    urls = [None, "", "no scheme", "://", "x://net", "http://net?q=/", "http://net#/"] + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/xy', '/fr/', '/q'])}{rng.choice(['', '?a=/en/', '#f'])}" for _ in range(150)]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame([(h, p, "block") for h, p in rules] + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")

    def naive(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), len(h), h + p) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[2] if fits else None, "block" if fits else "allow")

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, table, share=3).collect()}
    assert got == {k: naive(u) for k, u in enumerate(urls)}
    assert urlrules.judge_urls(pages.limit(0), table).count() == 0
    assert urlrules.judge_urls(pages, table.limit(0)).where("verdict != 'allow'").count() == 0
    plan = urlrules.judge_urls(pages, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
