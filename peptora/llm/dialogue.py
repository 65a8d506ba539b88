"""Repair of conversation structure: a run-length DP over role and fault symbols.

The initials of a conversation's roles should read ``(s?(ua)+)?``. Edits are, by their letters:
Keep (0), Rerole to user or assistant (1), Delete (2, and the only choice for blank and duplicate
rows), Insert an empty user or assistant row (5); a truncated row that stays costs 5 more. The
cheapest edits are taken, and of these the ones whose letters come first.

A row is a symbol: its role's initial and what is wrong with it. A symbol is a 4 x 4 min-plus matrix
over what stands before it (nothing, a system row, a user row, an assistant row). Equal consecutive
symbols are one run, advanced through cached binary powers of its matrix; the choices are then
unrolled by halves of the runs, which meet the same few vectors again and again.

Conversations are cut into chunks of bounded length in one global sort, so that one of any length is
spread over tasks: matrices of chunks are multiplied in groups of bounded size, cost vectors handed
back to the chunks, each chunk unrolled by itself, and the states between chunks composed likewise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptora.llm.common import discard, materialise, ranked, table

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a chunk, and nodes of a group that are combined at once: powers of two.
CHUNK, FAN = 4096, 4096

DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
FAR = 1 << 60
#: What stands before: nothing, system, user, assistant. A user row comes next, after a user row an assistant's.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
#: What is inserted at the end, and its cost, by state.
LAST = ("", "ua", "a", "")
FINISH = tuple(INSERT * len(x) for x in LAST)
INITIALS = "sua"
OTHER, SOUND, GONE, TRUNCATED = 3, 0, 1, 2

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


@lru_cache(maxsize=None)
def moves(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what may be done with a row of this symbol, in the order of letters."""
    role, fault = divmod(symbol, 3)
    out = [("D", DELETE, state)]
    if fault != GONE:
        more = CUT * (fault == TRUNCATED)
        if role + 1 == NEXT[state] or (state, role) == (0, 0):
            out.append(("K", more, role + 1))
        out.append(("R", REROLE + more, NEXT[state]))
    return tuple(out)


@lru_cache(maxsize=None)
def step(symbol: int) -> Matrix:
    """Least cost from each state before the row to each after it, insertions before the row included."""
    out = []
    for state in range(4):
        row, at, spent = [FAR] * 4, state, 0
        for _ in range(4):
            for _, cost, to in moves(symbol, at):
                row[to] = min(row[to], spent + cost)
            at, spent = NEXT[at], spent + INSERT
        out.append(tuple(row))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def times(a: Matrix, b: Matrix) -> Matrix:
    columns = list(zip(*b))
    return tuple(tuple(min(FAR, *(x + y for x, y in zip(row, col))) for col in columns) for row in a)


@lru_cache(maxsize=None)
def binary(symbol: int, k: int) -> Matrix:
    """The 2^k-th power of a symbol's matrix."""
    return times(binary(symbol, k - 1), binary(symbol, k - 1)) if k else step(symbol)


@lru_cache(maxsize=1 << 16)
def power(symbol: int, n: int) -> Matrix:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = binary(symbol, k) if out is None else times(out, binary(symbol, k))
    return out


def before(m: Matrix, end: Vector) -> Vector:
    return tuple(min(FAR, *(x + y for x, y in zip(row, end))) for row in m)


def level(v: Vector) -> Vector:
    """Choices depend on differences of costs only."""
    low = min(v)
    return tuple(x - low for x in v)


@lru_cache(maxsize=1 << 16)
def unroll(symbol: int, n: int, state: int, end: Vector) -> tuple[tuple[str, ...], int]:
    """For each row of a run its edits, insertions before it included, and the state after the run.

    Written so that roles need no states: u and a are an inserted user or assistant row, U and A a row that gets that role, K and D as they are.
    """
    if n > 1:
        half = 1 << (n - 1).bit_length() - 1
        left, middle = unroll(symbol, n - half, state, level(before(binary(symbol, half.bit_length() - 1), end)))
        right, last = unroll(symbol, half, middle, end)
        return left + right, last
    cost, done = before(step(symbol), end), ""
    while True:
        options = {x: to for x, c, to in moves(symbol, state) if c + end[to] == cost[state]}
        if cost[NEXT[state]] + INSERT == cost[state]:
            options["I"] = NEXT[state]
        letter = min(options)
        state = options[letter]
        done += {"I": "?ua"[state - 1], "R": "?UA"[state - 1]}.get(letter, letter)
        if letter != "I":
            return (done,), state


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def chunk_matrix(symbols: bytes) -> Matrix:
    out = None
    for symbol, n in runs_of(symbols):
        out = power(symbol, n) if out is None else times(out, power(symbol, n))
    return out


def chunk_edits(symbols: bytes, end: Vector, starts: Iterable[int]) -> dict[int, tuple[list[str], int, int]]:
    """By state before the chunk: the edits at each row, the state after, and their cost."""
    runs, ends = runs_of(symbols), [end]
    for symbol, n in reversed(runs):
        ends.append(before(power(symbol, n), ends[-1]))
    ends.reverse()
    out = {}
    for start in starts:
        acts: list[str] = []
        state = start
        for k, (symbol, n) in enumerate(runs):
            got, state = unroll(symbol, n, state, level(ends[k + 1]))
            acts += got
        out[start] = acts, state, ends[0][start] - end[state]
    return out


def repair(symbols: bytes) -> tuple[list[str], int]:
    """A whole conversation at once: the edits at each row, and their cost."""
    acts, state, cost = chunk_edits(symbols, FINISH, (0,))[0]
    return [*acts[:-1], acts[-1] + LAST[state]], cost + FINISH[state]


# Spark


def filled(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    return convs.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(convs: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes ``[.!?]`` out, 3 repeats, 4 makes it a user's. Null is one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = filled(convs).withColumn("kind", kind).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def faults(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank, duplicate, truncated, or null) and n, the row's place in the sort of all rows: a written table.

    Rows are in order of conv_id, turn (null first), role, text; equal rows as they are written.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    rows = materialise(filled(convs).withColumn("no", F.monotonically_increasing_id()).withColumn("last", F.right(bare, F.lit(1))), "turns")
    first = F.min(F.struct("turn", "no")).alias("first")
    # Aggregated and written before it is joined, as one row may be repeated any number of times.
    seen = materialise(rows.where("last != ''").groupBy("conv_id", "role", "text").agg(F.count("*").alias("times"), first).where("times > 1").drop("times"), "seen")
    seen_ = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("first.no").alias("first"))
    joined = rows.join(seen_, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("no") != F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    got = ranked(joined.select("conv_id", "turn", "role", "text", "no", fault.alias("fault")), ["conv_id", "turn", "role", "text", "no"], "faults", "n").drop("no")
    discard(rows, seen)
    return got


def symbol() -> Column:
    initial = F.position(F.left("role", F.lit(1)), F.lit(INITIALS)) - 1
    role = F.when((F.col("role") == "") | (initial < 0), OTHER).otherwise(initial)
    fault = F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNull(), SOUND).otherwise(GONE)
    return (3 * role + fault).cast("int")


def chunks_of(rows: DataFrame, chunk: int) -> DataFrame:
    """conv_id, first (n of the first row), key, symbols, illegal, value: a row for each part of a conversation in a block of ``chunk`` places.

    A block's last row is also sent to the next one, to judge the pair that meets there.
    """
    bits = chunk.bit_length() - 1
    block = F.shiftright("n", bits)
    to = F.when(F.col("n").bitwiseAND(chunk - 1) == chunk - 1, F.array(block, block + 1)).otherwise(F.array(block))
    held = rows.select("conv_id", "n", symbol().alias("symbol"), F.explode(to).alias("key"))
    mine = F.shiftright(F.col("x.n"), bits) == F.col("key")
    groups = held.groupBy("conv_id", "key").agg(F.array_sort(F.collect_list(F.struct("n", "symbol"))).alias("rows"))
    own = F.filter("rows", lambda x: F.shiftright(x["n"], bits) == F.col("key"))
    groups = groups.withColumn("own", own).where("size(own) > 0").select("conv_id", F.col("own")[0]["n"].alias("first"), "key", F.col("rows.symbol").alias("all"), F.size("own").alias("size"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [bytes(x.as_py()) for x in b.column(3)]
            symbols = [x[len(x) - n :] for x, n in zip(codes, b.column(4).to_pylist())]
            illegal = [sum((p // 3, q // 3) not in ((0, 1), (1, 2), (2, 1)) for p, q in zip(x, x[1:])) for x in codes]
            value = pa.array([[c for row in chunk_matrix(x) for c in row] for x in symbols], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(symbols, pa.binary()), pa.array(illegal, pa.int64()), value], ["conv_id", "first", "key", "symbols", "illegal", "value"])

    return materialise(groups.mapInArrow(run, "conv_id long, first long, key long, symbols binary, illegal long, value array<long>"), "chunks")


Fold = Callable[[list[list[int]]], list[int]]
Spread = Callable[[list[list[int]], list[int]], list[list[int]]]


def scan(nodes: DataFrame, fold: Fold, spread: Spread, seed: list[int], fan: int) -> DataFrame:
    """first, given: what each node of a conversation (conv_id, first, key, value) gets from the others.

    ``spread`` hands what a group gets to its nodes. Groups of more than ``fan`` nodes become nodes of
    a level above, their values combined by ``fold``, and are handed what they get from there.
    """
    parts = F.array_sort(F.collect_list(F.struct("first", "value"))).alias("parts")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0

    def up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fold([p["value"] for p in x.as_py()]) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.list_(pa.int64()))], [*b.schema.names, "value"])

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, given = [], []
            for x, got in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first += [p["first"] for p in x]
                given += spread([p["value"] for p in x], got)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(given, pa.list_(pa.int64()))], ["first", "given"])

    if most <= fan:
        groups = nodes.groupBy("conv_id").agg(parts).select("parts", F.array(*map(F.lit, seed)).cast("array<long>").alias("given"))
    else:
        above = nodes.groupBy("conv_id", F.shiftright("key", fan.bit_length() - 1).alias("key")).agg(parts)
        above = materialise(above.mapInArrow(up, "conv_id long, key long, parts array<struct<first:long,value:array<long>>>, value array<long>").withColumn("first", F.col("parts")[0]["first"]), "nodes")
        groups = above.drop("value").join(scan(above.drop("parts"), fold, spread, seed, fan), "first").select("parts", "given")
    return groups.mapInArrow(down, "first long, given array<long>")


def _square(m: list[int]) -> Matrix:
    return tuple(tuple(m[4 * k : 4 * k + 4]) for k in range(4))


def _product(values: list[list[int]]) -> list[int]:
    out = _square(values[0])
    for m in values[1:]:
        out = times(out, _square(m))
    return [x for row in out for x in row]


def _ends(values: list[list[int]], end: list[int]) -> list[list[int]]:
    """Costs to go after each node, from those after the last."""
    out = [tuple(end)]
    for m in reversed(values[1:]):
        out.append(before(_square(m), out[-1]))
    return [list(v) for v in reversed(out)]


def _composed(values: list[list[int]]) -> list[int]:
    out = values[0]
    for to in values[1:]:
        out = [to[x] for x in out]
    return out


def _starts(values: list[list[int]], start: list[int]) -> list[list[int]]:
    """The state before each node, from that before the first."""
    out = [start]
    for to in values[:-1]:
        out.append([to[out[-1][0]]])
    return out


def edits(rows: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conv_id, first, acts (an entry a row, see unroll), cost, illegal for each chunk of ``faults``: a written table."""
    chunks = chunks_of(rows, chunk)
    ends = scan(chunks.select("conv_id", "first", "key", "value"), _product, _ends, list(FINISH), fan).withColumnRenamed("given", "end")
    last = chunks.groupBy("conv_id").agg(F.max("first").alias("first")).select("first", F.lit(True).alias("last"))
    joined = chunks.drop("value").join(ends, "first").join(last, "first", "left").select("conv_id", "first", "key", "symbols", "illegal", "end", "last")
    kind = pa.list_(pa.list_(pa.string()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, acts, costs = [], [], []
            for symbols, end in zip(b.column(3).to_pylist(), b.column(5).to_pylist()):
                got = chunk_edits(symbols, tuple(end), range(4))
                acts.append([got[k][0] for k in range(4)])
                to.append([got[k][1] for k in range(4)])
                costs.append([got[k][2] for k in range(4)])
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), b.column(6), pa.array(to, numbers), pa.array(acts, kind), pa.array(costs, numbers)], ["conv_id", "first", "key", "illegal", "last", "value", "acts", "costs"])

    ways = materialise(joined.mapInArrow(run, "conv_id long, first long, key long, illegal long, last boolean, value array<long>, acts array<array<string>>, costs array<long>"), "ways")
    starts = scan(ways.select("conv_id", "first", "key", "value"), _composed, _starts, [0], fan)
    start = F.col("given")[0].cast("int")
    end = F.get("value", start).cast("int")
    by_end = lambda x: F.element_at(F.array(*map(F.lit, x)), end + 1)
    acts = F.get("acts", start)
    acts = F.when(F.col("last"), F.transform(acts, lambda x, k: F.when(k == F.size(acts) - 1, F.concat(x, by_end(LAST))).otherwise(x))).otherwise(acts)
    cost = F.get("costs", start) + F.when(F.col("last"), by_end(FINISH)).otherwise(0)
    got = ways.join(starts, "first").select("conv_id", "first", acts.alias("acts"), cost.alias("cost"), "illegal")
    got = materialise(got, "edits")
    discard(chunks, ways)
    return got


def repaired_rows(rows: DataFrame, edits_: DataFrame) -> DataFrame:
    """conv_id, n, k, edit, turn, role, text: the rows that the edits leave or insert (without a turn), in order of n and k."""
    acts = edits_.select("first", F.posexplode("acts").alias("at", "act")).select((F.col("first") + F.col("at")).alias("n"), "act")
    each = rows.join(acts, "n").select("*", F.posexplode(F.split("act", "")).alias("k", "what")).where("what not in ('', 'D')")
    inserted, what = F.col("what").isin("u", "a"), F.lower("what")
    role = F.when(what == "u", ROLES[2]).when(what == "a", ROLES[3]).otherwise(F.col("role"))
    return each.select(
        "conv_id", "n", "k", F.translate("what", "uaUA", "IIRR").alias("edit"), F.when(~inserted, F.col("turn")).alias("turn"), role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text")
    )


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha: SHA-256 of the lines ``role:text``, as a stream in order. A digest can't be split, but no more than its state is held."""
    lines = repaired.select("conv_id", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"), "n", "k")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "sha"])
        for b in batches:
            for conv, line in zip(b.column(0).to_pylist(), b.column(1)):
                if sha is None or conv != of:
                    if sha is not None:
                        yield made()
                    of, sha = conv, hashlib.sha256(line.as_py())
                else:
                    sha.update(b"\n" + line.as_py())
        if sha is not None:
            yield made()

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "n", "k").mapInArrow(run, "conv_id long, sha string")


def repair_conversations(convs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The repaired rows of conv_id, turn, role, text; and for each conversation gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are in order of turn (null first), then role, then text. Null roles and texts are one space,
    so such a role can't be kept and such a text is blank. A null conv_id is a conversation of its
    own. Equal rows are duplicates of the first. A role counts by its initial, whatever follows.
    Long texts are only read for their last character and for equality. Conversations of any length
    are spread over tasks by chunks. An empty table gives none; other columns aren't read.
    """
    rows = faults(convs)
    done = edits(rows, chunk, fan)
    sum_of = lambda x: F.coalesce(F.sum(F.when(F.col("fault") == x, 1)), F.lit(0)).alias(x)
    turns = rows.groupBy("conv_id", "turn").agg(*map(sum_of, ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counts = turns.groupBy("conv_id").agg(gaps, *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    parts = F.array_sort(F.collect_list(F.struct("first", F.translate(F.array_join("acts", ""), "uaUA", "IIRR").alias("audit"))))
    plans = done.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(parts["audit"], "").alias("audit"))
    return repaired_rows(rows, done), _beside(counts, plans).drop("sha")


REPORT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "sha": "string"}


def _beside(*tables: DataFrame) -> DataFrame:
    """Tables of a row a conversation, side by side; a null conv_id meets its like."""
    rows = [t.select("conv_id", *((F.col(c) if c in t.columns else F.lit(None)).cast(kind).alias(c) for c, kind in REPORT.items())) for t in tables]
    all_ = rows[0]
    for more in rows[1:]:
        all_ = all_.union(more)
    return all_.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in REPORT))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    repaired, report = repair_conversations(damage(convs))
    got = _beside(convs.select("conv_id").distinct(), report, digests(repaired))
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c, kind in REPORT.items() if kind == "long"]
    nothing = hashlib.sha256(b"").hexdigest()
    return got.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


#: CRC-32 is a fold over the key's bytes with the table of its polynomial; costs to go are strings of a cost and the letters, so that the least string is the choice.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), keyed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS kind
  FROM src, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed WHERE kind <> 0
), placed AS (
  SELECT conv_id, turn, role, text, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER w AS i, left(role, 1) AS initial, left(lag(role) OVER w, 1) AS behind,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS again FROM placed
), rows AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM counted
), costs AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM rows
), back AS (
  SELECT c, max(i) + 1 AS i, lpad('0', 12, '0') AS e0, lpad('10', 12, '0') || 'II' AS e1, lpad('5', 12, '0') || 'I' AS e2, lpad('0', 12, '0') AS e3 FROM costs GROUP BY c
  UNION ALL
  SELECT c, i,
    least(r0, lpad((left(w2, 12)::INT + 5)::VARCHAR, 12, '0') || 'I' || substr(w2, 13)), least(r1, lpad((left(w2, 12)::INT + 5)::VARCHAR, 12, '0') || 'I' || substr(w2, 13)), w2, w3
  FROM (
    SELECT *, least(r2, lpad((left(r3, 12)::INT + 5)::VARCHAR, 12, '0') || 'I' || substr(r3, 13)) AS w2, least(r3, lpad((left(r2, 12)::INT + 5)::VARCHAR, 12, '0') || 'I' || substr(r2, 13)) AS w3
    FROM (
      SELECT x.c, x.i,
        least(lpad((left(e0, 12)::INT + 2)::VARCHAR, 12, '0') || 'D' || substr(e0, 13),
              CASE WHEN NOT gone AND initial = 's' THEN lpad((left(e1, 12)::INT + more)::VARCHAR, 12, '0') || 'K' || substr(e1, 13) END,
              CASE WHEN NOT gone AND initial = 'u' THEN lpad((left(e2, 12)::INT + more)::VARCHAR, 12, '0') || 'K' || substr(e2, 13) END,
              CASE WHEN NOT gone THEN lpad((left(e2, 12)::INT + more + 1)::VARCHAR, 12, '0') || 'R' || substr(e2, 13) END) AS r0,
        least(lpad((left(e1, 12)::INT + 2)::VARCHAR, 12, '0') || 'D' || substr(e1, 13),
              CASE WHEN NOT gone AND initial = 'u' THEN lpad((left(e2, 12)::INT + more)::VARCHAR, 12, '0') || 'K' || substr(e2, 13) END,
              CASE WHEN NOT gone THEN lpad((left(e2, 12)::INT + more + 1)::VARCHAR, 12, '0') || 'R' || substr(e2, 13) END) AS r1,
        least(lpad((left(e2, 12)::INT + 2)::VARCHAR, 12, '0') || 'D' || substr(e2, 13),
              CASE WHEN NOT gone AND initial = 'a' THEN lpad((left(e3, 12)::INT + more)::VARCHAR, 12, '0') || 'K' || substr(e3, 13) END,
              CASE WHEN NOT gone THEN lpad((left(e3, 12)::INT + more + 1)::VARCHAR, 12, '0') || 'R' || substr(e3, 13) END) AS r2,
        least(lpad((left(e3, 12)::INT + 2)::VARCHAR, 12, '0') || 'D' || substr(e3, 13),
              CASE WHEN NOT gone AND initial = 'u' THEN lpad((left(e2, 12)::INT + more)::VARCHAR, 12, '0') || 'K' || substr(e2, 13) END,
              CASE WHEN NOT gone THEN lpad((left(e2, 12)::INT + more + 1)::VARCHAR, 12, '0') || 'R' || substr(e2, 13) END) AS r3
      FROM back JOIN costs AS x ON x.c = back.c AND x.i = back.i - 1
    )
  )
), plans AS (
  SELECT c, left(e0, 12)::BIGINT AS cost, substr(e0, 13) AS audit FROM back WHERE i = 1
), letters AS (
  SELECT c, p, substr(audit, p, 1) AS letter, length(replace(left(audit, p), 'I', '')) AS i, length(replace(left(audit, p), 'D', '')) AS k FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM plans)
), made AS (
  SELECT l.c, l.p, l.k, l.letter, x.role, x.text, x.initial FROM letters AS l LEFT JOIN costs AS x ON x.c = l.c AND x.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'
), named AS (
  SELECT *, k - max(CASE WHEN k = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c) AS nth FROM made
), lines AS (
  SELECT c, p, CASE WHEN letter = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM named
), sums AS (
  SELECT c, sha256(string_agg(line, chr(10) ORDER BY p)) AS sha FROM lines GROUP BY c
), stats AS (
  SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND behind || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id, c
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN plans ON plans.c = stats.c LEFT JOIN sums ON sums.c = stats.c
"""
