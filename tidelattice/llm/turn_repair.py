"""Cheapest repair of conversation structure, by Four-Russians block tables.

A conversation is wanted as `(s?(ua)+)?` in role initials: an optional system turn,
then pairs of user and assistant. Each row is kept (0), given the role user or
assistant (3) or deleted (4; a must for blank and repeated rows); rows without text
may be inserted anywhere (3). A truncated row that stays adds 3. Of the cheapest
repairs the one whose edit initials (D, I, K, R) are least in ASCII is taken.

The repair is a shortest path over four states, read from the end: cost-to-go
vectors. A row is one of ten symbols, and normalised (least entry 0) only few vectors
occur, so the step of every block of BLOCK symbols from every vector is tabulated
once: block and vector give the vector before the block and the cost. A trace goes
forward; each block is expanded backward from the vector behind it, which makes every
choice among ties exact.

Rows travel slim (ids, role, a 128-bit digest of the text, a symbol), sorted in ranges
that may split a conversation, so that a hot conversation is many tasks. A piece of a
conversation is a map from the vector behind it to the vector, cost and exits before
it; pieces compose along the partitions (at most two per partition reach the driver).
Texts move once, when repaired rows or digests are asked for.

Defined results: a null role or text is one space; a null turn sorts first; rows of
equal turn are ordered by role, then by the MD5 of the text (equal rows are copies,
the later ones repeated); a null id is a conversation of its own; other columns are
left alone; long texts are only hashed and streamed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_light, keep

# Costs of the edits and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Symbols: a row that must go, a whole row of role s, u, a or another, a truncated one; none.
MUST_GO, WHOLE, CUT, NONE = 0, 1, 5, 9
SYMBOLS, BLOCK = 10, 3
# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ACCEPTED = 0, (0, 3)
FAR = 1 << 40
NAMES = {"u": "user", "a": "assistant"}
# Turns of one bucket when first occurrences are looked for.
TURNS = 1024


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when rows may also be inserted first."""
    best = list(costs)
    for _ in range(3):
        for q, after in enumerate(NEXT):
            for role, to in after.items():
                if role != "s":
                    best[q] = min(best[q], INSERT + best[to])
    return tuple(best)


def _options(symbol: int, q: int) -> list[tuple[str, str, int, int]]:
    """Edits of a row in state `q`: (initial, role given, cost, next state), by initial."""
    if symbol == MUST_GO:
        return [("D", "", DELETE, q)]
    role = "sua?"[(symbol - WHOLE) % 4]
    extra = TRUNCATED if symbol >= CUT else 0
    found = [("D", "", DELETE, q)]
    if role in NEXT[q]:
        found.append(("K", "", extra, NEXT[q][role]))
    found.extend(("R", r, REROLE + extra, to) for r, to in NEXT[q].items() if r != "s")
    return found


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost-to-go before a row from the costs after it."""
    if symbol == NONE:
        return after
    return _closed([min(cost + after[to] for _, _, cost, to in _options(symbol, q)) for q in range(4)])


def _norm(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs), least


class Tables:
    """Transitions of all normalised vectors over all blocks."""

    def __init__(self) -> None:
        end, base = _norm(_closed([0 if q in ACCEPTED else FAR for q in range(4)]))
        assert base == 0
        self.vectors = [end]
        place = {end: 0}
        step: list[list[tuple[int, int]]] = []
        while len(step) < len(self.vectors):  # close the set of vectors under single symbols
            row = []
            for symbol in range(SYMBOLS):
                vector, cost = _norm(_before(symbol, self.vectors[len(step)]))
                if vector not in place:
                    place[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((place[vector], cost))
            step.append(row)
        # (block, vector behind) -> vector before and cost, for every block of BLOCK symbols.
        self.to = np.zeros((SYMBOLS**BLOCK, len(step)), np.int64)
        self.cost = np.zeros_like(self.to)
        for block, symbols in enumerate(product(range(SYMBOLS), repeat=BLOCK)):
            for v in range(len(step)):
                at, total = v, 0
                for symbol in reversed(symbols):
                    at, cost = step[at][symbol]
                    total += cost
                self.to[block, v], self.cost[block, v] = at, total
        self.fast_to, self.fast_cost = self.to.tolist(), self.cost.tolist()
        self._step = step
        self._traces: dict[tuple[int, int], list[tuple[list[str], int]]] = {}

    def trace(self, block: int, behind: int) -> list[tuple[list[str], int]]:
        """Per entry state: edits of each row of the block, and the exit state.

        The block is expanded backward from the vector behind it. A row's edits are
        the insertions before it and its own.
        """
        found = self._traces.get((block, behind))
        if found is None:
            symbols = [block // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
            ids = [behind]
            for symbol in reversed(symbols):
                ids.append(self._step[ids[-1]][symbol][0])
            afters = [self.vectors[i] for i in reversed(ids[:-1])]
            found = []
            for q in range(4):
                edits = []
                for symbol, after in zip(symbols, afters, strict=True):
                    if symbol == NONE:
                        edits.append("")
                        continue
                    edit, q = _choose(symbol, after, q)
                    edits.append(edit)
                found.append((edits, q))
            self._traces[block, behind] = found
        return found


def _choose(symbol: int, after: tuple[int, ...], q: int) -> tuple[str, int]:
    """Least edits of one row among the cheapest, and the state after it."""
    before, edits = _before(symbol, after), ""
    while True:
        ways = [(i + r, cost + after[to], to) for i, r, cost, to in _options(symbol, q)]
        ways += [("I" + r, INSERT + before[to], to) for r, to in NEXT[q].items() if r != "s"]
        edit, _, q = min(w for w in ways if w[1] == before[q])
        edits += edit
        if edit[0] != "I":
            return edits, q


def closing(q: int) -> str:
    """Insertions after the last row."""
    edits = ""
    while q not in ACCEPTED:
        role, q = next((r, to) for r, to in NEXT[q].items() if r != "s")
        edits += "I" + role
    return edits


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: np.ndarray) -> list[int]:
    """Block numbers of a row of symbols; the last block is filled with NONE."""
    padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NONE, np.int64)
    padded[: len(symbols)] = symbols
    return (padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()


def behind_blocks(blocks: list[int], vector: int) -> tuple[list[int], int, int]:
    """Vector behind each block by table lookup; then the vector and cost before all."""
    t = tables()
    behind, total = [0] * len(blocks), 0
    for i in range(len(blocks) - 1, -1, -1):
        behind[i] = vector
        total += t.fast_cost[blocks[i]][vector]
        vector = t.fast_to[blocks[i]][vector]
    return behind, vector, total


def traced(blocks: list[int], behind: list[int], q: int) -> tuple[list[str], int]:
    t, edits = tables(), []
    for block, v in zip(blocks, behind, strict=True):
        found, q = t.trace(block, v)[q]
        edits += found
    return edits, q


def piece_map(symbols: np.ndarray) -> np.ndarray:
    """A piece as a map: per vector behind it, the vector before it and the exit of each entry state."""
    blocks = blocks_of(symbols)
    rows = []
    for v in range(len(tables().vectors)):
        behind, before, _ = behind_blocks(blocks, v)
        rows.append([before, *(_exit(blocks, behind, q) for q in range(4))])
    return np.array(rows, np.int8)


def _exit(blocks: list[int], behind: list[int], q: int) -> int:
    t = tables()
    for block, v in zip(blocks, behind, strict=True):
        q = t.trace(block, v)[q][1]
    return q


def place_pieces(maps: list[np.ndarray]) -> list[tuple[int, int]]:
    """(vector behind, entry state) of consecutive pieces of one conversation."""
    vector, behind = 0, []
    for m in reversed(maps):
        behind.append(vector)
        vector = int(m[vector, 0])
    behind.reverse()
    q, entries = START, []
    for m, v in zip(maps, behind, strict=True):
        entries.append((v, q))
        q = int(m[v, 1 + q])
    return entries


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) after a damage that the CRC-32 of `id:turn` decides.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes `.!?` out of it, 3
    repeats it (`copies` is 2), 4 makes its role user.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        _space(role).alias("role"),
        _space(text).alias("text"),
        (F.crc32(F.concat(_space(conv_id), F.lit(":"), _space(turn)).cast("binary")) % 20).alias("turned"),
    )
    return rows.where("turned != 0").select(
        "conv",
        "turn",
        F.when(F.col("turned") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("turned") == 1, "").when(F.col("turned") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("turned") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def marked(rows: DataFrame) -> DataFrame:
    """Slim rows (conv, turn, role, k, copies, fault): one per different row, with the first fault of its first copy.

    Faults: blank, duplicate, truncated or empty. First occurrences are found per
    bucket of turns, then over the buckets, so a text that fills a hot conversation is
    many small groups.
    """
    slim = rows.select(
        "conv",
        "turn",
        "role",
        _digest().alias("k"),
        "copies",
        F.when(~F.col("text").rlike(WORD), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("").alias("fault"),
    )
    slim = slim.groupBy("conv", "turn", "role", "k", "fault").agg(F.sum("copies").alias("copies"))
    slim = keep(slim.withColumn("b", F.floor(F.col("turn") / TURNS).cast("long")))
    keys = ("conv", "role", "k")
    # Null turns come first: a flag keeps them below every number.
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    per_bucket = slim.groupBy(*keys, "b").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    over = per_bucket.groupBy(*keys).agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    firsts = per_bucket.select(*keys, "b").alias("p").join(over.alias("o"), [F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keys])
    firsts = keep(firsts.select(*[F.col(f"p.{c}").alias(c) for c in (*keys, "b")], "first"))
    light = broadcast_if_light(firsts, F.lit(80) + F.length("role"))
    joined = slim.alias("s").join(light.alias("f"), [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, "b")], "left")
    here = F.struct(F.col("s.turn").isNotNull().alias("known"), F.col("s.turn"))
    fault = F.when(F.col("s.fault") == "blank", "blank").when(F.col("first") < here, "duplicate").otherwise(F.col("s.fault"))
    return joined.select("s.conv", "s.turn", "s.role", "s.k", "s.copies", fault.alias("fault"))


def _symbol() -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT + role).otherwise(WHOLE + role)


def _runs(conv: pa.Array) -> list[tuple[int, int]]:
    """Start and end of equal neighbours."""
    n = len(conv)
    if n == 0:
        return []
    codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one conversation each, from rows sorted by conversation."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        column = batch.schema.get_field_index("conv")
        for a, b in _runs(batch.column(column)):
            part = batch.slice(a, b - a)
            if held and held[-1].column(column)[0].as_py() != part.column(column)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def repair(rows: DataFrame) -> DataFrame:
    """Edits of `rows` (conv, turn, role, text, copies): one row per different row.

    Returns conv, turn, role, k (MD5 of the text), copies, fault, and edits: of the
    first copy, the insertions before it and its own edit, then deletions of its
    further copies; after the last row of a conversation also its closing insertions.
    R and I are followed by the initial of the role they give.
    """
    order = ["conv", "turn", "role", "k"]
    spark = rows.sparkSession
    slim = marked(rows).withColumn("symbol", _symbol().cast("int"))
    parts = keep(slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    conv_type = parts.schema["conv"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for table in _conversations(b.select(["part", "conv", "symbol"]) for b in batches):
            last = table
            if first is None:
                first = table
        for i, table in enumerate([t for t in (first, last) if t is not None][: 1 if first is last else 2]):
            m = piece_map(table["symbol"].to_numpy())
            one = table.slice(0, 1).select(["part", "conv"]).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [one["part"].chunk(0), pa.array([i], pa.int32()), one["conv"].chunk(0), pa.array([m.tobytes()], pa.binary())], ["part", "which", "conv", "map"]
            )

    ends = keep(parts.mapInArrow(pieces, f"part int, which int, conv {conv_type}, map binary"))
    split = ends.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crossing = ends.alias("e").join(split.alias("p"), F.col("e.conv").eqNullSafe(F.col("p.conv")), "left_semi").orderBy("conv", "part", "which")
    # At most two rows a partition: the driver chains the pieces of split conversations.
    chains: list[list] = []
    for row in crossing.collect():
        if not chains or chains[-1][-1]["conv"] != row["conv"]:
            chains.append([])
        chains[-1].append(row)
    at: dict[tuple[int, int], tuple[int, int, bool]] = {}
    for chain in chains:
        maps = [np.frombuffer(r["map"], np.int8).reshape(-1, 5) for r in chain]
        for i, (r, (vector, q)) in enumerate(zip(chain, place_pieces(maps), strict=True)):
            at[r["part"], r["which"]] = vector, q, i == len(chain) - 1
    where = spark.sparkContext.broadcast(at)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        n = 0
        conversations = _conversations(batches)
        table, first = next(conversations, None), True
        while table is not None:
            following = next(conversations, None)
            part = table["part"][0].as_py()
            # A partition of one conversation has one piece, which counts as its first.
            which = 0 if first else 1 if following is None else -1
            vector, q, ends_here = where.value.get((part, which), (0, START, True))
            blocks = blocks_of(table["symbol"].to_numpy())
            behind, _, _ = behind_blocks(blocks, vector)
            edits, q = traced(blocks, behind, q)
            edits = edits[: len(table)]
            for i, copies in enumerate(table["copies"].to_pylist()):
                if copies > 1:
                    edits[i] += "D" * (copies - 1)
            if ends_here:
                edits[-1] += closing(q)
            out.append(table.drop_columns(["part", "symbol"]).append_column("edits", pa.array(edits, pa.string())))
            n += len(table)
            if n >= 8192:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, n = [], 0
            table, first = following, False
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.drop("symbol").schema) + ", edits string"
    return parts.mapInArrow(edit, schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Repaired conversations as rows (conv, turn, role, k, place, new_role, new_text, edit).

    Rows of a conversation are in the order of (turn, role, k, place); inserted rows
    have no text and stand beside the row they were inserted at.
    """
    texts = rows.select("conv", "turn", "role", _digest().alias("k"), "text").groupBy("conv", "turn", "role", "k").agg(F.min("text").alias("text"))
    keys = ("conv", "turn", "role", "k")
    both = edits.alias("e").join(texts.alias("t"), [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in keys])
    steps = both.select(*[F.col(f"e.{c}") for c in keys], "text", F.posexplode(F.regexp_extract_all("edits", F.lit("([DKRI][ua]?)"), F.lit(1))).alias("place", "edit"))
    steps = steps.where("edit != 'D'")
    given = F.when(F.col("edit").endswith("u"), NAMES["u"]).when(F.col("edit").endswith("a"), NAMES["a"]).otherwise(F.col("role"))
    return steps.select(*keys, "place", given.alias("new_role"), F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text")).alias("new_text"), "edit")


LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Digest:
    """Counts, audit and hash of one conversation, fed row by row."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.last_turn = self.last = self.rest = None
        self.audit = bytearray()
        self.hash, self.any = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(f"{role}:{text}".encode())

    def row(self, turn: int | None, role: str, copies: int, fault: str, edits: str) -> None:
        if turn is not None:
            self.turns += self.last_turn != turn
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
        initial = role[:1]
        self.illegal += self.last is not None and (self.last, initial) not in LEGAL
        again = copies - 1
        self.illegal += again
        self.last = initial
        self.blank += copies if fault == "blank" else 0
        self.duplicate += copies if fault == "duplicate" else 0 if fault == "blank" else again
        self.truncated += fault == "truncated"
        own = True
        steps = edits
        self.rest = []
        while steps:
            edit = steps[0]
            given = steps[1] if edit in "RI" else ""
            steps = steps[1 + len(given) :]
            self.audit += edit.encode()
            self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit in "KR":
                self.cost += TRUNCATED if fault == "truncated" else 0
            if edit == "I":
                self.rest.append((NAMES[given], ""))
            elif edit != "D" and own:
                self.rest.append((NAMES.get(given, role), None))
            own = own and edit == "I"

    def text(self, text: str) -> None:
        """The text of the row just fed; further copies come with nothing left to write."""
        for role, fixed in self.rest or ():
            self.put(role, text if fixed is None else fixed)
        self.rest = None

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)


DIGESTS = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def digests(conversations: DataFrame, rows: DataFrame, edits: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation of the original table: fault counts, cost, audit and hash of the repaired text.

    A SHA-256 is a chain over the whole text, so the rows of one conversation stream
    through one task in order; only the hash state and the audit are held.
    """
    name = F.col(conv_id).alias("conv")
    none = {"turn": rows.schema["turn"].dataType.simpleString(), "role": "string", "k": "binary", "copies": "long", "fault": "string", "edits": "string", "text": "string"}

    def shape(df: DataFrame, kind: int) -> DataFrame:
        return df.select("conv", F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    texts = rows.select("conv", "turn", "role", _digest().alias("k"), "text")
    stream = shape(conversations.select(name).distinct(), 0).unionByName(shape(edits, 1)).unionByName(shape(texts, 2))
    # Every conversation has a row of kind 0; it has a null turn and role, so it comes first.
    stream = stream.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("turn"), F.col("role"), F.col("k"), F.col("kind"))
    conv_type = stream.schema["conv"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        ids: list = []
        done: list[tuple] = []
        conv_arrow = None

        def close() -> None:
            done.append((now.gaps(), now.blank, now.duplicate, now.truncated, now.illegal, now.cost, now.audit.decode(), now.hash.hexdigest()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(ids[: len(done)], conv_arrow)]
            arrays += [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]]
            return pa.RecordBatch.from_arrays(arrays, [conv_id, *(f.split()[0] for f in DIGESTS.split(", "))])

        for batch in batches:
            conv_arrow = batch.schema.field("conv").type
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            convs, kinds, turns, roles = (columns[c].to_pylist() for c in ("conv", "kind", "turn", "role"))
            copies, faults, edit, words = (columns[c].to_pylist() for c in ("copies", "fault", "edits", "text"))
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if now is not None:
                        close()
                    now = _Digest()
                    ids.append(convs[i])
                elif kind == 1:
                    now.row(turns[i], roles[i], copies[i], faults[i], edit[i])
                else:
                    now.text(words[i])
            if len(done) >= 4096:
                yield flush()
                del ids[: len(done)]
                done.clear()
        if now is not None:
            close()
            yield flush()

    return stream.mapInArrow(fold, f"{conv_id} {conv_type}, {DIGESTS}")
