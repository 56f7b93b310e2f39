"""Structure repair of conversations: cheapest edits by a min-plus product over a shared grammar."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonwatch.llm.common import in_order, spread_count, stored

# fixed values: what edits cost, and what an undeleted truncated row adds
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"

#: Rows of a conversation that one task repairs at a time, as a power of two.
BLOCK_BITS = 10
#: Rounds of pair replacement, and rules made in each; more make sequences shorter, not results different.
ROUNDS, RULES_A_ROUND = 8, 64

# what a repaired prefix may end in: nothing, system, user, assistant; nothing and assistant may end a conversation
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
#: One letter per row: s, u, a or o (another role), in capitals if truncated, x if it has to go.
LETTERS = "suaoSUAOx"

Entry = tuple[int, str]
Matrix = list[list[Entry | None]]


# -- min-plus products ------------------------------------------------------------


def _least(found: Entry | None, new: Entry) -> Entry:
    return new if found is None or new < found else found


def _times(a: Matrix, b: Matrix) -> Matrix:
    """Cheapest ways from state to state through both, ties to the audit that sorts first.

    Equally cheap audits of the same rows never begin with one another, as one
    would hold more insertions, so the least audit of a whole is made of least ones.
    """
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if (left := a[i][k]) is not None:
                for j in range(4):
                    if (right := b[k][j]) is not None:
                        out[i][j] = _least(out[i][j], (left[0] + right[0], left[1] + right[1]))
    return out


def _inserted() -> Matrix:
    """Any number of insertions: to each state by the shortest way."""
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        state, n = i, 0
        while (state := MOVES["u"].get(state, ASSISTANT)) != i and out[i][state] is None:
            n += 1
            out[i][state] = (INSERT * n, "I" * n)
    return out


INSERTED = _inserted()


@lru_cache(maxsize=None)
def _row(letter: str) -> tuple:
    """Matrix of one row, with the insertions before it."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if letter != "x":
            extra = TRUNCATED if letter.isupper() else 0
            for role, moves in MOVES.items():
                if i in moves:
                    if role == letter.lower():
                        out[i][moves[i]] = _least(out[i][moves[i]], (extra, "K"))
                    if role in NAMES:
                        out[i][moves[i]] = _least(out[i][moves[i]], (REROLE + extra, "R"))
    return tuple(map(tuple, _times(INSERTED, out)))


class Grammar:
    """Rules that name frequent pairs of symbols, and the transfer matrix of every symbol.

    Symbols are the letters by place, then the rules in the order they were made.
    A rule's matrix has for every pair of states the cost and the state in
    between; audits are ropes over the rules' parts, spelled out when compared.
    """

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.matrix: list[list[list[tuple | None]]] = [[[e for e in row] for row in _row(c)] for c in LETTERS]
        self.parts: list[tuple[int, int] | None] = [None] * len(LETTERS)
        self._spelled: dict[tuple[int, int, int], str] = {}

    def audit(self, symbol: int, i: int, j: int) -> str:
        if self.parts[symbol] is None:
            return self.matrix[symbol][i][j][1]
        key = (symbol, i, j)
        if key not in self._spelled:
            left, right = self.parts[symbol]
            k = self.matrix[symbol][i][j][1]
            self._spelled[key] = self.audit(left, i, k) + self.audit(right, k, j)
        return self._spelled[key]

    def add(self, pairs: list[tuple[int, int]]) -> None:
        """A rule for each pair, evaluated from the matrices of its two parts."""
        self.rounds.append({})
        for left, right in pairs:
            self.rounds[-1][left, right] = len(self.parts)
            out: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]
            for i in range(4):
                for j in range(4):
                    ways = [
                        (self.matrix[left][i][k][0] + self.matrix[right][k][j][0], k)
                        for k in range(4)
                        if self.matrix[left][i][k] is not None and self.matrix[right][k][j] is not None
                    ]
                    if ways:
                        cost = min(ways)[0]
                        ties = [k for c, k in ways if c == cost]
                        if len(ties) > 1:
                            ties.sort(key=lambda k: self.audit(left, i, k) + self.audit(right, k, j))
                        out[i][j] = (cost, ties[0])
            self.parts.append((left, right))
            self.matrix.append(out)

    @staticmethod
    def replaced(symbols: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
        out, at = [], 0
        while at < len(symbols):
            name = rules.get((symbols[at], symbols[at + 1])) if at + 1 < len(symbols) else None
            out.append(symbols[at] if name is None else name)
            at += 1 if name is None else 2
        return out

    def solve(self, letters: str) -> Matrix:
        """Cheapest edits of a run of rows from every state to every state."""
        symbols = [LETTERS.index(c) for c in letters]
        for rules in self.rounds:
            symbols = self.replaced(symbols, rules)
        out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
        for s in symbols:
            spelled = [[None if e is None else (e[0], self.audit(s, i, j)) for j, e in enumerate(row)] for i, row in enumerate(self.matrix[s])]
            out = _times(out, spelled)
        return out


def _chosen(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Pairs, the most frequent first, of which no two can overlap: no symbol ends one and begins another."""
    lefts, rights, out = set(), set(), []
    for left, right in counts:
        if left not in rights and right not in lefts and (left != right or left not in lefts | rights):
            out.append((left, right))
            lefts.add(left)
            rights.add(right)
        if len(out) == most:
            break
    return out


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for pair, k in Counter(zip(symbols, symbols[1:])).items():
                counts[pair] += k * n
    if counts:
        left, right = zip(*counts)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(counts.values(), pa.int64())], names=["a", "b", "n"])


def learned(sequences: DataFrame, rounds: int = ROUNDS, most: int = RULES_A_ROUND) -> Grammar:
    """Grammar of all rows of ``sequences`` (seq: letters; n: how often it occurs), by rounds of pair replacement.

    Tasks count the pairs of their sequences; the driver gets the most frequent
    pairs of each round, at most some ``most`` a symbol, and names up to ``most`` of them.
    """
    grammar = Grammar()
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    current = sequences.select(F.transform(letters, lambda c: F.instr(F.lit(LETTERS), c) - 1).alias("s"), "n")
    for _ in range(rounds):
        pairs = current.mapInArrow(_count_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        best = pairs.filter("n > 1").orderBy(F.desc("n"), "a", "b").limit(8 * most).collect()
        named = _chosen([(r["a"], r["b"]) for r in best], most)
        if not named:
            break
        grammar.add(named)
        current = stored(current.mapInArrow(_replace(grammar.rounds[-1]), "s array<int>, n long"))
    return grammar


def _replace(rules: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shorter = [Grammar.replaced(s, rules) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shorter, pa.list_(pa.int32())), batch.column(1)], names=["s", "n"])

    return run


# -- rows, blocks, conversations ---------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn`` modulo 20; a null is one space.

    0: dropped; 1: without text; 2: without sentence ends; 3: twice; 4: of the user.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in their conversations' order, with what is known of each alone; stored."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim(text, F.lit(SPACES))
    initial = F.substring(role, 1, 1)
    known = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("cls"), (bare == "").alias("blank"),
        F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"), *[F.xxhash64(F.lit(k), role, text).alias(f"d{k}") for k in (1, 2)],
    )
    return in_order(known, "conv_id", "turn", "role", "d1", "d2")


def _legal(first: Column, second: Column) -> Column:
    return F.concat(first, second).isin("su", "ua", "au")


def _blocks(rows: DataFrame) -> DataFrame:
    """Runs of a conversation's rows: their letters, first pos, and counts that add up over blocks; stored."""
    narrow = rows.drop("role", "text")
    same = narrow.filter("not blank").groupBy("conv_id", "d1", "d2").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = narrow.filter("not blank").alias("x").join(
        same.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.d1") == F.col("y.d1")) & (F.col("x.d2") == F.col("y.d2"))
    )
    again = met.filter("pos > first").select("pos", F.lit(True).alias("again"))
    marked = narrow.join(again, "pos", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    line = F.struct("pos", "turn", "cls", "blank", "ended", "again")
    grouped = marked.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("blk")).agg(
        F.array_sort(F.collect_list(line)).alias("rows"), F.count_if("blank").alias("blank"), F.count_if("again").alias("duplicate"),
        F.count_if(~F.col("blank") & ~F.col("again") & ~F.col("ended")).alias("truncated"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    letter = lambda x: F.when(x["blank"] | x["again"], "x").when(x["ended"], x["cls"]).otherwise(F.upper(x["cls"]))
    last = F.size("rows")
    pairs = F.filter(F.transform("rows", lambda x, i: F.when(i + 1 < last, _legal(x["cls"], F.get("rows", i + 1)["cls"]))), lambda ok: ~ok)
    return stored(
        grouped.select(
            "conv_id", "blk", F.col("rows")[0]["pos"].alias("first_pos"), F.array_join(F.transform("rows", letter), "").alias("seq"), "blank", "duplicate",
            "truncated", "low", "high", F.size(pairs).cast("bigint").alias("illegal"), F.col("rows")[0]["cls"].alias("first_cls"),
            F.element_at("rows", -1)["cls"].alias("last_cls"), F.col("rows")[0]["turn"].alias("first_turn"), F.element_at("rows", -1)["turn"].alias("last_turn"),
            F.size(F.array_distinct(F.array_compact(F.transform("rows", lambda x: x["turn"])))).cast("bigint").alias("turns"),
        )
    )


def _solve(grammar: Grammar):
    """Blocks with their matrices: 16 costs (null: no way) and audits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solved = lru_cache(maxsize=4096)(grammar.solve)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds the audits of one batch
                part = batch.slice(at, 256)
                flat = [[e for row in solved(seq) for e in row] for seq in part.column("seq").to_pylist()]
                costs = pa.array([[None if e is None else e[0] for e in m] for m in flat], pa.list_(pa.int64()))
                audits = pa.array([[None if e is None else e[1] for e in m] for m in flat], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, costs, audits], names=[*part.schema.names, "costs", "audits"])

    return run


class _Walk:
    """A conversation's cheapest ways so far, block after block.

    Of the audits only what tells them apart is kept: a rank among those that
    differ somewhere, and for those that begin with one another the insertions
    that one has more.  So a conversation of any length takes a few bytes a block.
    """

    def __init__(self) -> None:
        self.ways: dict[int, tuple[int, int, str]] = {START: (0, 0, "")}
        self.blocks: list[tuple[int, dict[int, int]]] = []

    def block(self, number: int, costs: list[int | None], audits: list[str | None]) -> None:
        found = {}
        for j in range(4):
            options = [(c + costs[4 * k + j], rank, more + audits[4 * k + j], k) for k, (c, rank, more) in self.ways.items() if costs[4 * k + j] is not None]
            if options:
                found[j] = min(options)
        self.blocks.append((number, {j: best[3] for j, best in found.items()}))
        self.ways, rank, head = {}, -1, None
        for old, audit, j in sorted((best[1], best[2], j) for j, best in found.items()):
            if head is None or old != head[0] or not audit.startswith(head[1]):
                rank, head = rank + 1, (old, audit)
            self.ways[j] = (found[j][0], rank, audit[len(head[1]) :])

    def end(self) -> tuple[int, list[tuple[int, int, int]], int]:
        """Cost, (block, state before, state after) of every block, and how many insertions end the conversation."""
        options = [
            (c + INSERTED[j][f][0], rank, more + INSERTED[j][f][1], j, len(INSERTED[j][f][1]))
            for j, (c, rank, more) in self.ways.items() for f in (START, ASSISTANT) if INSERTED[j][f] is not None
        ]
        cost, _, _, state, after = min(options)
        out = []
        for number, came in reversed(self.blocks):
            out.append((number, came[state], state))
            state = came[state]
        return cost, out[::-1], after


_PICKS = pa.schema(
    [("conv_id", pa.string()), ("blk", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("after", pa.int32())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation: each block's states, and with the last one the conversation's sums."""
    key, walk, sums, before = object(), None, {}, {}

    def closed() -> list[dict]:
        cost, states, after = walk.end()
        gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
        rows = [{"conv_id": key, "blk": n, "i": i, "j": j, "after": 0} for n, i, j in states]
        rows[-1] |= {"after": after, "cost": cost, "gaps": gaps} | {c: sums[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        return rows

    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if walk is None or row["conv_id"] != key:
                if walk is not None:
                    out += closed()
                key, walk, before = row["conv_id"], _Walk(), None
                sums = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            walk.block(row["blk"], row["costs"], row["audits"])
            for c in ("turns", "blank", "duplicate", "truncated", "illegal"):
                sums[c] += row[c]
            if row["low"] is not None:
                sums["low"] = row["low"] if sums["low"] is None else min(sums["low"], row["low"])
                sums["high"] = row["high"] if sums["high"] is None else max(sums["high"], row["high"])
            if before is not None:
                sums["illegal"] += before["last_cls"] + row["first_cls"] not in ("su", "ua", "au")
                sums["turns"] -= before["last_turn"] is not None and before["last_turn"] == row["first_turn"]
            before = {c: row[c] for c in ("last_cls", "last_turn")}
        yield pa.RecordBatch.from_pylist(out, schema=_PICKS)
    if walk is not None:
        yield pa.RecordBatch.from_pylist(closed(), schema=_PICKS)


_EDITS = pa.schema(
    [("conv_id", pa.string()), ("pos", pa.int64()), ("kind", pa.int32()), ("role", pa.string()), ("text", pa.string())]
    + [(c, pa.string()) for c in ("edit", "before", "after")]
)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every row that is not kept as it is, or has insertions beside it."""
    for batch in batches:
        out = []
        for block in batch.to_pylist():
            state, at, before, own = block["i"], 0, "", []
            for edit in block["part"]:
                role = None
                if edit == "K":
                    role = block["seq"][at].lower()
                elif edit != "D":
                    role = "a" if state == USER else "u"
                state = state if role is None else MOVES[role][state]
                if edit == "I":
                    before += role
                    continue
                own.append({"conv_id": block["conv_id"], "pos": block["first_pos"] + at, "kind": 0, "role": NAMES.get(role), "edit": edit, "before": before, "after": ""})
                at, before = at + 1, ""
            for _ in range(block["after"]):
                role = "a" if state == USER else "u"
                own[-1]["after"] += role
                state = MOVES[role][state]
            out += [r for r in own if r["edit"] != "K" or r["before"] or r["after"]]
        yield pa.RecordBatch.from_pylist(out, schema=_EDITS)


_TURNS = pa.schema([("conv_id", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows, from rows and edits sorted by conversation and pos, an edit before its row."""
    edit: dict | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                edit = row
                continue
            own = edit if edit and edit["pos"] == row["pos"] else {"edit": "K", "before": "", "after": ""}
            new = [{"role": NAMES[c], "text": ""} for c in own["before"]]
            if own["edit"] != "D":
                new.append({"role": own["role"] if own["edit"] == "R" else row["role"], "text": row["text"]})
            new += [{"role": NAMES[c], "text": ""} for c in own["after"]]
            out += [{"conv_id": row["conv_id"]} | r for r in new]
        yield pa.RecordBatch.from_pylist(out, schema=_TURNS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each conversation's role:text lines, which run through it as they come."""
    names = ["conv_id", "repaired_sha256"]
    key, digest = None, None
    for batch in batches:
        out = []
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or conv_id != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], names=names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (key, digest.hexdigest())], names=names)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A report per conversation, and the repaired rows (conv_id, role, text; in order within a task).

    ``rows`` (conv_id, turn, role, text) are taken by turn, null first, rows of one
    turn by role and a hash; nulls in role and text are one space; rows without
    conv_id are one conversation; other columns are not looked at.  ``ids``
    (conv_id, may repeat) names conversations to report even if they have no rows:
    they get zeros, an empty audit and the hash of an empty string.

    A row's first fault counts: blank, duplicate (role and text stood earlier in
    the conversation), truncated (its last character but spaces is not . ! or ?).
    Edits are Keep, Rerole, Delete and Insert, so that the roles' initials become
    ``(s?(ua)+)?``; of the cheapest the audit that sorts first is taken.

    Rows are sorted by ranges, so a long conversation lies in many tasks, and cut
    into blocks of some 1 000 rows.  The blocks' letters (role and fault) are
    compressed by a grammar of frequent pairs learned from all of them; each rule
    has one transfer matrix for all conversations.  Matrices of blocks, not rows,
    are walked conversation by conversation with a bounded state.  An audit is one
    string, so a conversation may have some 10^9 rows.
    """
    source = _ordered(rows)
    blocks = _blocks(source)
    grammar = learned(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")))
    n = spread_count(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    # ids travel as text, so that null stays apart from all others
    named = blocks.withColumn("conv_id", F.col("conv_id").cast("string"))
    lists = [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]
    solved = stored(named.mapInArrow(_solve(grammar), T.StructType([*named.schema.fields, *lists])))
    dealt = solved.drop("seq", "first_pos").repartition(n, "conv_id").sortWithinPartitions("conv_id", "blk")
    sums = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    picks = stored(dealt.mapInArrow(_walk, f"conv_id string, blk long, i int, j int, after int, {sums}"))
    of = solved.select("conv_id", "blk", "first_pos", "seq", "audits").withColumnRenamed("conv_id", "_c").withColumnRenamed("blk", "_b")
    parts = of.join(picks, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_b") == F.col("blk")))
    parts = stored(parts.select("conv_id", "blk", "first_pos", "seq", "i", "after", F.col("audits")[F.col("i") * 4 + F.col("j")].alias("part")))
    edits = parts.mapInArrow(_edits, "conv_id string, pos long, kind int, role string, text string, edit string, before string, after string")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("edit", "before", "after")]
    lines = source.select(F.col("conv_id").cast("string").alias("conv_id"), "pos", F.lit(1).alias("kind"), "role", "text", *nothing)
    met = lines.unionByName(edits).repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos", "kind")
    repaired = met.mapInArrow(_apply, "conv_id string, role string, text string")
    digests = repaired.mapInArrow(_digest, "conv_id string, repaired_sha256 string")
    ended = F.concat("part", F.repeat(F.lit("I"), "after"))
    audits = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", ended.alias("p")))), lambda x: x["p"]), "").alias("audit"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    totals = picks.filter("cost is not null").select("conv_id", *counts)
    known = rows.select("conv_id") if ids is None else ids.select("conv_id").union(rows.select("conv_id"))
    report = known.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.lit(1).alias("_one"))
    for k, part in enumerate((totals, audits, digests)):
        part = part.withColumnRenamed("conv_id", f"_c{k}")
        report = report.join(part, F.col("id").eqNullSafe(F.col(f"_c{k}")), "left")
    report = report.select(
        F.col("id").cast(kind).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
    return report, repaired.withColumn("conv_id", F.col("conv_id").cast(kind))
