"""Conversation structure repair: the cheapest edits that make a conversation's roles take turns.

A repaired conversation is empty, or one optional system message followed by pairs of a user's and an assistant's
message. A row may be kept, given the role whose turn it is, or deleted, and an empty message may be inserted
anywhere. Each choice is an edge of a graph whose nodes are (rows read, last role), and its weight is one integer:
the cost in its high digits, and below them two octal digits for each row that spell the audit letters, zeros
filling up what is not written. As the letters of a row begin no other row's letters, the least sum of weights is
the least cost and among equal costs the audit that comes first in ASCII order, so an ordinary least-sum walk
through the graph decides everything.

One conversation is read as a stream of its rows in order: a node holds its weight and the digest of its repaired
text so far, never the texts. Digits on which all nodes agree are written out from time to time, so the integers
stay short however long the conversation is.

Defined cases, by the columns of the given frame:
- a null role or text counts as one space; a null turn comes first and is ignored by ``gaps``;
- rows of equal turn come in the order of role, then text; equal rows are duplicates of the first;
- an empty role has no initial: keeping it leaves the turn where it is, and it makes its neighbours illegal;
- rows without a conversation id form one conversation, whose id is null;
- a conversation all of whose rows are gone yields zeros, an empty audit and the digest of no text;
- an empty table yields no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tuneledger.llm.checksum_sql import CRC_TABLE, crc32

#: A character that is not white space; and an end that closes a sentence, white space behind it left out.
_INK, _CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# What an edit costs, and what a kept row costs that breaks off.
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1

#: Audit letters in ASCII order; a letter's digit is its place, zero stands for none.
_LETTERS = "\0DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3

# Last role written: none yet, system, user, assistant. Whose turn it is then, and what follows.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_TURN = {_EMPTY: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_INITIAL = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_NAME = {_USER: b"user", _ASSISTANT: b"assistant"}

#: A node whose cost lies further above that of a node in mid-conversation is on no cheapest walk: what follows it can
#: follow that node, too, with one message inserted and one system message deleted.
_AHEAD = INSERT + DELETE

#: Rows after which the digits that all nodes share are written out.
_SETTLE = 256


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The rows with faults put in by the checksum of their key; dropped ones stay, marked ``gone``.

    Returns id, turn, role, text (both without nulls) and gone; a repeated row comes twice.
    """
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in (conversation, None, turn)])
    fate = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select(
        F.col(conversation).alias("id"), F.col(turn).cast("long").alias("turn"), (fate == 0).alias("gone"),
        F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies).drop("copy")


def untouched(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The rows as they are, in the form that :func:`repair` takes."""
    return rows.select(
        F.col(conversation).alias("id"), F.col(turn).cast("long").alias("turn"), F.lit(False).alias("gone"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _fault(seen: Column) -> Column:
    """The first fault of a row: blank, duplicate or truncated; else an empty string."""
    return (F.when(~F.col("text").rlike(_INK), "blank").when(seen > 1, "duplicate")
            .when(~F.col("text").rlike(_CLOSED), "truncated").otherwise(""))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the least cost, the audit and the digest of the repaired text.

    One shuffle by conversation serves both the search for repeated messages and the walk: both only sort
    within its partitions, which spills instead of growing. A conversation of any length passes through one task
    as a stream, since the digest of its text must be taken in order.
    """
    by = [F.col("id"), F.col("gone"), F.col("role"), F.col("text")]
    order = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    marked = rows.repartition("id").withColumn("seen", seen).withColumn("fault", _fault(F.col("seen")))
    streamed = marked.sortWithinPartitions("id", order, "role", "text", "seen").select(
        "id", "turn", "gone", "role", F.col("text").cast("binary").alias("text"), "fault")
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return streamed.mapInArrow(_walk_all, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


class Walk:
    """The least weights to each node after the rows read so far, and the tallies of these rows."""

    def __init__(self):
        self.tally = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.first, self.last = 0, None, None
        self._before: str | None = None
        #: By last role: weight, and digest of the text written.
        self._nodes: dict[int, tuple[int, hashlib._Hash | None]] = {_EMPTY: (0, None)}
        self._rows, self._open, self._cost, self._written = 0, 0, 0, []

    def read(self, turn: int | None, role: str, text: bytes, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self._before is not None and self._before + initial not in ("su", "ua", "au"):
            self.tally["illegal"] += 1
        self._before = initial
        if fault:
            self.tally[fault] += 1
        self._step(role, initial, text, fault)
        self._rows += 1
        if self._rows % _SETTLE == 0:
            self._settle()

    def _step(self, role: str, initial: str, text: bytes, fault: str) -> None:
        self._open += 2
        shift = _BITS * self._open
        late = CUT if fault == "truncated" else 0
        best: dict[int, tuple[int, int, tuple]] = {}

        def offer(weight: int, to: int, start: int, pieces: tuple) -> None:
            if to not in best or weight < best[to][0]:
                best[to] = weight, start, pieces

        def one(base: int, at: int, start: int, digits: int, width: int, pieces: tuple) -> None:
            """Delete, keep or rename the row at a node; ``digits`` are those of an insertion before it."""
            def add(cost: int, digit: int) -> int:
                return base + (cost << shift) + (((digits << _BITS) | digit) << _BITS * (1 - width))

            offer(add(DELETE, _D), at, start, pieces)
            if fault in ("blank", "duplicate"):
                return
            to = at if not initial else _INITIAL.get(initial)
            if to is not None and (not initial or to == _TURN[at] or (to == _SYSTEM and at == _EMPTY)):
                offer(add(late, _K), to, start, (*pieces, role.encode() + b":" + text))
            turn = _TURN[at]
            offer(add(RENAME + late, _R), turn, start, (*pieces, _NAME[turn] + b":" + text))

        for at, (weight, _) in self._nodes.items():
            base = weight << 2 * _BITS
            one(base, at, at, 0, 0, ())
            turn = _TURN[at]
            one(base + (INSERT << shift), turn, at, _I, 1, (_NAME[turn] + b":",))
        far = min((best[at][0] >> shift for at in (_USER, _ASSISTANT) if at in best), default=None)
        self._nodes = {
            to: (weight, _extended(self._nodes[start][1], pieces)) for to, (weight, start, pieces) in best.items()
            if far is None or weight >> shift <= far + _AHEAD}

    def _settle(self) -> None:
        """Write out the leading digits that all nodes share, and take their least cost off all."""
        shift = _BITS * self._open
        low = [weight & ((1 << shift) - 1) for weight, _ in self._nodes.values()]
        unlike = 0
        for other in low[1:]:
            unlike |= low[0] ^ other
        left = -(-unlike.bit_length() // (2 * _BITS)) * 2
        self._written.append(_letters(low[0] >> _BITS * left, self._open - left))
        least = min(weight >> shift for weight, _ in self._nodes.values())
        self._nodes = {
            at: ((((weight >> shift) - least) << _BITS * left) | (weight & ((1 << _BITS * left) - 1)), digest)
            for at, (weight, digest) in self._nodes.items()}
        self._open, self._cost = left, self._cost + least

    def result(self) -> tuple:
        """Tallies, least cost, audit and digest at the end of the rows."""
        self._open += 1
        shift = _BITS * self._open
        ends = []
        for at, (weight, digest) in self._nodes.items():
            if at in (_EMPTY, _ASSISTANT):
                ends.append((weight << _BITS, at, digest, ()))
            elif at == _USER:
                ends.append(((weight << _BITS) + (INSERT << shift) + _I, at, digest, (_NAME[_ASSISTANT] + b":",)))
        weight, _, digest, pieces = min(ends, key=lambda end: end[:2])
        digest = _extended(digest, pieces) or hashlib.sha256()
        audit = "".join([*self._written, _letters(weight & ((1 << shift) - 1), self._open)])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.tally.values(), self._cost + (weight >> shift), audit, digest.hexdigest()


def _extended(digest: hashlib._Hash | None, pieces: tuple[bytes, ...]) -> hashlib._Hash | None:
    """A digest of the lines so far with more lines behind them; None stands for no line."""
    if not pieces:
        return digest
    joined = b"\n".join(pieces)
    if digest is None:
        return hashlib.sha256(joined)
    longer = digest.copy()
    longer.update(b"\n")
    longer.update(joined)
    return longer


def _letters(digits: int, width: int) -> str:
    """The letters of ``width`` octal digits, zeros left out."""
    return f"{digits:0{width}o}".translate(_SPELLED) if width else ""


_SPELLED = {ord("0"): None, **{ord(str(i)): letter for i, letter in enumerate(_LETTERS) if i}}


def _walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from rows sorted by conversation; one may go on over any number of batches."""
    walk, current, kind = None, None, None

    def done(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        found, kind = [], batch.schema.field("id").type
        for name, turn, gone, role, text, fault in zip(*(column.to_pylist() for column in batch.columns)):
            if walk is None or name != current:
                if walk is not None:
                    found.append((current, *walk.result()))
                walk, current = Walk(), name
            if not gone:
                walk.read(turn, role, text, fault)
        if found:
            yield done(found)
    if walk is not None:
        yield done([(current, *walk.result())])


def sql() -> str:
    """The repair of damaged ``conversations`` as DuckDB SQL: the same walk, one row of every conversation a step."""
    turn = "CASE {0} WHEN 2 THEN 3 ELSE 2 END"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
WITH RECURSIVE {CRC_TABLE},
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % 20 AS fate
    FROM conversations, crc_table),
hurt AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM fated),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM hurt),
judged AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS n
    FROM seen),
walk(conv_id, n, node, cost, audit, said) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '', NULL::VARCHAR FROM conversations
    UNION ALL
    SELECT conv_id, best.n, node, best.cost, best.audit, best.said FROM (
        SELECT conv_id, node, min({{'cost': cost, 'audit': audit, 'said': said, 'n': n}}) AS best FROM (
        SELECT conv_id, n, cost + {INSERT} * ins + CASE edit WHEN 'D' THEN {DELETE} ELSE
                CASE edit WHEN 'R' THEN {RENAME} ELSE 0 END + CASE fault WHEN 'truncated' THEN {CUT} ELSE 0 END END AS cost,
            audit || repeat('I', ins::INTEGER) || edit AS audit,
            CASE edit WHEN 'D' THEN place WHEN 'R' THEN {turn.format("place")} ELSE
                CASE initial WHEN '' THEN place WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS node,
            nullif(concat_ws(chr(10), said, CASE WHEN ins = 1 THEN CASE place WHEN 2 THEN 'user:' ELSE 'assistant:' END END,
                CASE edit WHEN 'K' THEN role || ':' || text
                    WHEN 'R' THEN CASE {turn.format("place")} WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END), '') AS said
        FROM (SELECT w.conv_id, j.n, w.cost, w.audit, w.said, ins, edit, j.role, j.text, j.initial, j.fault,
                CASE ins WHEN 0 THEN w.node ELSE {turn.format("w.node")} END AS place
            FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.n = w.n + 1,
                (SELECT unnest([0, 1]) AS ins), (SELECT unnest(['D', 'K', 'R']) AS edit))
        WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR initial = ''
            OR initial = 's' AND place = 0 OR initial = 'u' AND place <> 2 OR initial = 'a' AND place = 2))
        GROUP BY conv_id, node)),
reached AS (SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS rows, node, cost, audit, said FROM walk),
closed AS (SELECT conv_id, cost + CASE node WHEN 2 THEN {INSERT} ELSE 0 END AS whole_cost,
        audit || CASE node WHEN 2 THEN 'I' ELSE '' END AS whole_audit,
        CASE node WHEN 2 THEN concat_ws(chr(10), said, 'assistant:') ELSE coalesce(said, '') END AS whole_text
    FROM reached WHERE n = rows AND node IN (0, 2, 3)),
ended AS (SELECT conv_id, min({{'cost': whole_cost, 'audit': whole_audit, 'said': whole_text}}) AS best FROM closed GROUP BY conv_id),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM judged),
tallies AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM pairs GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(best.said) AS repaired_sha256
FROM ended e LEFT JOIN tallies t ON e.conv_id IS NOT DISTINCT FROM t.conv_id"""
