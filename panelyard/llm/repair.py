"""Conversation structure repair by a Viterbi search whose survivors coalesce.

A conversation is right if its roles read as an optional system turn and then pairs of user and
assistant. Four states say what may follow: nothing read yet (0), after system (1), after user (2),
after assistant (3). Per row the search keeps one survivor a state, the cheapest edits that end
there, ties by the least string of edits' initials. Survivors are leaves of a tree: an edge holds the
edits between two forks, a node knows who refers to it, and one that nobody refers to any more goes.
What all survivors have in common is final and leaves the tree at once, so the tree holds no more
than what is still open: a byte an edit for at most four open ends. Equal costs are settled by the whole open ends.
Two ends of one state, one row and one cost differ before either is over, since an end that only has insertions
more costs more; so the least end now is the least one whatever follows.

A survivor that any later rows leave dearer than another one is dropped, which is what lets the rest
coalesce: state 0 can be followed as state 3 for 4 (the system turn that only 0 may keep is deleted),
state 1 as state 3 for nothing.

The search sees no texts: faults are found by Spark, and the edits found are applied to the rows in a second,
sorted pass which holds one row at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read, small_batches
from .groups import with_least
from .sql import crc32

RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
#: The state a role's initial leads to, and the initial that can be inserted or written over.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))


class _Node:
    """An edge of the tree of open ends: edits since the parent's fork. `refs` counts children and the survivor."""

    __slots__ = ("parent", "edits", "refs")

    def __init__(self, parent: _Node | None, edits: bytes):
        self.parent, self.edits, self.refs = parent, bytearray(edits), 0
        if parent:
            parent.refs += 1


def _line(node: _Node, tail: bytes) -> list:
    """The nodes from the root to this one, then the tail."""
    out = [tail]
    while node:
        out.append(node)
        node = node.parent
    return out[::-1]


def _head(line: list, most: int | None) -> bytes:
    out = bytearray()
    for n in line:
        out += (n.edits if isinstance(n, _Node) else n)[: most and most - len(out)]
        if most and len(out) >= most:
            break
    return bytes(out)


def _less(a: tuple, b: tuple) -> bool:
    """Whether open end a (leaf, tail) reads less than b."""
    x, y = _line(*a), _line(*b)
    i = 0
    while i < min(len(x), len(y)) - 1 and x[i] is y[i]:
        i += 1
    for most in (64, None):  # ends mostly differ right after their fork
        p, q = _head(x[i:], most), _head(y[i:], most)
        k = min(len(p), len(q))
        if most is None or p[:k] != q[:k]:
            return p < q


class Search:
    """The search over one conversation's rows: step() for each, then end()."""

    def __init__(self):
        self.done = bytearray()  # edits that are final
        root = _Node(None, b"")
        self.kept = self._settle({0: (0, root, b"")}, {0: (0, root)})

    def step(self, initial: str, delete: bool, truncated: bool) -> None:
        found: dict[int, tuple] = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, leaf) in self.kept.items():
            self._offer(found, state, (cost + DELETE, leaf, b"D"))
            if not delete:
                if initial in _KEEP[state]:
                    self._offer(found, _KEEP[state][initial], (cost + more, leaf, b"K"))
                self._offer(found, _NEXT[state][1], (cost + RELABEL + more, leaf, b"R"))
        self.kept = self._settle(found, self.kept)

    def end(self) -> tuple[int, str]:
        """(cost, edits) of the cheapest way; state 0 has deleted everything."""
        found: dict[int, tuple] = {}
        for state in (0, 3):
            if state in self.kept:
                self._offer(found, 0, (*self.kept[state], b""))
        cost, leaf, _ = found[0]
        return cost, (self.done + b"".join(n.edits for n in _line(leaf, b"")[:-1])).decode()

    @staticmethod
    def _offer(found: dict, state: int, new: tuple) -> None:
        old = found.get(state)
        if old is None or new[0] < old[0] or new[0] == old[0] and _less(new[1:], old[1:]):
            found[state] = new

    def _settle(self, found: dict, before: dict) -> dict:
        """Insertions after the row, dominated states out, then the tree takes the edits over."""
        for state in (0, 1, 3, 2):  # an insertion into 3 comes after all into 2
            if state in found:
                cost, leaf, tail = found[state]
                self._offer(found, _NEXT[state][1], (cost + INSERT, leaf, tail + b"I"))
        if 0 in found and found[0][0] > found[3][0] + DELETE:
            del found[0]
        if 1 in found and found[1][0] > found[3][0]:
            del found[1]
        heirs: dict[int, int] = {}
        for _, leaf, _ in found.values():
            heirs[id(leaf)] = heirs.get(id(leaf), 0) + 1
        kept = {}
        for state, (cost, leaf, tail) in found.items():
            if heirs[id(leaf)] == 1:
                leaf.edits += tail
                kept[state] = (cost, leaf)
            else:
                kept[state] = (cost, _Node(leaf, tail))
        for _, leaf in before.values():
            while leaf.parent and id(leaf) not in heirs and not leaf.refs:  # nobody refers to it
                leaf = leaf.parent
                leaf.refs -= 1
        return self._coalesced(kept)

    def _coalesced(self, kept: dict) -> dict:
        """Forks with a single child left join it; a root with a single child is final."""
        for _, leaf in kept.values():
            node = leaf
            while (up := node.parent) is not None:
                if up.refs > 1:
                    node = up
                elif up.parent is None:
                    self.done += up.edits
                    node.parent = None
                else:
                    up.edits += node.edits
                    node.edits, node.parent = up.edits, up.parent
        if len(kept) == 1:
            ((_, leaf),) = kept.values()
            self.done += leaf.edits
            leaf.edits = bytearray()
        return kept

    def open(self) -> int:
        """Edits that are not final yet, over all open ends."""
        nodes = {id(n): n for _, leaf in self.kept.values() for n in _line(leaf, b"")[:-1]}
        return sum(len(n.edits) for n in nodes.values())


def _rows(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, with nulls of role and text as one space, and the texts' digest for order and comparison."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = chats.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"))
    return rows.withColumn("digest", F.sha2("text", 256))


_ORDER = ("turn", "role", "digest")  # ascending, nulls first


def diagnose(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation.

    Rows go by turn (nulls first), then role, then the text's digest, so repeated rows stand side by side. A null conversation
    id is a conversation of its own; null roles and texts are one space. Other columns are not
    read; an empty table gives no rows. One conversation's rows stream through one task, a few bytes each."""
    small_batches(chats.sparkSession)
    rows = _rows(chats, conv, turn, role, text)
    body = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    rows = rows.select(
        "conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated")
    )
    rows = with_least(rows, ["conv_id", "role", "digest"], F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("v")), F.col("turn"), "first")
    rows = rows.withColumn("later", ~F.col("first.v").eqNullSafe(F.col("turn"))).drop("first")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    used = ("conv_id", "turn", "role", "digest", "initial", "blank", "truncated", "later")

    def run(batches):
        held, now, none = [], None, object()
        last, tally, turns, search = none, None, None, None
        schema = None

        def row():
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (now, gaps, *tally, *search.end())

        def batch():
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (schema, *[pa.int64()] * 6, pa.string()), strict=True)], names)

        for b in batches:
            schema = b.schema.field("conv_id").type
            for conv, turn, role, digest, initial, blank, truncated, later in zip(*(b.column(c).to_pylist() for c in used), strict=True):
                if search is None or conv != now:
                    if search:
                        held.append(row())
                        if len(held) >= 2000:
                            yield batch()
                            held = []
                    now, last, tally, turns, search = conv, none, [0, 0, 0, 0], None, Search()
                same = last is not none and last[:3] == (turn, role, digest)
                fault = 0 if blank else 1 if later or same else 2 if truncated else None
                if fault is not None:
                    tally[fault] += 1
                if last is not none and last[3] + initial not in ("su", "ua", "au"):
                    tally[3] += 1
                if turn is not None:
                    turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
                search.step(initial, fault in (0, 1), fault == 2)
                last = (turn, role, digest, initial)
        if search:
            held.append(row())
        if held:
            yield batch()

    return rows.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repair(chats: DataFrame, diagnosed: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the repaired conversations' rows, those of one together and in order.

    `diagnosed` is what diagnose() found for the same rows. Inserted rows have no turn and an empty text. A conversation
    of which nothing stays has no rows."""
    small_batches(chats.sparkSession)
    rows = _rows(chats, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    audits = diagnosed.select("conv_id", null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), null("string").alias("digest"), "audit")
    # a conversation's audit has neither role nor turn, so it stands before its rows, whose role is never null
    both = rows.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_ORDER)
    kind = both.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "position", "edit", "turn", "role", "text"]

    def run(batches):
        schema, held, size = None, [], 0
        now, edits, at, number, state = None, "", 0, 0, 0

        def inserted():
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                name, state = _NEXT[state]
                at += 1
                yield "I", None, NAMES[name], ""

        def edited(turn, role, text):
            nonlocal at, state
            edit, at = edits[at], at + 1
            if edit == "K":
                state = _KEEP[state][role[:1]]
                yield edit, turn, role, text
            elif edit == "R":
                name, state = _NEXT[state]
                yield edit, turn, NAMES[name], text

        def batch():
            kinds = (schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for b in batches:
            schema = b.schema.field("conv_id").type
            for conv, audit, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "turn", "role", "text")), strict=True):
                if audit is not None:
                    now, edits, at, number, state = conv, audit, 0, 0, 0
                for out in (*(edited(turn, role, text) if audit is None else ()), *inserted()):
                    held.append((now, number, *out))
                    number += 1
                    size += len(out[3]) + 50
                if size > 4 << 20:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return both.mapInArrow(run, f"conv_id {kind}, position long, edit string, turn long, role string, text string")


def damaged(chats: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in, by the checksum of conversation and turn; nulls are one space there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = chats.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text: Column = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repair()'s output as it comes: `role:text` of all rows, joined by newlines."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, digest, held, schema = None, None, [], None

        def batch():
            ids, found = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])

        for b in batches:
            schema = b.schema.field("conv_id").type
            for conv, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if digest:
                        held.append((now, digest.hexdigest()))
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if len(held) >= 2000:
                yield batch()
                held = []
        if digest:
            held.append((now, digest.hexdigest()))
        if held:
            yield batch()

    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every original conversation; one that the damage leaves no rows has zeros and empty strings."""
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(chats)
    found = durable(diagnose(rows), "repair")
    counts = [c for c in found.columns if c not in ("conv_id", "audit")]
    hashes = digests(repair(rows, found)).withColumnRenamed("conv_id", "of_hash")
    out = chats.select("conv_id").distinct().join(found.withColumnRenamed("conv_id", "of_found"), F.col("conv_id").eqNullSafe(F.col("of_found")), "left")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("of_hash")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _edit(state: str, cost: str, letter: str, item: str | None = None) -> str:
    """A survivor (cost, edits, repaired rows) one edit on; none from none."""
    rows = f"{state}.r" if item is None else f"{state}.r || {item} || chr(10)"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}', 'r': {rows}}} end"


def _least(*found: str) -> str:
    return f"list_min([{', '.join(found)}])"


def _step() -> str:
    keep, again = "more", f"{RELABEL} + more"
    kept = lambda q, c: f"case when initial = '{c}' and not gone then {_edit(q, keep, 'K', 'role || chr(58) || text')} end"
    named = lambda q, name: f"case when not gone then {_edit(q, again, 'R', f"'{name}:' || text")} end"
    gone = lambda q: _edit(q, str(DELETE), "D")
    b2 = _least(gone("s2"), *(kept(q, "u") for q in ("s0", "s1", "s3")), *(named(q, "user") for q in ("s0", "s1", "s3")))
    base = f"select conv_id, i, {gone('s0')} as b0, {_least(gone('s1'), kept('s0', 's'))} as b1, {b2} as b2, {_least(gone('s3'), kept('s2', 'a'), named('s2', 'assistant'))} as b3"
    user = lambda q: _edit(q, str(INSERT), "I", "'user:'")
    after = f"select *, {_least('b2', user('b0'), user('b1'), user('b3'))} as n2 from ({base} from (select dp.conv_id, ft.i, s0, s1, s2, s3, initial, role, text, gone, more from dp join ft on ft.conv_id is not distinct from dp.conv_id and ft.i = dp.i + 1))"
    return f"select conv_id, i, b0 as s0, b1 as s1, n2 as s2, {_least('b3', _edit('n2', str(INSERT), 'I', chr(39) + 'assistant:' + chr(39)))} as s3 from ({after})"


_KEY = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
#: The same search with whole strings for survivors, a row of each conversation a step.
OP11_SQL = f"""
WITH RECURSIVE ch as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("k")} % 20 as f from (select *, {_KEY} as k from conversations)),
 dm as (select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case f when 0 then [] when 3 then [1, 2] else [1] end) as copy from ch),
 nb as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from dm),
 od as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from nb),
 ft as (select *, left(role, 1) as initial, fault in (0, 1) as gone, case when fault = 2 then {TRUNCATED} else 0 end as more from (select *, case when bare = '' then 0 when seen > 1 then 1 when right(bare, 1) not in ('.', '!', '?') then 2 else 3 end as fault from od)),
 pr as (select *, lag(initial) over (partition by conv_id order by i) as before from ft),
 ct as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 0) as blank, count(*) filter (where fault = 1) as duplicate, count(*) filter (where fault = 2) as truncated, count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as m from pr group by 1),
 dp as (select distinct conv_id, 0::bigint as i, {{'c': 0::bigint, 'e': '', 'r': ''}} as s0, null::struct(c bigint, e varchar, r varchar) as s1, {{'c': {INSERT}::bigint, 'e': 'I', 'r': 'user:' || chr(10)}} as s2, {{'c': {2 * INSERT}::bigint, 'e': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} as s3 from ch
  union all {_step()}),
 fn as (select dp.conv_id, {_least("s0", "s3")} as w from dp left join ct on ct.conv_id is not distinct from dp.conv_id where i = coalesce(m, 0))
select fn.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, w.c::bigint as cost, w.e as audit, sha256(left(w.r, length(w.r) - 1)) as repaired_sha256
from fn left join ct on ct.conv_id is not distinct from fn.conv_id
"""
