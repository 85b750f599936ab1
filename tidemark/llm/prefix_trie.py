"""The trie of conversations' prefixes, by partial tries that tasks make and that are merged by key.

A node is a distinct sequence of first turns, known by 128 bits of rolling hash over the turns' digests, so that no text is
shuffled and a part of a conversation can be hashed by itself. Steps:

1. Turns are put in order by ranges of (conversation, turn), so that a very long conversation is many tasks' work, and
   packed into runs of at most `RUN` turns. What crosses the bounds of a run is carried over one row for each.
2. Each task makes a partial trie of its runs: for each node its members' number, the smallest of them, and the lists of
   those that end there. Partial tries meet in rounds, `FAN` of them at a time, by the node's hash: members are summed,
   smallest ones compared. Lists of ends are kept in blocks of `BLOCK` neighbouring ids, so none grows with the input.
3. Subtrees roll up from the bottom: a node belongs to its smallest member, and what belongs to a conversation is the
   lower end of its path. That end is summed from its leaf up; its total goes to all nodes above it by a second round of
   partial tries. So the number of jobs doesn't depend on the trie's depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import cut
from tidemark.llm.components import joined

RUN, FAN, BLOCK = 512, 64, 512
#: Nodes and ends that a task holds before it sends them; depths that one task sums.
HELD, DEPTHS = 1 << 17, 1 << 16
#: Runs of one conversation whose hashes one task folds; the folded blocks are a row each.
TOGETHER = 4096
WIDTH = 16
_MASK, _BASES = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def digest(role: str | Column = "role", text: str | Column = "text") -> Column:
    """128 bits that stand for a turn's role and text; null is as empty."""
    role, text = (F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text).cast("binary")))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's turns in order as runs of one conversation's turns."""
    part, offset = TaskContext.get().partitionId(), {}
    kinds = {"part": pa.int32(), "conv_id": pa.int64(), "offset": pa.int64(), "n": pa.int32(), "digests": pa.binary(), "chars": pa.binary(), "alone": pa.bool_()}

    def rows(made: list[tuple[int, bytes, bytes]], next_of: int | None) -> pa.RecordBatch:
        out = []
        for (conv, d, c), after in zip(made, [*(x[0] for x in made[1:]), next_of]):
            before = offset.get(conv, 0)
            offset.clear()
            offset[conv] = before + len(d) // WIDTH
            out.append((part, conv, before, len(d) // WIDTH, d, c, before == 0 and after != conv))
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(kinds), kinds.values())], names=list(kinds))

    held: tuple[int, bytes, bytes] | None = None
    for batch in batches:
        convs, made = batch.column(0).to_numpy(zero_copy_only=False), []
        digests, chars = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype("<i8")
        cuts = [0, *(np.flatnonzero(np.diff(convs)) + 1).tolist(), len(convs)]
        for a, b in zip(cuts, cuts[1:]):
            for at in range(a, b, RUN):
                to = min(at + RUN, b)
                now = (int(convs[at]), b"".join(digests[at:to]), chars[at:to].tobytes())
                if held and held[0] == now[0] and len(held[1]) + len(now[1]) <= RUN * WIDTH:
                    held = (held[0], held[1] + now[1], held[2] + now[2])
                    continue
                made += [held] if held else []
                held = now
        yield rows(made, held[0] if held else None)
    yield rows([held] if held else [], None)


def runs(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, start, n, digests, chars, whole): conversations as runs of turns in order (null turns first, equal ones
    by digest). `whole` tells that the run is all of its conversation. Rows with a null id belong to no conversation."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest(role_col, text_col).alias("digest"), F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).alias("chars")).where("conv_id IS NOT NULL")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    packed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "chars").mapInArrow(_packed, "part int, conv_id long, offset long, n int, digests binary, chars binary, alone boolean"))
    ends = packed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    at_ends = packed.groupBy("part", "conv_id").agg(F.sum("n").alias("n")).join(ends, "part").where("conv_id IN (low, high)")
    # at most two conversations of a part: its first one may have begun in earlier parts, its last one may go on
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = at_ends.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"), (F.count("*").over(Window.partitionBy("conv_id")) > 1).alias("spans"))
    marked = packed.join(carried, ["part", "conv_id"], "left")
    whole = F.col("alone") & ~F.coalesce("spans", F.lit(False))
    return marked.select("conv_id", (F.col("offset") + F.coalesce("carry", F.lit(0))).alias("start"), F.col("n").cast("long").alias("n"), "digests", "chars", whole.alias("whole"))


def rebuilt(found: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The runs of conversations c whose first h turns are replaced by those of conversation c - c % every: all of them if
    that has fewer, none if there is no such conversation. h is crc32(decimal c) % most."""
    keep = F.lit(most - 1) - F.col("start")
    first = found.where((F.col("conv_id") % every == 0) & (F.col("start") < most - 1))
    first = first.select("conv_id", F.struct("start", F.substring("digests", 1, keep.cast("int") * WIDTH).alias("d"), F.substring("chars", 1, keep.cast("int") * 8).alias("c")).alias("x"))
    listed = first.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most most - 1 turns
    glued = lambda k: F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x[k]))
    heads = listed.select(F.col("conv_id").alias("base"), glued("d").alias("head"), glued("c").alias("head_chars"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    both = found.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h.cast("int"), "own": F.col("start")}).join(heads, "base", "left")
    lent = F.least(F.col("h"), F.coalesce(F.octet_length("head") / WIDTH, F.lit(0)).cast("int"))
    left = F.greatest(F.col("h") - F.col("own"), F.lit(0)).cast("int")

    def made(head: str, own: str, width: int) -> Column:
        rest = F.substring(own, left * width + 1, F.octet_length(own))
        return F.when(F.col("own") == 0, F.concat(F.coalesce(F.substring(head, 1, lent * width), F.lit(b"")), rest)).otherwise(rest)

    start = F.when(F.col("own") == 0, 0).otherwise(lent + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    digests = made("head", "digests", WIDTH)
    return both.select("conv_id", "own", start.cast("long").alias("start"), digests.alias("digests"), made("head_chars", "chars", 8).alias("chars"), "whole")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _steps(state: tuple[int, int], digests: bytes) -> Iterator[tuple[int, int]]:
    """The rolling hash after each turn."""
    a, b = state
    for x, y in zip(*[iter(np.frombuffer(digests, "<u8").tolist())] * 2):
        a, b = (a * _BASES[0] + x) & _MASK, (b * _BASES[1] + y) & _MASK
        yield a, b


def _after(state: tuple[int, int], n: int, more: tuple[int, int]) -> tuple[int, int]:
    """The rolling hash after n further turns whose own hash is `more`; signed or not."""
    return tuple((s * pow(base, n, 1 << 64) + m) & _MASK for s, base, m in zip(state, _BASES, more))


def _node(state: tuple[int, int]) -> bytes:
    return state[0].to_bytes(8, "little") + state[1].to_bytes(8, "little")


def hashed(found: DataFrame) -> DataFrame:
    """Runs with a and b, the rolling hash of what their conversation has before them, and `last`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, own, d in zip(*(c.to_pylist() for c in batch.columns)):
                end = (0, 0)
                for end in _steps((0, 0), d):
                    pass
                out.append((conv, own, len(d) // WIDTH, _signed(end[0]), _signed(end[1])))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 5)], names=["conv_id", "own", "n", "a", "b"])

    def fold(t: pa.Table) -> pa.Table:
        """Where each row's hash begins, and what the rows come to in all, in a row of its own."""
        t, n, a, b, out = t.sort_by("own"), 0, 0, 0, []
        for own, k, x, y in zip(*(t[c].to_pylist() for c in ("own", "n", "a", "b"))):
            out.append((own, n, _signed(a), _signed(b), False))
            n, a, b = n + k, *_after((a, b), k, (x, y))
        out.append((out[0][0], n, _signed(a), _signed(b), True))
        columns = [pa.array(x) for x in zip(*out)]
        conv, block = (pa.array([t[c][0].as_py()] * len(out), pa.int64()) for c in ("conv_id", "block"))
        return pa.table([conv, block, *columns], names=["conv_id", "block", "own", "n", "a", "b", "all"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash before a run: that before its block, then that of the block's runs before it."""
        for batch in batches:
            conv, own, n, a, b, x, y, last = (c.to_pylist() for c in batch.columns)
            ends = [_after((x[i], y[i]), n[i], (a[i], b[i])) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array([_signed(e[k]) for e in ends], pa.int64()) for k in (0, 1)), batch.column(7)], names=["conv_id", "own", "a", "b", "last"])

    parts = found.where(~F.col("whole"))
    kinds, folded = "conv_id long, own long, n long, a long, b long", "conv_id long, block long, own long, n long, a long, b long, all boolean"
    each_run = parts.select("conv_id", "own", "digests").mapInArrow(each, kinds).withColumn("block", F.floor(F.col("own") / (RUN * TOGETHER)))
    inside = cut(each_run.groupBy("conv_id", "block").applyInArrow(fold, folded))  # TOGETHER runs or some more
    blocks = inside.where("all").select("conv_id", F.col("block").alias("own"), "n", "a", "b", F.lit(0).cast("long").alias("block"))
    before_block = blocks.groupBy("conv_id").applyInArrow(fold, folded).where("NOT all").select("conv_id", F.col("own").alias("block"), F.col("a").alias("x"), F.col("b").alias("y"))  # a row for each block
    ends = inside.where("NOT all").groupBy("conv_id").agg(F.max("own").alias("end"))
    runs_of = inside.where("NOT all").join(before_block, ["conv_id", "block"]).join(ends, "conv_id")
    before = runs_of.select("conv_id", "own", "n", "a", "b", "x", "y", (F.col("own") == F.col("end")).alias("last")).mapInArrow(placed, "conv_id long, own long, a long, b long, last boolean")
    alone = found.where("whole").select("*", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("last"))
    return alone.unionByName(parts.join(before, ["conv_id", "own"])).drop("whole")


_PARTIAL = {"node": pa.binary(), "part": pa.int32(), "parent": pa.binary(), "digest": pa.binary(), "depth": pa.int64(), "chars": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "block": pa.int64(), "ends": pa.list_(pa.int64())}


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's partial trie, in as many pieces as its memory asks for. Ends go in blocks, each with a row of its own."""
    part = TaskContext.get().partitionId()
    nodes: dict[bytes, list] = {}
    ends: dict[tuple[bytes, int], list[int]] = {}

    def rows() -> pa.RecordBatch:
        out = [(k, part, *v, None, None) for k, v in nodes.items()]
        out += [(k, part, None, None, None, None, None, 0, block, sorted(ids)) for (k, block), ids in ends.items()]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(_PARTIAL), _PARTIAL.values())], names=list(_PARTIAL))

    held = 0
    for batch in batches:
        for conv, own, start, digests, chars, a, b, last in zip(*(c.to_pylist() for c in batch.columns)):
            state, at = (a & _MASK, b & _MASK), start
            key = _node(state)
            if own == 0:
                root = nodes.setdefault(key, [None, None, 0, 0, conv, 0])
                root[4], root[5] = min(root[4], conv), root[5] + 1
            for i, (state, n) in enumerate(zip(_steps(state, digests), np.frombuffer(chars, "<i8").tolist())):
                parent, key, at = key, _node(state), at + 1
                if (node := nodes.get(key)) is None:
                    nodes[key] = [parent, digests[i * WIDTH : (i + 1) * WIDTH], at, n, conv, 1]
                else:
                    node[5] += 1
                    if conv < node[4]:
                        node[4] = conv
            if last:
                ends.setdefault((key, conv // BLOCK), []).append(conv)
                held += 1
            if len(nodes) + held > HELD:
                yield rows()
                nodes.clear()
                ends.clear()
                held = 0
    yield rows()


def merged(partial: DataFrame, key: str, part: str, sums: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Partial tables as one: rows of a key meet FAN parts at a time, in as many rounds as the parts need."""
    parts = (partial.agg(F.max(part)).first()[0] or 0) + 1
    agg = [f(c).alias(c) for c, f in sums.items()]
    while parts > 1:
        parts = -(-parts // FAN)
        partial = partial.withColumn(part, F.floor(F.col(part) / FAN).cast("int")).groupBy(key, part).agg(*agg)
    return partial.groupBy(key).agg(*agg)


def trie(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of all runs' trie, and their ends.

    Nodes: node, parent (null for the root), digest (of the last turn), depth, conv_id (the smallest member), n_convs,
    n_children, n_leaves (childless nodes at or below it), saved (summed over the nodes at or below it: members less one,
    times the code points of the last text). Ends: node, block, ends (ids in order; blocks in order too). No conversations
    make no node, not even a root. A conversation without turns ends at the root.
    """
    ready = cut(hashed(found).select("conv_id", "own", "start", "digests", "chars", "a", "b", "last"))
    pieces = cut(ready.mapInArrow(_partial, "node binary, part int, parent binary, digest binary, depth long, chars long, conv_id long, n_convs long, block long, ends array<long>"))
    first = lambda c: F.first(c, True)
    nodes = merged(pieces.where("ends IS NULL"), "node", "part", {"parent": first, "digest": first, "depth": first, "chars": first, "conv_id": F.min, "n_convs": F.sum})
    ends = pieces.where("ends IS NOT NULL").groupBy("node", "block").agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"))  # at most BLOCK ids
    nodes = cut(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "__part": F.floor(F.col("depth") / DEPTHS)})
    # the lower end of a path that belongs to one conversation, summed from its leaf up
    in_part = nodes.groupBy("conv_id", "__part").agg(F.sum("saved").alias("s"), F.sum("n_leaves").alias("l"), F.min("depth").alias("top"))
    deeper = Window.partitionBy("conv_id").orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = in_part.select("conv_id", "__part", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"__{c}") for c in "sl"))
    up = Window.partitionBy("conv_id", "__part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumns({"saved": F.sum("saved").over(up), "n_leaves": F.sum("n_leaves").over(up)}).join(carry, ["conv_id", "__part"])
    nodes = nodes.withColumns({"saved": F.col("saved") + F.col("__s"), "n_leaves": F.col("n_leaves") + F.col("__l")}).drop("__s", "__l", "__part")
    totals = in_part.groupBy("conv_id").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), (F.min("top") - 1).alias("above"))
    above = ready.join(totals, "conv_id").where("start <= above").mapInArrow(_given, "node binary, part int, s long, l long")
    given = merged(cut(above), "node", "part", {"s": F.sum, "l": F.sum})
    nodes = nodes.join(given, "node", "left").withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0))})
    return nodes.select("node", "parent", "digest", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"), ends


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a conversation's own nodes have in all, for each node of its path above them, summed within the task."""
    part = TaskContext.get().partitionId()
    nodes: dict[bytes, list[int]] = {}

    def rows() -> pa.RecordBatch:
        keys, values = list(nodes), list(nodes.values())
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array([part] * len(keys), pa.int32()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=["node", "part", "s", "l"])

    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("own", "start", "digests", "a", "b", "s", "l", "above"))
        for own, start, digests, a, b, s, l, above in zip(*columns):  # noqa: E741
            state = (a & _MASK, b & _MASK)
            path = [_node(state)] if own == 0 else []
            path += [_node(x) for x in _steps(state, digests[: (above - start) * WIDTH])]
            for key in path:
                node = nodes.setdefault(key, [0, 0])
                node[0] += s
                node[1] += l
        if len(nodes) > HELD:
            yield rows()
            nodes.clear()
    yield rows()


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id, the parent's smallest member. A parent with a large share of all nodes is no key of a
    shuffle."""
    nodes = cut(nodes)
    of_key = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("times"))
    below = joined(nodes.where("parent IS NOT NULL"), of_key, "parent", nodes.count())
    return below.unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))


def with_texts(nodes: DataFrame, turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """nodes with role and text of their last turn (null for the root), by its digest."""
    times = nodes.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("times"))
    texts = turns.groupBy(digest(role_col, text_col).alias("digest")).agg(F.first(F.coalesce(role_col, F.lit(""))).alias("role"), F.first(F.coalesce(text_col, F.lit(""))).alias("text"))
    below = joined(nodes.where("digest IS NOT NULL"), texts.join(times, "digest"), "digest", nodes.count())
    return below.unionByName(nodes.where("digest IS NULL").withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}))


def ends_sha256(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of each node where a conversation ends: SHA-256 of the ids in order, with commas between. Nodes
    with one block of ends are hashed in place; the others' blocks go by a task in order, one after another."""
    blocks = ends.select("node", "block", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    one = blocks.groupBy("node").agg(F.count("*").alias("k"), F.first("ids").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != node:
                    done += [(node, sha.hexdigest())] if sha else []
                    node, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.record_batch([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])
            done = []
        if sha:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    several = blocks.join(one.where("k > 1").select("node"), "node").repartition("node").sortWithinPartitions("node", "block").select("node", "ids")
    return one.where("k = 1").select("node", F.sha2("ids", 256).alias("ends_sha256")).union(several.mapInArrow(run, "node binary, ends_sha256 string"))
