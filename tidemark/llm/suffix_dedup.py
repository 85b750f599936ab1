"""Removal of repeated byte strings, found with suffix arrays over shards of the corpus.

A string that occurs twice must lie with all its copies in one shard. Every window of 400 bytes therefore has an anchor
that its bytes alone decide: the least hash among its runs of 96 bytes. Windows that follow one another share an anchor
mostly; an anchor's context is the text of its windows. Contexts whose anchor occurs once in the corpus hold no repeat.
Of the others each different context goes once, with a mark if it has copies, to the shard that its anchor's hash names.
A shard sorts all suffixes of its contexts by induced sorting and takes the permuted common prefixes; a window is a
repeat if it shares 400 bytes with a neighbour in the array, or if its context has a copy. Contexts end in a byte that no
UTF-8 text has.

Texts go in groups of bounded bytes, and a group sends what it has once however often it occurs there. An anchor with
very many different contexts (a passage in a third of all texts, say) would make its shard grow with the corpus: its
windows are dealt out singly instead, by the hash of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from tidemark.llm.blocks import BASE, OTHER, PIECE, bucket_bounds, column_bytes, dealt, mixed, parts, powers
from tidemark.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH, ANCHOR = 400, 96
#: Different contexts of one anchor that a shard takes, and bytes that are sorted at a time.
MOST_CONTEXTS, SORTED = 2_000, 2 << 20
END = 0xFF
PARTIAL, WHOLE, SINGLE = 0, 1, 2


class _Block:
    """Texts or pieces of texts side by side, with sums that give the hash of any of their strings."""

    def __init__(self, held: list[tuple[int, int, bytes]]):
        self.held = held
        self.data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        self.offsets = np.cumsum([0, *(len(x) for _, _, x in held)])

    def sums(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        room = max(2 * PIECE, 1 << len(self.data).bit_length())
        values = (self.data + np.uint64(1)) * powers(base, room)[: len(self.data)]
        return np.r_[np.uint64(0), np.cumsum(values)], powers(pow(base, -1, 1 << 64), room)

    def anchors(self, length: int, anchor: int) -> tuple[np.ndarray, ...]:
        """For each run of windows with one anchor: piece, first window, number of windows, hashes of anchor and context."""
        n, spread = len(self.data), length - anchor + 1
        sizes = np.diff(self.offsets)
        starts = np.concatenate([np.arange(o, o + s - length + 1) for o, s in zip(self.offsets, sizes) if s >= length] or [np.empty(0, np.int64)])
        if not len(starts):
            return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        sums, inverse = self.sums(BASE)
        runs = mixed((sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1])
        low = np.uint64((1 << 24) - 1)
        least = (runs & ~low) | np.arange(len(runs), dtype=np.uint64)
        fill = -len(least) % spread
        rows = np.r_[least, np.full(fill, ~np.uint64(0))].reshape(-1, spread)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[starts], ahead[starts + spread - 1]) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        count = np.diff(np.r_[first, len(starts)])
        begin = starts[first]
        end = begin + count - 1 + length
        context = mixed((sums[end] - sums[begin]) * inverse[begin] + count.astype(np.uint64))
        key = mixed(runs[at[first]])  # least hashes are small; mixed again they spread over all shards
        return np.searchsorted(self.offsets, begin, "right") - 1, begin, count, key, context

    def windows(self, begin: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows of these runs, and 96 bits of hash of each."""
        at = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        out = []
        for base in (BASE, OTHER | 1):
            sums, inverse = self.sums(base)
            out.append(mixed((sums[at + length] - sums[at]) * inverse[at]))
        return at, out[0], (out[1] >> np.uint64(32)).astype("<u4")


def _blocks(texts: list[bytes], length: int) -> Iterator[_Block]:
    """All texts in blocks of about a PIECE; pieces of a long text overlap by a window less one byte."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[at : at + PIECE + length - 1]
            held.append((i, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield _Block(held)
                held, size = [], 0
    if held:
        yield _Block(held)


def _keys(texts: list[bytes], length: int, anchor: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The group's runs by block, and its different (anchor, context) hashes in order with whether each recurs here."""
    found = [(b, *b.anchors(length, anchor)) for b in _blocks(texts, length)]
    key, context = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in (4, 5))
    order = np.lexsort((context, key))
    key, context = key[order], context[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])][: len(key)])
    return found, key[new], context[new], np.diff(np.r_[new, len(key)]) > 1


def _parts(bounds: np.ndarray) -> list[slice]:
    return [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:])]


def _binary(values: np.ndarray, each: list[slice]) -> pa.Array:
    return pa.array([values[p].tobytes() for p in each], pa.binary())


def _anchors(table: pa.Table, length: int, anchor: int, buckets: int) -> pa.Table:
    """A group's different anchors and contexts, for each bucket of anchors."""
    _, key, context, again = _keys(table["data"].to_pylist(), length, anchor)
    bucket, bounds = bucket_bounds(key, buckets)
    each = _parts(bounds)
    grp = pa.array(np.full(len(bucket), table["grp"][0].as_py(), np.int32))
    return pa.table({"bucket": pa.array(bucket), "grp": grp, "key": _binary(key, each), "context": _binary(context, each), "again": _binary(again.astype(np.uint8), each)})


class _Judged:
    """What a bucket's anchors show: per entry, its context's number, and per context its times and its anchor's contexts."""

    def __init__(self, table: pa.Table):
        self.key, self.sizes = column_bytes(table, "key", "<u8")
        self.context, _ = column_bytes(table, "context", "<u8")
        again, _ = column_bytes(table, "again", np.uint8)
        order = np.lexsort((self.context, self.key))
        key, context = self.key[order], self.context[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])][: len(key)]
        number = np.cumsum(new) - 1
        self.number = np.empty(len(key), np.int64)
        self.number[order] = number
        self.times = np.bincount(number, 1 + again[order]).astype(np.int64)
        self.keys, self.contexts = key[new], context[new]
        fresh = np.r_[True, self.keys[1:] != self.keys[:-1]][: len(self.keys)]
        of_key = np.cumsum(fresh) - 1
        self.different = np.bincount(of_key)[of_key] if len(of_key) else of_key
        #: Whether all of the anchor's contexts have copies: then all of their windows repeat, and none need be sorted.
        self.copied = np.minimum.reduceat(self.times, np.flatnonzero(fresh))[of_key] > 1 if len(of_key) else fresh
        self.first = np.zeros(len(key), bool)  # the entry that speaks for its context
        self.first[np.unique(self.number, return_index=True)[1]] = True


def _codes(table: pa.Table) -> pa.Table:
    """For each group and entry: 1 to send the context, 2 to send its windows singly; and 4 if the context has a copy."""
    x = _Judged(table)
    several = (x.different[x.number] > 1) & ~x.copied[x.number]
    hot = several & (x.different[x.number] > MOST_CONTEXTS)
    codes = ((several & ~hot & x.first) + 2 * hot + 4 * (x.times[x.number] > 1)).astype(np.uint8)
    return pa.table({"grp": table["grp"], "bucket": table["bucket"], "codes": _binary(codes, _parts(np.r_[0, np.cumsum(x.sizes)]))})


SENT = "bucket int, kind int, grp int, key binary, context binary, count binary, data binary"


def _sent(table: pa.Table, codes: pa.Table, length: int, anchor: int, buckets: int) -> pa.Table:
    """The contexts that a group sends to shards, and the single windows of anchors with very many contexts."""
    rows = {n: [] for n in ("bucket", "kind", "grp", "key", "context", "count", "data")}
    if codes.num_rows and table.num_rows:
        grp = table["grp"][0].as_py()
        found, key, context, _ = _keys(table["data"].to_pylist(), length, anchor)
        bucket, bounds = bucket_bounds(key, buckets)
        by = dict(zip(codes["bucket"].to_pylist(), codes["codes"].to_pylist()))
        code = np.concatenate([np.frombuffer(by[b], np.uint8) for b in bucket.tolist()])
        if (code & 3).any():
            left = (code & 1) > 0
            out, singles = {}, []
            for block, _, begin, count, k, c in found:
                at = _spot(key, context, k, c)
                for i in np.flatnonzero(left[at]):
                    if left[at[i]]:  # once a group
                        left[at[i]] = False
                        out[int(at[i])] = (int(count[i]), block.data[begin[i] : begin[i] + count[i] - 1 + length].tobytes())
                if (hot := (code[at] & 2) > 0).any():
                    singles.append(block.windows(begin[hot], count[hot], length)[1:])
            for b, p in zip(bucket.tolist(), _parts(bounds)):
                if chosen := [i for i in range(p.start, p.stop) if i in out]:
                    count = np.array([[out[i][0], len(out[i][1]), code[i] >> 2] for i in chosen], "<i4")
                    for n, v in zip(rows, (b, 0, grp, key[chosen].tobytes(), context[chosen].tobytes(), count.tobytes(), b"".join(out[i][1] for i in chosen))):
                        rows[n].append(v)
            if singles:
                high, low = (np.concatenate(x) for x in zip(*singles))
                order = np.lexsort((low, high))
                high, low = high[order], low[order]
                new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
                again = (np.diff(np.r_[new, len(high)]) > 1).astype("<i4")
                high, low = high[new], low[new]
                bucket, bounds = bucket_bounds(high, buckets)
                for b, p in zip(bucket.tolist(), _parts(bounds)):
                    for n, v in zip(rows, (b, SINGLE, grp, high[p].tobytes(), low[p].tobytes(), again[p].tobytes(), b"")):
                        rows[n].append(v)
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "grp": pa.int32()}
    return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in rows.items()})


def _spot(key: np.ndarray, context: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where each (k, c) is in the ordered pairs (key, context); len(key) if it isn't there."""
    at, last = np.searchsorted(key, k), np.searchsorted(key, k, "right")
    out = np.full(len(k), len(key))
    while (live := np.flatnonzero((out == len(key)) & (at < last))).size:
        hit = live[context[at[live]] == c[live]]
        out[hit] = at[hit]
        at[live] += 1
    return out


def _repeated_windows(texts: list[bytes], counts: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the contexts occur in two of them; all contexts' windows one after another."""
    joined = np.frombuffer(b"".join(t + bytes([END]) for t in texts), np.uint8)
    sa = suffix_array(joined.astype(np.uint16) + 1, length)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    before, shared = permuted_prefixes(joined, sa, 2 * length, starts)  # a context has fewer windows than `length`
    repeat = np.zeros(len(joined), bool)
    hits = np.flatnonzero(shared >= length)
    repeat[hits] = True
    repeat[before[hits]] = True
    at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    return repeat[at]


def _shard(table: pa.Table, sent: pa.Table, length: int, anchor: int) -> pa.Table:
    """For each group: contexts that repeat as a whole, those that do in part with a bit for each window, single windows."""
    out: list[tuple[int, int, bytes, bytes, bytes]] = []
    width = -(-(length - anchor + 1) // 8)
    contexts = sent.filter(pa.compute.equal(sent["kind"], 0))
    key, sizes = column_bytes(contexts, "key", "<u8")
    context, _ = column_bytes(contexts, "context", "<u8")
    counts, _ = column_bytes(contexts, "count", "<i4")
    counts = counts.reshape(-1, 3)
    data = b"".join(contexts["data"].to_pylist())
    ends = np.cumsum(counts[:, 1])
    order = np.lexsort((context, key))  # an anchor's contexts side by side
    bits = np.zeros((len(key), width), np.uint8)
    i = 0
    while i < len(order):
        j, held = i, 0
        while j < len(order) and (held < SORTED or key[order[j]] == key[order[j - 1]]):
            held += counts[order[j], 1]
            j += 1
        some = order[i:j]
        repeat = _repeated_windows([data[ends[s] - counts[s, 1] : ends[s]] for s in some], counts[some, 0], length)
        for s, r in zip(some, np.split(repeat, np.cumsum(counts[some, 0])[:-1])):
            bits[s] = np.r_[x := np.packbits(r | (counts[s, 2] > 0)), np.zeros(width - len(x), np.uint8)]
        i = j
    if table.num_rows:
        x = _Judged(table)
        whole = x.copied
        at = _spot(key[order], context[order], x.keys, x.contexts)
        partial = np.zeros(len(x.keys), bool)
        partial[at < len(key)] = bits[order[at[at < len(key)]]].any(axis=1)
        for grp, p in zip(table["grp"].to_pylist(), _parts(np.r_[0, np.cumsum(x.sizes)])):
            number = x.number[p]
            if (w := whole[number]).any():
                out.append((grp, WHOLE, x.key[p][w].tobytes(), x.context[p][w].tobytes(), b""))
            if (w := partial[number]).any():
                out.append((grp, PARTIAL, x.key[p][w].tobytes(), x.context[p][w].tobytes(), bits[order[at[number[w]]]].tobytes()))
    single = sent.filter(pa.compute.equal(sent["kind"], SINGLE))
    high, sizes = column_bytes(single, "key", "<u8")
    low, _ = column_bytes(single, "context", "<u4")
    again, _ = column_bytes(single, "count", "<i4")
    order = np.lexsort((low, high))
    same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    repeat = again > 0
    repeat[order[1:]] |= same
    repeat[order[:-1]] |= same
    for grp, p in zip(single["grp"].to_pylist(), _parts(np.r_[0, np.cumsum(sizes)])):
        if (r := repeat[p]).any():
            out.append((grp, SINGLE, high[p][r].tobytes(), low[p][r].tobytes(), b""))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(("grp", "kind", "key", "context", "bits"), kinds))})


def _ordered(answers: pa.Table, kind: int, low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    some = answers.filter(pa.compute.equal(answers["kind"], kind))
    key, _ = column_bytes(some, "key", "<u8")
    context, _ = column_bytes(some, "context", low)
    order = np.lexsort((context, key))
    return key[order], context[order], order, some


def _spans(texts: list[bytes], answers: pa.Table, length: int, anchor: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, where its maximal removed runs begin and end."""
    places: list[list[np.ndarray]] = [[] for _ in texts]
    whole, partial, single = (_ordered(answers, k, kind) for k, kind in ((WHOLE, "<u8"), (PARTIAL, "<u8"), (SINGLE, "<u4")))
    bits = np.frombuffer(b"".join(partial[3]["bits"].to_pylist()), np.uint8).reshape(len(partial[0]), -1) if len(partial[0]) else None
    for block in _blocks(texts, length) if answers.num_rows else ():
        _, begin, count, key, context = block.anchors(length, anchor)
        marked = np.zeros(len(block.data), bool)
        settled = np.zeros(len(begin), bool)
        if len(whole[0]):
            settled = _spot(*whole[:2], key, context) < len(whole[0])
            edge = np.zeros(len(block.data) + 1, np.int32)
            edge[begin[settled]] += 1
            np.add.at(edge, begin[settled] + count[settled], -1)
            marked |= np.cumsum(edge[:-1]) > 0
        if bits is not None:
            at = _spot(*partial[:2], key, context)
            known = np.flatnonzero(at < len(partial[0]))
            run, place = np.nonzero(np.unpackbits(bits[partial[2][at[known]]], axis=1))  # bits past a run's count are 0
            marked[begin[known[run]] + place] = True
        if len(single[0]) and not settled.all():
            at, high, low = block.windows(begin[~settled], count[~settled], length)
            marked[at[_spot(single[0], single[1], high, low) < len(single[0])]] = True
        hits = np.flatnonzero(marked)
        cuts = np.searchsorted(hits, block.offsets)
        for o in np.flatnonzero(np.diff(cuts)):
            i, offset, _ = block.held[o]
            places[i].append(hits[cuts[o] : cuts[o + 1]] - block.offsets[o] + offset)
    out = []
    for found in places:
        at = np.concatenate(found) if found else np.empty(0, np.int64)
        gap = np.flatnonzero(np.diff(at) > length)
        out.append((at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]] + length) if len(at) else (at, at))
    return out


def _kept(table: pa.Table, answers: pa.Table, length: int, anchor: int, with_text: bool) -> pa.Table:
    texts, rows = table["data"].to_pylist(), []
    for text, (begin, end) in zip(texts, _spans(texts, answers, length, anchor)):
        kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)])) if len(begin) else text
        rows.append((len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    kinds = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))
    return pa.table({"id": table["id"]} | {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds[: 4 + with_text])})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for each row.

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in this text or another; strings
    never cross texts and are judged on the input. Null counts as empty; a text shorter than `length` keeps all; a
    repeated row is another text, so it counts.
    """
    texts, groups = dealt(docs, id_col, text_col)
    kind = texts.schema["id"].dataType.simpleString()
    by_group = texts.groupBy("grp")
    anchors = by_group.applyInArrow(lambda t: _anchors(t, length, anchor, groups), "bucket int, grp int, key binary, context binary, again binary")
    anchors = anchors.repartition(parts(docs.sparkSession, groups), "bucket")  # as a bucket's work is more than its bytes tell
    codes = anchors.groupBy("bucket").applyInArrow(_codes, "grp int, bucket int, codes binary")
    sent = by_group.cogroup(codes.groupBy("grp")).applyInArrow(lambda t, c: _sent(t, c, length, anchor, groups), SENT)
    answers = anchors.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(lambda a, s: _shard(a, s, length, anchor), "grp int, kind int, key binary, context binary, bits binary")
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_group.cogroup(answers.groupBy("grp")).applyInArrow(lambda t, a: _kept(t, a, length, anchor, with_text), schema).withColumnRenamed("id", id_col)
