"""Repeated strings by suffix arrays, built by induced sorting shard by shard.

A byte goes if it is covered by a string of `length` bytes that also starts anywhere
else. Every such string is routed by its anchor, the window inside it with the
smallest hash, so equal strings meet. Strings that share an anchor lie side by side in
a text and travel as one segment. Anchors seen once, and all but one of equal
segments, need no sorting. What is left is dealt to shards; each shard sorts the
suffixes of its segments by induction and takes the permuted common prefixes.

Equal texts are one text to the search, and all of it goes if they are long enough.

Defined results: a null text is empty; texts shorter than `length` keep every byte; rows
repeated with the same doc_id are documents of their own; an empty table gives no rows;
other columns are ignored. Hashes only route strings and collapse equal segments and
texts (64 bits each); what a shard reports has been compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import flat, mix, plain, prefix_hash, signed, slices, span_hash, stored

LENGTH, ANCHOR = 200, 64
SHARD_BYTES, HOT_BYTES = 3_000_000, 6_000_000


# ---- suffix sorting ------------------------------------------------------------


def _spread(values: np.ndarray, chars: np.ndarray, head: np.ndarray, out: np.ndarray, step: int) -> None:
    """Append values to the buckets of their characters, in order, from each bucket's head in direction `step`."""
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    count = np.bincount(sorted_chars, minlength=len(head))
    first = np.cumsum(count) - count
    out[head[sorted_chars] + step * (np.arange(len(order)) - first[sorted_chars])] = values[order]
    head += step * count


def _induce(text: np.ndarray, falls: np.ndarray, edges: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the marked (leftmost-smaller) ones in order.

    Buckets are visited by first character. Within one, suffixes that lead to the same
    bucket are followed round by round; each round is one vector operation.
    """
    n, size = len(text), len(edges) - 1
    out = np.full(n, -1, np.int64)
    head = edges[:-1].copy()
    chars = text[marks]
    at = np.searchsorted(chars, np.arange(size + 1))
    for c in range(size):
        if edges[c] == edges[c + 1]:
            continue
        done = edges[c]
        while True:
            turn = out[done : head[c]]
            done = head[c]
            if not len(turn):
                turn = marks[at[c] : at[c + 1]]
                last = True
            else:
                last = False
            before = turn - 1
            before = before[before >= 0]
            before = before[falls[before]]
            if len(before):
                _spread(before, text[before], head, out, 1)
            if last:
                break
    tail = edges[1:] - 1
    for c in range(size - 1, -1, -1):
        if edges[c] == edges[c + 1]:
            continue
        done = edges[c + 1] - 1
        while True:
            turn = out[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            last = not len(turn)
            if last:
                turn = out[edges[c] : head[c]][::-1]
            before = turn - 1
            before = before[before >= 0]
            before = before[~falls[before]]
            if len(before):
                _spread(before, text[before], tail, out, -1)
            if last:
                break
    out[0] = n - 1  # nothing stands after the last character to lead to it
    return out


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, told apart to at least `depth` names, by doubling."""
    n, step = len(names), 1
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while step < depth:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    return order


def suffix_array(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Suffixes of `text` in order of their first `depth` characters at least.

    Characters are 0 … size-1; the last one is 0 and stands nowhere else. Classifies
    suffixes by whether they fall to the next character, sorts the leftmost-smaller
    substrings by induction, names them, orders the string of names, and induces all
    suffixes from that order.
    """
    n = len(text)
    change = np.sign(text[1:].astype(np.int64) - text[:-1])
    place = np.where(change != 0, np.arange(n - 1), n - 1)
    place = np.minimum.accumulate(place[::-1])[::-1]
    falls = np.zeros(n, bool)
    falls[:-1] = np.append(change, 1)[place] < 0
    marks = np.flatnonzero(~falls[1:] & falls[:-1]) + 1
    edges = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
    if len(marks) < 2:
        return _induce(text, falls, edges, marks)
    first = _induce(text, falls, edges, marks[np.argsort(text[marks], kind="stable")])
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    substrings = first[is_mark[first]]
    until = np.full(n, n, np.int64)
    until[marks[:-1]] = marks[1:] + 1
    running = prefix_hash((text & 0xFF).astype(np.uint8))
    other = prefix_hash((text >> 8).astype(np.uint8))
    ends = np.minimum(until[substrings], n)
    key = span_hash(running, substrings, ends) ^ mix(span_hash(other, substrings, ends))
    names = np.empty(n, np.int64)
    names[substrings] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    order = _ranked(names[marks], depth)
    return _induce(text, falls, edges, marks[order])


def repeated_starts(segments: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its strings of `length` bytes occur elsewhere in the segments."""
    sizes = np.asarray([len(s) for s in segments])
    text = np.ones(sizes.sum() + len(sizes) + 1, np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    for b, s in zip(base, segments, strict=True):
        text[b : b + len(s)] = s.astype(np.int64) + 2
    text[-1] = 0
    order = suffix_array(text, 258, length)
    valid = np.zeros(len(text), bool)
    for b, s in zip(base, sizes, strict=True):
        valid[b : b + max(0, s - length + 1)] = True
    order = order[valid[order]]
    # Permuted common prefixes: each place with the one before it in suffix order. A common
    # prefix is one shorter at the next place, so only where a run of neighbours begins is
    # the whole string compared; within the run one byte each.
    phi = np.full(len(text), -1, np.int64)
    phi[order[1:]] = order[:-1]
    running = prefix_hash(np.where(text > 1, text - 2, 0).astype(np.uint8))
    at = np.flatnonzero(phi >= 0)
    at = at[span_hash(running, at, at + length) == span_hash(running, phi[at], phi[at] + length)]
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (phi[at[1:]] != phi[at[:-1]] + 1)
    right = text[at + length - 1] == text[phi[at] + length - 1]
    heads = at[begins]
    span = np.arange(length)
    for a in range(0, len(heads), 10_000):
        h = heads[a : a + 10_000]
        right[np.flatnonzero(begins)[a : a + 10_000]] = (text[h[:, None] + span] == text[phi[h][:, None] + span]).all(axis=1)
    run = np.cumsum(begins) - 1
    bad = np.zeros(run[-1] + 1 if len(run) else 0, bool)
    bad[run[~right]] = True  # a run with a false byte is not trusted beyond its hash: compare it whole
    for i in np.flatnonzero(bad[run]) if len(run) else []:
        right[i] = bool((text[at[i] + span] == text[phi[at[i]] + span]).all())
    hit = np.zeros(len(text), bool)
    hit[at[right]] = True
    hit[phi[at[right]]] = True
    return [hit[b : b + max(0, s - length + 1)] for b, s in zip(base, sizes, strict=True)]


# ---- segments ------------------------------------------------------------------


def _anchored(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Segments of a batch: row, start, number of strings, place of the anchor after the start, hashes of anchor and segment."""
    reach, n = length - anchor + 1, len(data)
    if n < length:
        return None
    running = prefix_hash(data)
    at = np.arange(n - anchor + 1)
    hashes = span_hash(running, at, at + anchor)
    key = (hashes & np.uint64(0xFFFFFFFFFFC00000)) | at.astype(np.uint64)
    pad = -len(key) % reach
    table = np.concatenate([key, np.full(pad + reach, ~np.uint64(0))]).reshape(-1, reach)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    where = (np.minimum(back[starts], ahead[starts + reach - 1]) & np.uint64(0x3FFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[row + 1]
    starts, where, row = starts[inside], where[inside], row[inside]
    if not len(starts):
        return None
    cut = np.flatnonzero((np.diff(where) != 0) | (np.diff(starts) != 1) | (np.diff(row) != 0)) + 1
    first = np.concatenate([[0], cut])
    count = np.diff(np.append(first, len(starts)))
    start, pos = starts[first], where[first]
    segment = span_hash(running, start, start + count + length - 1)
    return row[first], start, count, pos - start, hashes[pos], segment


SEGMENT = "h bigint, tid bigint, start bigint, n int, off int, seg bigint"


def _segments(length: int, anchor: int):
    names = ["h", "tid", "start", "n", "off", "seg"]
    limit = 1 << 21

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            fresh = []
            for i, t in enumerate(batch.column("tid").to_pylist()):
                if t not in seen:
                    fresh.append(i)
                    if len(seen) < 1_000_000:
                        seen.add(t)
            batch = batch.take(pa.array(fresh, pa.int64()))
            data, offsets = flat(batch.column("text"))
            tids = batch.column("tid").to_numpy()
            parts = [(data, offsets, tids, 0)]
            if len(data) > limit:  # long texts go piece by piece; pieces overlap by a string less one byte
                parts = [
                    (data[a : min(a + limit + length - 1, end)], np.asarray([0, min(limit + length - 1, end - a)]), tids[i : i + 1], a - start)
                    for i, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                    for a in range(start, end, limit)
                ]
            for piece, bounds, ids, base in parts:
                found = _anchored(piece, bounds, length, anchor)
                if found is None:
                    continue
                row, start, count, off, h, seg = found
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(h)), pa.array(ids[row]), pa.array(start - bounds[row] + base), pa.array(count.astype(np.int32)),
                        pa.array(off.astype(np.int32)), pa.array(signed(seg)),
                    ],
                    names,
                )

    return run


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Adds whether a segment has an equal one (`twin`) and whether it is to be sorted (`rival`).

    Within an anchor, segments stand in order of content. Where the anchor has several
    contents, the rows beside a change of content stand for theirs.
    """
    order = Window.partitionBy("h").orderBy("off", "seg", "tid", "start")
    content = F.struct("off", "seg")
    rows = rows.withColumn("before", F.lag(content).over(order)).withColumn("after", F.lead(content).over(order))
    equal = [F.col(c) == content for c in ("before", "after")]
    no = F.lit(False)
    rows = rows.withColumn("twin", F.coalesce(equal[0], no) | F.coalesce(equal[1], no))
    rows = rows.withColumn("rival", F.coalesce(~equal[0], no) | F.coalesce(~equal[1], no))
    return rows.drop("before", "after")


def _cut(length: int):
    """The bytes of the wanted segments of each text."""

    def run(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            lists = batch.column("wanted")
            made = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            start = offsets[row] + made.field("start").to_numpy()
            end = start + made.field("n").to_numpy() + length - 1
            pieces = pa.array([data[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary())
            arrays = [made.field(c) for c in ("h", "start", "n", "off")]
            yield pa.RecordBatch.from_arrays([batch.column("tid").take(pa.array(row)), *arrays, pieces], ["tid", "h", "start", "n", "off", "piece"])

    return run


PIECE = "tid bigint, h bigint, start bigint, n int, off int, piece binary"


def _narrowed(length: int, anchor: int, level: int):
    """Segments cut at fixed distances from the anchor; each part is keyed by the bytes all its strings share."""
    width = -(-(length - anchor + 1) >> level)

    def run(batches):
        for batch in slices(batches, "piece"):
            columns = [batch.column(c).to_pylist() for c in ("tid", "h", "start", "n", "off", "piece")]
            rows = []
            for tid, h, start, n, off, piece in zip(*columns, strict=True):
                # String j of the segment starts off - j bytes before the anchor.
                for part in range(max(0, off - n + 1) // width, off // width + 1):
                    first, last = max(0, off - (part + 1) * width + 1), min(n - 1, off - part * width)
                    if first > last:
                        continue
                    low, high = off - part * width, max(off - (part + 1) * width + 1, off - (length - anchor))
                    common = piece[max(low, 0) : high + length]
                    key = hashlib.blake2b(common + f"{h} {level} {part}".encode(), digest_size=8).digest()
                    body = piece[first : last + length]
                    rows.append(
                        {
                            "h": int.from_bytes(key, "little", signed=True), "tid": tid, "start": start + first, "n": last - first + 1,
                            "off": off - first, "seg": int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True),
                            "piece": body,
                        }
                    )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("h", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("seg", pa.int64()), ("piece", pa.binary())]
    )
    return run


def _shard(length: int):
    """Sorts one shard; gives runs of string starts that occur elsewhere in it."""

    def run(shard: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(p.as_py(), np.uint8) for p in shard.column("piece")]
        tids, starts = shard.column("tid").to_pylist(), shard.column("start").to_pylist()
        out: dict[str, list] = {"tid": [], "start": [], "n": []}
        for tid, start, hit in zip(tids, starts, repeated_starts(pieces, length), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                out["tid"].append(tid)
                out["start"].append(start + a)
                out["n"].append(b - a)
        return pa.table(out, pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("n", pa.int32())]))

    return run


def repeated_strings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """tid, start, n: runs of starts of repeated strings in each distinct text, copies of whole texts aside.

    tid is `text_key` of the text; a run covers the bytes start … start + n + length - 2.
    """
    texts = docs.select(text_key().alias("tid"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_segments(length, anchor), SEGMENT).repartition("h")
    # A text read by several tasks gives its segments several times; they are one.
    rows = _sorted_out(rows.dropDuplicates(["h", "off", "seg", "tid", "start", "n"])).where("twin or rival")
    rows = stored(rows, "segments")
    found = rows.where("twin").select("tid", "start", "n")
    wanted = rows.where("rival").groupBy("tid").agg(F.collect_list(F.struct("h", "start", "n", "off")).alias("wanted"))
    whole = texts.groupBy("tid").agg(F.first("text").alias("text"))
    pieces = stored(whole.join(wanted, "tid").select("tid", "text", "wanted").mapInArrow(_cut(length), PIECE), "pieces")
    # An anchor with too many segments for one task is narrowed to parts that share more bytes, as often as needed.
    level = 0
    while True:
        load = pieces.groupBy("h").agg(F.sum(F.length("piece")).alias("bytes"))
        hot = load.where(F.col("bytes") > HOT_BYTES).select("h")
        hot = stored(hot, "hot")
        if level > (length - anchor).bit_length() or hot.isEmpty():
            break
        level += 1
        parts = pieces.join(hot, "h", "left_semi").mapInArrow(_narrowed(length, anchor, level), f"{SEGMENT}, piece binary")
        parts = stored(_sorted_out(parts).where("twin or rival"), "parts")
        found = found.unionByName(parts.where("twin").select("tid", "start", "n"))
        kept = pieces.join(hot, "h", "left_anti").select("tid", "h", "start", "n", "off", "piece")
        pieces = stored(kept.unionByName(parts.where("rival").select("tid", "h", "start", "n", "off", "piece")), "pieces")
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = pieces.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(max(1, -(-total // SHARD_BYTES)))))
    runs = shards.groupBy("shard").applyInArrow(_shard(length), "tid bigint, start bigint, n int")
    return found.unionByName(runs)


def text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    runs = repeated_strings(docs, length, anchor).groupBy("tid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    texts = plain(docs).withColumn("tid", text_key())
    copies = texts.groupBy("tid").count().where("count > 1").select("tid", F.lit(True).alias("copied"))
    facts = runs.join(copies, "tid", "full")
    rows = texts.join(facts, "tid", "left").select("doc_id", "text", "runs", F.coalesce("copied", F.lit(False)).alias("copied"))

    def run(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            out: list[list] = [[], [], [], [], []]
            for i, (runs, copied) in enumerate(zip(batch.column("runs").to_pylist(), batch.column("copied").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                size = len(text)
                step = np.zeros(size + 1, np.int64)
                if copied and size >= length:
                    step[0], step[size] = 1, -1
                elif runs:
                    start = np.asarray([r["start"] for r in runs])
                    np.add.at(step, start, 1)
                    np.add.at(step, start + np.asarray([r["n"] for r in runs]) + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
                kept = text[~gone].tobytes()
                for column, value in zip(out, (size, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return rows.mapInArrow(run, form)
