"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words block by block; each block keeps its distinct words and,
per document, the positions of its words in that list. The words of all blocks meet
by word, each distinct word is encoded once, and its ids go back to the blocks, where
they are laid out by position. Texts do not move, only positions and distinct words
do; blocks are of bounded size. Decoding joins ids with their pieces within each
task: the table of pieces is as large as the vocabulary and goes to every task.

Defined results: a null or empty text has no ids and decodes to the empty text; rows
repeated with the same doc_id are encoded each; a null doc_id is kept; an empty table
gives no rows; other columns are ignored. Strings of added tokens in a text become
those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from platewise.llm.common import flat, gathered, packed, partitions, plain, prefix_hash, slices, span_hash, unpacked

BLOCK_BYTES = 5_000_000
# The split pattern of the vocabulary's pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point the regex module and the library agree on every class; other texts are split by the library.
AGREED = 0x530


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _added(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _splitter(path: str):
    """A function from a text to its words; an added token is a word."""
    import regex

    find = regex.compile(SPLIT).findall
    far = regex.compile(f"[^\\x00-\\u{AGREED:04x}]").search
    own = _library(path).pre_tokenizer.pre_tokenize_str
    added = _added(path)
    apart = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def words(text: str) -> list[str]:
        if apart is not None and any(a in text for a in added):
            out: list[str] = []
            for part in apart.split(text):
                out.extend([part] if part in added else words(part))
            return out
        if far(text):
            return [text[a:b] for _, (a, b) in own(text)]
        return find(text)

    return words


def _blocks(path: str):
    """Rows of (block, doc_ids, sequence, words): a block's documents as positions in its list of distinct words."""

    def run(batches):
        words, pack = _splitter(path), zstandard.ZstdCompressor(3)
        first, made, schema = TaskContext.get().partitionId() << 32, 0, None

        def out():
            lengths = np.fromiter(map(len, known), np.uint32, len(known))
            row = {
                "block": first + made,
                "doc_ids": ids,
                "sequence": packed([np.asarray(counts), np.concatenate(where)], pack),
                "words": packed([lengths], pack),
                "letters": pack.compress(b"".join(known)),
            }
            return pa.RecordBatch.from_pylist([row], schema)

        ids, counts, where, known, size = [], [], [], {}, 0
        for batch in slices(batches, limit=BLOCK_BYTES // 4):
            if schema is None:
                binary = [(c, pa.binary()) for c in ("sequence", "words", "letters")]
                schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), *binary])
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                split = words(text)
                size += len(text)
                at = [known.get(w) for w in split]
                for i, place in enumerate(at):
                    if place is None:
                        at[i] = known.setdefault(split[i], len(known))
                ids.append(key)
                counts.append(len(split))
                where.append(np.asarray(at, np.uint32))
                if size >= BLOCK_BYTES:
                    known = [w.encode() for w in known]
                    yield out()
                    made += 1
                    ids, counts, where, known, size = [], [], [], {}, 0
        if ids:
            known = [w.encode() for w in known]
            yield out()

    return run


def _words_of(buckets: int):
    """The distinct words of each block, dealt to buckets by hash: bucket, block, places in the block's list, words."""

    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("letters", pa.binary())])
        for batch in batches:
            for row in range(batch.num_rows):
                (lengths,) = unpacked(batch.column("words")[row].as_py())
                letters = np.frombuffer(unpack.decompress(batch.column("letters")[row].as_py()), np.uint8)
                edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                bucket = (span_hash(prefix_hash(letters), edges[:-1], edges[1:]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                whole, ends = gathered(letters, edges, order)
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                ends, block = np.concatenate([[0], ends]), batch.column("block")[row].as_py()
                rows = [
                    {
                        "bucket": i,
                        "block": block,
                        "places": packed([np.diff(order[x:y], prepend=0), lengths[order[x:y]]], pack),
                        "letters": pack.compress(whole[ends[x] : ends[y]].tobytes()),
                    }
                    for i, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    if y > x
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _encoded_words(path: str):
    """Encodes each distinct word of a bucket once; gives packed (places, numbers of ids, ids) per block."""

    def run(bucket: pa.Table) -> pa.Table:
        library, pack, unpack = _library(path), zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        found = []
        for row in range(bucket.num_rows):
            places, lengths = unpacked(bucket.column("places")[row].as_py())
            letters = unpack.decompress(bucket.column("letters")[row].as_py())
            ends = np.cumsum(lengths, dtype=np.int64).tolist()
            at = [known.setdefault(letters[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            found.append((places, np.asarray(at, np.int64)))
        words, ids, sizes = list(known), [], []
        for start in range(0, len(words), 20_000):
            part = [w.decode() for w in words[start : start + 20_000]]
            for e in library.encode_batch(part, add_special_tokens=False):
                sizes.append(len(e.ids))
                ids.extend(e.ids)
        edges, ids = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.asarray(ids, np.uint32)
        entries = []
        for places, at in found:
            mine, _ = gathered(ids, edges, at)
            entries.append(packed([places, np.diff(edges)[at], mine], pack))
        return pa.table({"block": bucket.column("block"), "entries": pa.array(entries, pa.binary())})

    return run


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(path: str | None = None) -> pa.Array:
    """The bytes each id stands for, by id; as large as the vocabulary. An id in a gap stands for nothing."""
    path = path or default_path()
    byte_of, added = _byte_of(), set(_added(path))
    by_id = {i: t.encode() if t in added else bytes(byte_of[c] for c in t) for t, i in _library(path).get_vocab(True).items()}
    return pa.array([by_id.get(i, b"") for i in range(max(by_id) + 1)], pa.binary())


def _laid_out(block: pa.Table, entries: pa.Table) -> pa.Table:
    """Ids of each document of a block."""
    counts, sequence = unpacked(block.column("sequence")[0].as_py())
    parts = [unpacked(e.as_py()) for e in entries.column("entries")]
    local, count, ids = (
        np.concatenate([np.cumsum(p[0], dtype=np.int64) if i == 0 else p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3)
    )
    order = np.argsort(local)
    ids, _ = gathered(ids, np.concatenate([[0], np.cumsum(count, dtype=np.int64)]), order)
    edges = np.concatenate([[0], np.cumsum(count[order], dtype=np.int64)])
    found, ends = gathered(ids, edges, sequence)
    upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found.astype(np.int32)))
    return pa.table({"doc_id": block.column("doc_ids").combine_chunks().flatten(), "ids": lists})


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    path = path or default_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    form = f"block bigint, doc_ids array<{id_type}>, sequence binary, words binary, letters binary"
    # One exchange of the blocks serves both the words and the way back.
    blocks = plain(docs).mapInArrow(_blocks(path), form).repartition("block")
    buckets = 4 * partitions(docs.sparkSession)
    placed = blocks.mapInArrow(_words_of(buckets), "bucket bigint, block bigint, places binary, letters binary")
    entries = placed.groupBy("bucket").applyInArrow(_encoded_words(path), "block bigint, entries binary")
    return blocks.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(_laid_out, f"doc_id {id_type}, ids array<int>")


def _texts(lists: pa.Array, table: pa.Array) -> list[str]:
    """The text of each list of ids: ids joined with their pieces, invalid UTF-8 replaced."""
    lists = pc.fill_null(lists, []) if lists.null_count else lists
    ids = lists.flatten()
    known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table)))
    joined = table.take(pc.if_else(known, ids, pa.scalar(None, ids.type)))
    data, edges = flat(joined)
    upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    ends = edges[upto]
    return [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of any frame (doc_id, ids).

    Null ids give the empty text; an id outside the vocabulary stands for nothing.
    """
    table = pieces(path)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_texts(batch.column("ids"), table), pa.string())], ["doc_id", "text"]
            )

    id_type = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    table = pieces(path)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lists = batch.column("ids")
                ids, sizes = lists.flatten().to_numpy().astype("<u4"), lists.value_lengths().to_numpy()
                upto = np.concatenate([[0], np.cumsum(sizes)])
                shas = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                texts = [hashlib.sha256(t.encode()).hexdigest() for t in _texts(lists, table)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encoded(docs, path).mapInArrow(run, form)
