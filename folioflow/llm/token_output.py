"""Token-id output: documents are encoded, compressed by a Re-Pair grammar per block and written to shard files.

Documents are range-partitioned by doc_id; a task writes one shard file of blocks. In a block, pairs
of adjacent ids that are frequent are replaced by new symbols, again and again, until no pair is
frequent enough; the rules and their expansion lengths are stored, so any range of ids can be decoded
without the rest (`BlockReader.ids`). File names carry the attempt, and only files named in the
returned table count, so lost executors and repeated tasks leave stray files but no wrong result.

Shard file, little-endian: b"FFRP0001", then blocks; each block is a header of nine uint64 (bytes that
follow, documents, ids, rules, symbols, symbol width 2 or 4, first rule's symbol, two spare), doc ids (int64),
null flags (uint8, padded to 8), ids per document (uint32), rules (two uint32 each), expansion lengths
(uint32) and the symbol sequence.

Defined results: null and empty texts are the end id alone; a null doc_id comes first; rows that share
a doc_id lie in order of their text's hash; an empty table gives no files and an empty result; doc_id and
text alone are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, ship, shuffle_partitions, staged

MAGIC = b"FFRP0001"
BLOCK_IDS = 1 << 19
#: A pair is replaced while it is at least this frequent in its block; a rule costs 12 bytes and saves 2 a use.
MIN_COUNT = 8
MEMO_LIMIT = 1_300_000
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0x2C1B3C6D], np.uint32)
_encoders: dict = {}
#: The signs that byte-level vocabularies write bytes as: printable Latin-1 as itself, the rest from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class Encoder:
    """Encodes texts by the tokenizers library, each different run between spaces once.

    The vocabulary's own first step splits at white space, so runs between space, tab and newline are encoded apart
    and give the same ids as the whole text. The memo is bounded: once full it stays as it is, and runs it doesn't
    have are encoded for the call at hand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.memo, self.used, self.n = Tokenizer.from_file(path), {}, 0, 0
        self.flat, self.starts, self.lens = np.empty(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.model, self.marks = self.tok.model, {}
        self._add([""])
        self.marks = {m: self.tok.encode(m, add_special_tokens=False).ids[0] for m in ".,"}

    def _word(self, core: str) -> list[int]:
        """Ids of a lower-case word of Latin-1 letters: one piece for the library's model, its bytes as the model's signs."""
        if core.isascii():
            return [t.id for t in self.model.tokenize(core)]
        return [t.id for t in self.model.tokenize(core.encode().decode("latin-1").translate(_BYTE_SIGNS))]

    def _coded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each run has. Plain words skip the vocabulary's first steps, which only lower them, and
        a full stop or comma after a word is a piece of its own; all other runs take those steps."""
        out, other = [None] * len(runs), []
        for k, run in enumerate(runs):
            core, last = run.lower(), None
            if core[-1:] in self.marks:
                core, last = core[:-1], self.marks[core[-1]]
            if not (core.isalpha() and (core.isascii() or max(core) <= "\xff") and len(core) == len(run) - (last is not None)):
                other.append(k)
                continue
            at = self.memo.get(core)
            ids = self.flat[self.starts[at] : self.starts[at] + self.lens[at]].tolist() if at is not None else self._word(core)
            out[k] = ids if last is None else [*ids, last]
        if other:
            for k, e in zip(other, self.tok.encode_batch_fast([runs[k] for k in other], add_special_tokens=False), strict=True):
                out[k] = e.ids
        lens = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(lens.sum())), lens

    def _add(self, runs: list[str]) -> None:
        ids, lens = self._coded(runs)
        k = len(runs)
        while self.n + k > len(self.lens):
            self.starts, self.lens = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.lens))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + k], self.lens[self.n : self.n + k] = self.used + np.cumsum(lens) - lens, lens
        self.memo.update(zip(runs, range(self.n, self.n + k), strict=True))
        self.used, self.n = self.used + len(ids), self.n + k

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and how many each text has."""
        # a text of Latin-1 is lowered as a whole, as the vocabulary does sign by sign; so fewer runs differ
        split = [(t.lower() if t.isascii() or max(t) <= "\xff" else t).replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        runs = list(chain.from_iterable(split))
        at = np.fromiter(map(self.memo.get, runs, repeat(-1)), np.int64, len(runs))
        missing = np.flatnonzero(at < 0)
        flat, starts, lens_of = self.flat, self.starts, self.lens
        if len(missing):
            words = [runs[i] for i in missing.tolist()]
            new = list(dict.fromkeys(words))
            if self.n < MEMO_LIMIT:
                self._add(new)
                at[missing] = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
                flat, starts, lens_of = self.flat, self.starts, self.lens
            else:
                ids, lens = self._coded(new)
                place = dict(zip(new, range(self.n, self.n + len(new)), strict=True))
                at[missing] = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                flat = np.concatenate([flat[: self.used], ids])
                starts, lens_of = np.concatenate([starts[: self.n], self.used + np.cumsum(lens) - lens]), np.concatenate([lens_of[: self.n], lens])
        lens = lens_of[at]
        before = np.concatenate([[0], np.cumsum(lens)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        per_doc = before[edges[1:]] - before[edges[:-1]]
        total = int(before[-1])
        # one gather for all: the start of each run's ids, stepped along
        ids = flat[np.repeat(starts[at] - before[:-1], lens) + np.arange(total)]
        out, stops, mask = np.empty(total + len(texts), np.uint32), np.cumsum(per_doc + 1) - 1, np.ones(total + len(texts), bool)
        mask[stops] = False
        out[mask], out[stops] = ids, end
        return out, per_doc + 1


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 20-bit hash of each pair."""
    h = (a * _MIX[0]) ^ (b * _MIX[1])
    h ^= h >> np.uint32(15)
    h *= _MIX[2]
    return h >> np.uint32(12)


def re_pair(ids: np.ndarray, first: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, expansion lengths) of a sequence; new symbols count up from first.

    A pass counts pairs of adjacent symbols and replaces every frequent one: where two such pairs overlap, the more
    frequent one; within a run of one pair, every other. A pair that comes out of that fewer than half of min_count times
    waits for the next pass, unless all do. Passes go on until no pair stands min_count times. A pair can only become
    frequent by a new symbol, so from the second pass on only pairs with one, or frequent before, are counted.
    """
    seq, rules, lengths, n_rules = ids.astype(np.uint32), [], [], 0
    length_of = np.ones(first, np.uint32)
    places = np.arange(max(len(seq) - 1, 0))
    while len(places):
        a, b = seq[places], seq[places + 1]
        keys = a.astype(np.uint64) << np.uint64(32) | b
        order = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        n = np.diff(np.append(starts, len(order)))
        often = n >= min_count
        if not often.any():
            break
        pairs, n = order[starts[often]], n[often]
        pairs = pairs[np.argsort(-n, kind="stable")]  # place in this order is rank
        pa, pb = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        # ranks are looked up by hash; of pairs with one hash the more frequent one has the place, the others wait for the next pass
        slots = np.zeros(1 << 20, np.int32)
        own, slot = _slot(pa, pb), _slot(a, b)
        slots[own[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        rank = slots[slot]
        hit = pairs[rank] == keys
        at, rank = places[hit], rank[hit]
        none, near = np.int32(len(pairs)), np.diff(at) == 1
        same = near & (rank[1:] == rank[:-1])
        if same.any():  # in a run of one pair every other place stays
            k = np.arange(len(rank))
            first_of_run = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), k, 0))
            rank = np.where((k - first_of_run) & 1 == 1, none, rank)
        before = np.concatenate([[none], np.where(near, rank[:-1], none)])
        after = np.concatenate([np.where(near, rank[1:], none), [none]])
        wins = (rank < before) & (rank < after)
        chosen, picked = at[wins], rank[wins]
        times = np.bincount(picked, minlength=len(pairs))
        used = np.flatnonzero(times * 2 >= min_count)
        if not len(used):
            used = np.flatnonzero(times)[:1]
        new_symbol = np.zeros(len(pairs), np.uint32)
        new_symbol[used] = first + n_rules + np.arange(len(used), dtype=np.uint32)
        symbols = new_symbol[picked]
        chosen, symbols = chosen[symbols > 0], symbols[symbols > 0]
        made = np.stack([pa[used], pb[used]], 1)
        rules.append(made)
        n_rules += len(used)
        length_of = np.concatenate([length_of, length_of[made[:, 0]] + length_of[made[:, 1]]])
        lengths.append(length_of[-len(used) :])
        # what may be frequent next: what was and stays, losers of a slot among it, and what touches a new symbol
        open_ = np.zeros(len(seq), bool)
        open_[at] = True
        lost = np.zeros(1 << 20, bool)
        lost[own[slots[own] != np.arange(len(pairs))]] = True
        open_[places[lost[slot]]] = True
        seq[chosen] = symbols
        keep = np.ones(len(seq), bool)
        keep[chosen + 1] = False
        seq, open_ = seq[keep], open_[keep]
        fresh = seq >= first + n_rules - len(used)
        open_[:-1] |= fresh[1:]
        open_ |= fresh
        places = np.flatnonzero(open_[:-1])
    empty = np.empty((0, 2), np.uint32)
    return seq, np.concatenate([empty, *rules]), np.concatenate([np.empty(0, np.uint32), *lengths])


def pack_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, first: int, min_count: int = MIN_COUNT) -> bytes:
    seq, rules, lengths = re_pair(ids, first, min_count)
    width = 2 if first + len(rules) <= 65536 else 4
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join([
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), null.tobytes().ljust(-(-len(null) // 8) * 8, b"\0"), counts.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes(),
    ])
    return struct.pack("<9Q", len(body), len(doc_ids), len(ids), len(rules), len(seq), width, first, 0, 0) + body


class BlockReader:
    """A block's documents and ids, whole or any range of them."""

    def __init__(self, header: bytes, body: bytes):
        _, n_docs, self.n_ids, n_rules, n_seq, width, self.first, *_ = struct.unpack("<9Q", header)
        at = 0

        def part(kind: str, n: int, pad: int = 0) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes + pad
            return got

        self.doc_ids, self.null = part("<i8", n_docs), part("u1", n_docs, -n_docs % 8)
        self.counts, self.rules = part("<u4", n_docs), part("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths, self.seq = part("<u4", n_rules), part(f"<u{width}", n_seq).astype(np.int64)
        self.ends = np.cumsum(self._length(self.seq))

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.first
        out[big] = self.lengths[symbols[big] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Replaces symbols by their rules, the newest layer first, until only ids are left."""
        while len(self.rules):
            big = symbols >= self.first
            if not big.any():
                break
            steps = 1 + big.astype(np.int64)
            at = np.cumsum(steps) - steps
            out = np.empty(int(steps.sum()), np.int64)
            out[at] = symbols
            pair = self.rules[symbols[big] - self.first]
            out[at[big]], out[at[big] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols.astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        """All ids of the block: the rules are expanded once, and the sequence is gathered from them."""
        of_rules = self.expand(np.arange(self.first, self.first + len(self.rules)))
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), of_rules])
        rule_starts = self.first + np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        start_of = np.concatenate([np.arange(self.first), rule_starts])
        lens = self._length(self.seq)
        return flat[np.repeat(start_of[self.seq] - (self.ends - lens), lens) + np.arange(self.n_ids)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1 of the block; only the symbols that cover them are expanded."""
        a, b = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, stop, "left")) + 1
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.seq[a:b])[start - before : stop - before]


def read_blocks(stream) -> Iterator[BlockReader]:
    if bytes(stream.read(8)) != MAGIC:
        raise ValueError("not a shard file")
    while header := bytes(stream.read(72)):
        yield BlockReader(header, bytes(stream.read(struct.unpack_from("<Q", header)[0])))


def _writer(folder: str, tokenizer: str, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        enc, out, name, total, docs = encoder(tokenizer), None, f"shard-{part:06d}-{uuid.uuid4().hex}.ffrp", 0, 0
        first = max(enc.tok.get_vocab_size(with_added_tokens=True), end + 1)
        ids, counts, waiting, n = [], [], [], 0

        def flush() -> None:
            nonlocal out, ids, counts, waiting, n, total, docs
            if waiting:
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(MAGIC)
                out.write(pack_block(waiting, np.concatenate(counts), np.concatenate(ids), first))
                total, docs = total + n, docs + len(waiting)
            ids, counts, waiting, n = [], [], [], 0

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 256):  # a few texts at a time, so memory follows the block
                got, lens = enc.encode(texts[at : at + 256], end)
                ids.append(got)
                counts.append(lens)
                waiting += keys[at : at + 256]
                n += len(got)
                if n >= block_ids:
                    flush()
        flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [part], "file": [name], "docs": [docs], "ids": [total]}, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, shards: int | None = None, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as shard files in folder, in ascending id order; returns (shard, file, docs, ids), the files that count."""
    spark = docs.sparkSession
    ship(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    laid = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return staged(laid.mapInArrow(_writer(folder, tokenizer, end_id, block_ids), "shard int, file string, docs long, ids long"), "token-files")


def read_tokens(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the files alone."""
    ship(spark)
    listed = sorted((r["shard"], r["file"], r["ids"]) for r in files.collect())  # one row per shard file
    jobs, start = [], 0
    for shard, file, n in listed:
        jobs.append((shard, file, start))
        start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for file, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}") as stream:
                    for b in read_blocks(stream):
                        ids = b.all_ids().astype("<u4", copy=False)
                        stops = np.cumsum(b.counts.astype(np.int64))
                        starts = stops - b.counts
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
                        keys = pa.array(b.doc_ids, mask=b.null.astype(bool))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(at + starts), pa.array(b.counts.astype(np.int64)), pa.array(crc, pa.int64())], schema=schema)
                        at += len(ids)

    spread = spark.createDataFrame(jobs, "shard int, file string, at long").repartition(max(1, len(jobs)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1))
