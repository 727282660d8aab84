"""LM scoring: the marginal likelihood of a text over all segmentations of its words into vocabulary pieces.

A text is its words and an end symbol, counted as a word. A word's probability is the sum over all its segmentations,
found by forward recursion in log space. The pieces are those of an existing public vocabulary and, each
standing for itself alone, the training words. All probabilities come from one fit by expectation-maximisation: it starts from
the vocabulary's own scores, which are merge ranks, as ranks of Zipf's law; the expected counts of each way to write a word,
weighted by the word's count, give the next probabilities, the whole words' counts being discounted (by the numbers of
words counted once and twice) in favour of the ways through public pieces. Characters outside the vocabulary go through its
byte pieces.

Texts of several languages are a mixture: each class of training documents has its own probabilities, and a text's
probability is the sum over the classes too, so its own class isn't read when it is scored. Classes beyond the MAX_CLASSES most frequent are one class.

Only counts move. Documents are reduced, a block of bounded size at a time, to the block's different words and each
document's (word number, count) pairs. Words are summed over all blocks, each different word is fitted and scored once,
and counts and scores go back to the blocks that asked; nothing of corpus size is collected or broadcast.

Defined results: null and blank texts are the end symbol alone; a null doc_id is hashed as the empty text; a null class is a class; rows are
scored each by itself, repeated rows alike; very long texts and words are scored whole; with no training text the public pieces have the
start's probabilities; an empty table gives an empty table; the id, the text and the class alone are read, whatever the names of other columns.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Own, discard, mix64, shared_path, ship, staged

BLOCK_TOKENS = 1 << 22
#: Words in a file of the word tables, whose work is heavy for their bytes.
WORDS_A_FILE = 25_000
#: Blocks whose answers come to one task.
BLOCKS_A_TASK = 2
#: Added to each piece's expected count, so that all pieces have some probability.
SMOOTHING = 0.05
#: The vocabulary's k-th piece starts with a weight of 1 / (k + ZIPF).
ZIPF = 10
ROUNDS = 3
MAX_CLASSES = 8
#: Cells of the arrays that a group of words takes, and the multiplier of the strings' hash.
_CELLS, _M = 1 << 21, 0x9E3779B97F4A7C15
_models: dict = {}


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def _pack(numbers: np.ndarray) -> tuple[bytes, int]:
    """The different numbers and their counts, in few bytes; and how many there are."""
    u, n = np.unique(numbers, return_counts=True)
    gaps = np.diff(u, prepend=0)
    wide, many = bool(len(gaps)) and int(gaps.max()) > 65535, bool(len(n)) and int(n.max()) > 255
    return bytes([wide, many]) + gaps.astype("<u4" if wide else "<u2").tobytes() + n.astype("<u4" if many else "u1").tobytes(), len(u)


def _unpack(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    gap = "<u4" if b[0] else "<u2"
    at = 2 + n * np.dtype(gap).itemsize
    return np.cumsum(np.frombuffer(b, gap, n, 2), dtype=np.int64), np.frombuffer(b, "<u4" if b[1] else "u1", n, at)


_BLOCKS = pa.schema([("block", pa.string()), ("word", pa.binary()), ("number", pa.int32()), ("trained", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("class", pa.int32()), ("n_tokens", pa.int64()), ("n_words", pa.int32()), ("counts", pa.binary())])


def _reduce(block_tokens: int, classes: int):
    """Documents to blocks: a row for each different word of the block, with its training count by class, and one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, docs, trained, held = _Numbers(), [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, n, m = uuid.uuid4().hex, len(numbers), len(docs)
            c = np.zeros((n, classes), np.int64)
            for k, some in trained.items():
                c[:, k] = np.bincount(np.concatenate(some), minlength=n)
            words = list(numbers)
            for at in range(0, n, 50_000):
                k = len(words[at : at + 50_000])
                none = [pa.nulls(k, f.type) for f in list(_BLOCKS)[4:]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * k), pa.array(words[at : at + k], pa.binary()), pa.array(np.arange(at, at + k, dtype=np.int32)), pa.ListArray.from_arrays(np.arange(0, k * classes + 1, classes, dtype=np.int32), c[at : at + k].ravel()), *none], schema=_BLOCKS)
            for at in range(0, m, 5_000):
                some = docs[at : at + 5_000]
                none = [pa.nulls(len(some), f.type) for f in list(_BLOCKS)[1:4]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), *none, *[pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), list(_BLOCKS)[4:], strict=True)]], schema=_BLOCKS)

        for batch in batches:
            for doc_id, kind, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ws = text.lower().split() if text else []
                x = np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))
                out = is_held_out(doc_id)
                if not out and len(x):
                    trained.setdefault(kind, []).append(x.astype(np.int32))
                packed, n = _pack(x)
                docs.append((doc_id, out, kind, len(ws) + 1, n, packed))
                held += len(ws) + 1
                if held >= block_tokens:
                    yield from flush()
                    numbers, docs, trained, held = _Numbers(), [], {}, 0
        if docs:
            yield from flush()

    return run


class Lattice:
    """The ways to write words in pieces, for many words of one length at a time.

    A word of n characters with the mark of a word's start has places 0 .. n. `ends[w, j, l - 1]` is the piece of l characters
    that ends at place j, and -1 where there's none. A character that is no piece itself is an extra piece, the sum of its bytes.
    """

    def __init__(self, pieces: list[str]):
        self.size, self.byte, by_length = len(pieces), np.zeros(256, np.int64), {}
        for k, piece in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x"):
                self.byte[int(piece[3:5], 16)] = k
            else:
                by_length.setdefault(len(piece), []).append(k)
        self.longest = max(by_length, default=1)
        keys, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for n, some in by_length.items():
            chars, h = self._chars([pieces[k] for k in some], n), np.zeros(len(some), np.uint64)
            for k in range(n):
                h = h * np.uint64(_M) + chars[:, k] + np.uint64(1)
            keys.append(mix64(h))
            numbers.append(np.array(some))
        keys, numbers = np.concatenate(keys), np.concatenate(numbers)
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], numbers[order]
        # most strings are no piece: a table of 20 bits of the hash tells so at once
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _chars(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)

    def ways(self, words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """ends, and the byte pieces of each extra piece."""
        n, longest = len(words[0]) + 1, min(self.longest, len(words[0]) + 1)
        chars = self._chars(["▁" + w for w in words], n)
        ends = np.full((len(words), n + 1, longest), -1, np.int64)
        h, used = np.zeros((len(words), n + 1), np.uint64), 1
        for k in range(1, longest + 1):
            h = h[:, : n - k + 1] * np.uint64(_M) + chars[:, k - 1 :] + np.uint64(1)
            mixed = mix64(h)
            row, at = np.nonzero(self.maybe[(mixed >> np.uint64(44)).astype(np.int64)])
            got = mixed[row, at]
            place = np.minimum(np.searchsorted(self.keys, got), len(self.keys) - 1)
            hit = self.keys[place] == got if len(self.keys) else np.zeros(len(got), bool)
            if hit.any():
                ends[row[hit], at[hit] + k, k - 1], used = self.numbers[place[hit]], k
        ends = ends[:, :, :used]  # most words have no long piece
        extra = []
        row, at = np.nonzero(ends[:, 1:, 0] < 0)
        if len(row):
            different, which = np.unique(chars[row, at], return_inverse=True)
            ends[row, at + 1, 0] = self.size + which
            extra = [self.byte[list(chr(int(c)).encode("utf-8", "surrogatepass"))].tolist() for c in different]
        return ends, extra

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[int]]]]:
        """(indices, ends, extra) for words of one length, in groups of bounded size."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths).tolist():
            at, most = np.flatnonzero(lengths == n), max(1, _CELLS // ((n + 2) * self.longest))
            for x in range(0, len(at), most):
                some = at[x : x + most]
                yield some, *self.ways([words[i] for i in some.tolist()])


def of_arcs(logp: np.ndarray, ends: np.ndarray, extra: list[list[int]]) -> np.ndarray:
    """log probability of each arc, -inf where there's none."""
    return np.concatenate([logp, [logp[b].sum() for b in extra], [-np.inf]])[ends]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials along the second axis; each row has a finite one."""
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def forward(arcs: np.ndarray) -> np.ndarray:
    """log of the sum over all ways from the start to each place, for each word."""
    n, longest = arcs.shape[1] - 1, arcs.shape[2]
    f = np.zeros((len(arcs), n + 1))
    for j in range(1, n + 1):
        m = min(longest, j)
        f[:, j] = _log_sum(f[:, j - m : j][:, ::-1] + arcs[:, j, :m])
    return f


def expected(ends: np.ndarray, arcs: np.ndarray, f: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Expected uses of each piece (extra ones last) over all ways to write the words, each word weight times."""
    n, longest = arcs.shape[1] - 1, arcs.shape[2]
    b = np.zeros((len(arcs), n + 1))
    k = np.arange(longest)
    for i in range(n - 1, -1, -1):
        m = min(longest, n - i)
        b[:, i] = _log_sum(b[:, i + 1 : i + 1 + m] + arcs[:, i + 1 + k[:m], k[:m]])
    row, j, length = np.nonzero(ends >= 0)
    uses = np.exp(f[row, j - length - 1] + arcs[row, j, length] + b[row, j] - f[row, n]) * weight[row]
    return np.bincount(ends[row, j, length], uses, minlength=size)


def _processor(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def _lattice(path: str) -> Lattice:
    key = ("lattice", path)
    if key not in _models:
        sp = _processor(path)
        _models[key] = Lattice([sp.id_to_piece(k) for k in range(sp.get_piece_size())])
    return _models[key]


def start(size: int) -> np.ndarray:
    """log probabilities of pieces in order of rank, by Zipf's law."""
    p = 1.0 / (np.arange(size) + ZIPF)
    return np.log(p / p.sum())


class Fit(NamedTuple):
    """Of each class: its tokens, the discount, the log probability that a token is spelled, and those of the public pieces."""

    totals: list[int]
    discounts: list[float]
    spelling: list[float]
    logp: np.ndarray


_STATE = pa.schema([("word", pa.binary()), ("counts", pa.list_(pa.int64())), ("whole", pa.list_(pa.float64())), ("class", pa.int32()), ("piece", pa.int32()), ("n", pa.float64())])
_STATE_DDL = "word binary, counts array<long>, whole array<double>, class int, piece int, n double"


def _matrix(column: pa.Array, classes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)


def _texts(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def _round(path: str, fit: Fit):
    """The words with the part of their counts that their whole piece has by this round, and, in rows without a word, the
    expected uses of each piece; piece -1 is the number of tokens spelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, classes = _lattice(path), len(fit.totals)
        into, spelled = np.zeros((classes, lattice.size)), np.zeros(classes)
        for batch in batches:
            words, counts, whole = _texts(batch.column(0)), _matrix(batch.column(1), classes), _matrix(batch.column(2), classes).copy()
            for at, ends, extra in lattice.groups(words):
                for k in range(classes):
                    here = np.flatnonzero(counts[at, k])
                    if not len(here):
                        continue
                    c, of = counts[at[here], k], at[here]
                    arcs = of_arcs(fit.logp[k], ends[here], extra)
                    f = forward(arcs)
                    p, q = whole[of, k] / fit.totals[k], np.exp(fit.spelling[k] + f[:, -1])
                    with np.errstate(invalid="ignore"):
                        share = np.where(p > 0, p / (p + q), 0.0)
                    whole[of, k] = np.maximum(c * share - fit.discounts[k], 0.0)
                    uses = expected(ends[here], arcs, f, c - whole[of, k], lattice.size + len(extra))
                    into[k] += uses[: lattice.size]
                    for x, pieces in zip(uses[lattice.size :], extra, strict=True):
                        np.add.at(into[k], pieces, x)
                    spelled[k] += (c - whole[of, k]).sum()
            rows, none = batch.num_rows, lambda t, n: pa.nulls(n, t)
            offsets = pa.array(np.arange(0, rows * classes + 1, classes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(whole.ravel())), none(pa.int32(), rows), none(pa.int32(), rows), none(pa.float64(), rows)], schema=_STATE)
        uses = np.column_stack([spelled, into])
        k, piece = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(k), f.type) for f in list(_STATE)[:3]], pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32) - 1), pa.array(uses[k, piece])], schema=_STATE)

    return run


def word_log10(lattice: Lattice, fit: Fit, words: list[str], whole: np.ndarray) -> np.ndarray:
    """log10 probability of each word in each class."""
    out = np.empty((len(words), len(fit.totals)))
    for at, ends, extra in lattice.groups(words):
        for k, total in enumerate(fit.totals):
            spelled = fit.spelling[k] + forward(of_arcs(fit.logp[k], ends, extra))[:, -1]
            with np.errstate(divide="ignore"):
                out[at, k] = np.logaddexp(spelled, np.log(whole[at, k] / total)) / math.log(10)
    return out


def _score_words(path: str, fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, classes = _lattice(path), len(fit.totals)
        for batch in batches:
            scores = word_log10(lattice, fit, _texts(batch.column(0)), _matrix(batch.column(2), classes)).astype(np.float32)
            offsets = pa.array(np.arange(0, scores.size + 1, classes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_matrix(batch.column(1), classes).sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))], names=["word", "c", "lp"])

    return run


def class_numbers(docs: DataFrame, class_col: str | None, most: int) -> tuple[Column, int]:
    """The number of each row's class, and how many there are: the most frequent ones, then one of all others."""
    if class_col is None:
        return F.lit(0), 1
    count = docs.groupBy(F.col(class_col).cast("string").alias("v")).agg(F.count("*").alias("n"))
    found = [r["v"] for r in count.orderBy(F.desc("n"), "v").limit(most).collect()]
    out = F.lit(min(len(found), most - 1) if len(found) == most else max(len(found) - 1, 0))
    expr = F
    for k, v in enumerate(found[: most - 1]):
        here = F.col(class_col).cast("string").isNull() if v is None else F.col(class_col).cast("string") == v
        expr = expr.when(here, k)
    return (expr.otherwise(out) if found[: most - 1] else out).cast("int"), max(len(found), 1)


def learn(known: DataFrame, classes: int, ends: list[int], vocabulary: str, rounds: int = ROUNDS) -> tuple[Fit, DataFrame]:
    """The fit to (word, counts by class), and (word, counts, whole); ends are the numbers of training documents."""
    per = [F.get("counts", F.lit(k)) for k in range(classes)]
    sums = known.agg(*[x for k, c in enumerate(per) for x in (F.sum(c).alias(f"n{k}"), F.count(F.when(c > 0, 1)).alias(f"d{k}"), F.count(F.when(c == 1, 1)).alias(f"o{k}"), F.count(F.when(c == 2, 1)).alias(f"t{k}"))]).first()
    totals = [(sums[f"n{k}"] or 0) + ends[k] for k in range(classes)]
    discounts = [min(max(sums[f"o{k}"] / (sums[f"o{k}"] + 2 * sums[f"t{k}"]), 0.1), 0.9) if sums[f"o{k}"] else 0.5 for k in range(classes)]
    size = _processor(vocabulary).get_piece_size()

    def fitted(spelled: list[float], logp: np.ndarray) -> Fit:
        # a class of no text knows no word and no end: spelling has half of the weight, the end the other
        spelling = [math.log(max(spelled[k], 1e-9) / totals[k]) if totals[k] else math.log(0.5) for k in range(classes)]
        return Fit([max(n, 1) for n in totals], discounts, spelling, logp)

    fit = fitted([discounts[k] * sums[f"d{k}"] for k in range(classes)], np.array([start(size)] * classes))
    less = F.array(*map(F.lit, discounts))
    state = known.withColumn("whole", F.zip_with("counts", less, lambda c, d: F.greatest(c - d, F.lit(0.0))))
    last = None
    for _ in range(rounds):
        both = staged(state.mapInArrow(_round(vocabulary, fit), _STATE_DDL), "lm-round", WORDS_A_FILE)
        if last is not None:
            discard(last)
        last = both
        n, spelled = np.zeros((classes, size)), [0.0] * classes
        for r in both.where("piece IS NOT NULL").groupBy("class", "piece").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary by classes
            if r["piece"] < 0:
                spelled[r["class"]] = r["n"]
            else:
                n[r["class"], r["piece"]] = r["n"]
        fit = fitted(spelled, np.array([np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * size)) if x.any() else start(size) for x in n]))
        state = both.where("piece IS NULL").select("word", "counts", "whole")
    return fit, state


def lattice_scores(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, block_tokens: int = BLOCK_TOKENS, max_classes: int = MAX_CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, own = docs.sparkSession, Own(docs)
    ship(spark)
    kind, classes = class_numbers(own.df, own.at(class_col) if class_col else None, max_classes)
    ddl = "block string, word binary, number int, trained array<long>, doc_id long, held_out boolean, class int, n_tokens long, n_words int, counts binary"
    reduced = own.df.select(F.col(own.at(id_col)).cast("long").alias("doc_id"), kind.alias("class"), F.col(own.at(text_col)).cast("binary").alias("text")).mapInArrow(_reduce(block_tokens, classes), ddl)
    path = shared_path(spark, "lm-blocks")
    reduced.write.parquet(path)
    asked = spark.read.schema(ddl).parquet(path).where("number IS NOT NULL").select("block", "word", "number", "trained")
    rows = spark.read.schema(ddl).parquet(path).where("counts IS NOT NULL").select("block", "doc_id", "held_out", "class", "n_tokens", "n_words", "counts")
    known = staged(asked.groupBy("word").agg(F.array(*[F.sum(F.get("trained", F.lit(k))) for k in range(classes)]).alias("counts")), "lm-words", WORDS_A_FILE)
    blocks = rows.agg(F.count_distinct("block")).first()[0]
    trained = {r["class"]: r["n"] for r in rows.where("NOT held_out").groupBy("class").agg(F.count("*").alias("n")).collect()}
    ends = [trained.get(k, 0) for k in range(classes)]
    fit, state = learn(known, classes, ends, vocabulary, rounds)
    whole = known.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"), F.count(F.when(F.exists("counts", lambda c: c > 0), 1)).alias("d")).first()
    total, distinct = (whole["n"] or 0) + sum(ends), whole["d"] + (sum(ends) > 0)
    scored = state.mapInArrow(_score_words(vocabulary, fit), "word binary, c long, lp array<float>")
    answers = asked.select("block", "word", "number").join(scored, "word").select("block", "number", "c", "lp")
    denominator, all_ends = total + distinct + 1, sum(ends)
    with np.errstate(divide="ignore"):  # a class without training documents has no weight, unless none has any
        of_class = np.log10([n / all_ends for n in ends] if all_ends else [1 / classes] * classes)
        of_end = np.log10([ends[k] / fit.totals[k] if ends[k] else 0.5 for k in range(classes)])
    of_text = of_class + of_end
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def judge(d: pa.Table, a: pa.Table) -> pa.Table:
        c, lp = np.zeros(len(a), np.int64), np.zeros((len(a), classes))
        at = a.column("number").to_numpy()
        c[at] = a.column("c").to_numpy()
        lp[at] = a.column("lp").combine_chunks().flatten().to_numpy().reshape(-1, classes) if len(a) else lp
        base, known_words, base_score, score = np.log10((c + 1) / denominator), [], [], []
        for counts, k in zip(d.column("counts").to_pylist(), d.column("n_words").to_pylist(), strict=True):
            u, m = _unpack(counts, k)
            known_words.append(int(m[c[u] > 0].sum()) + int(all_ends > 0))
            base_score.append(float((base[u] * m).sum()) + math.log10((all_ends + 1) / denominator))
            x = of_text + m @ lp[u]
            score.append(float(x.max() + np.log10((10.0 ** (x - x.max())).sum())))
        return pa.Table.from_arrays([d.column("doc_id"), d.column("held_out"), d.column("n_tokens"), pa.array(known_words, pa.int64()), pa.array([total] * len(d), pa.int64()), pa.array(base_score, pa.float64()), pa.array(score, pa.float64())], schema=schema)

    tasks = max(1, -(-blocks // BLOCKS_A_TASK))
    met = rows.drop("class").repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block"))
    return met.applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return lattice_scores(docs, public_tokenizers.path("piece_bpe_32k.model"), class_col="lang")
