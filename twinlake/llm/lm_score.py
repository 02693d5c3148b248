"""Document likelihood under a unigram model over all subword segmentations.

The pieces are those of an existing vocabulary; its scores, as ranks, give the first weights.  Expectation-maximisation over the
training documents re-estimates them: a word's lattice holds every way to cut it into pieces, the forward recursion in log space
sums over all of them, and the backward one gives each piece its expected count.  White space always cuts, so the marginal
probability of a document is the product of its words' and that of one end.

Words are counted over the whole corpus first, each distinct word's lattice is then summed once, and documents gather the
results: words above a share of all tokens (so there are at most ``1 / share`` of them) from a table in the shared folder, all
others by a join on the word.  So no hot word meets in one task, and nothing that grows with the corpus is broadcast.

Training documents are those whose crc32(doc_id as text) mod 10 isn't 0.  Beside the model stands an additive-smoothed word
unigram score.

Cases: null or empty text is one end; null doc_id counts as the text "" and so is held out; repeated documents each count and
each get a row; without training documents the first weights stay; characters that no piece covers are spelled as byte pieces;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = ""  # no word is empty
_START = "▁"
_MOST_WORDS = 300_000

_models: dict[str, _Lattice] = {}
_frequent: dict[str, tuple] = {}


class _Lattice:
    """The pieces of a vocabulary file, found in words by an Aho-Corasick automaton."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end, self.byte = model.get_piece_size(), model.eos_id(), np.zeros(256, np.int64)
        self.find, first, self.length = ahocorasick.Automaton(), np.full(self.size, -np.inf), np.zeros(self.size, np.int64)
        self.single: set[str] = set()
        for i in range(self.size):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or score < -1e8:
                continue
            else:
                self.find.add_word(piece, i)
                self.length[i] = len(piece)
                if len(piece) == 1:
                    self.single.add(piece)
            first[i] = -math.log(self.size if model.is_byte(i) else 2 - score)
        first[self.end] = -math.log(100)
        self.find.make_automaton()
        self.first = first - math.log(np.exp(first).sum())

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Positions run over the words, each with its start sign, laid end to end with a gap after each.

        Word starts and ends; start, end and piece of each edge in order of its end; for a spelled character the piece is
        -1 - its position."""
        marked = [_START + w for w in words]
        text = "\n".join(marked)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        first = np.cumsum(size + 1) - size - 1
        found = np.fromiter(self.find.iter(text), np.dtype([("at", np.int64), ("piece", np.int64)]))
        end, piece = found["at"] + 1, found["piece"]
        start = end - self.length[piece]
        odd = [c for c in set(text) if c not in self.single and c != "\n"]
        if odd:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lone = np.flatnonzero(np.isin(points, [ord(c) for c in odd]))
            start, end, piece = np.concatenate([start, lone]), np.concatenate([end, lone + 1]), np.concatenate([piece, -1 - lone])
        return first, first + size, start, end, piece, text

    def weights(self, piece: np.ndarray, text: str, logp: np.ndarray) -> np.ndarray:
        out = logp[np.maximum(piece, 0)]
        for i in np.flatnonzero(piece < 0):
            out[i] = logp[self.byte[list(text[-1 - piece[i]].encode())]].sum()
        return out

    def forward(self, first: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Log of the summed weight of all ways from each word's start to each position; and the edges in the order of their level."""
        alpha = np.full(size, -np.inf)
        alpha[first] = 0
        level = end - first[np.searchsorted(first, start, "right") - 1]
        order = np.lexsort((end, level))
        _sweep(alpha, level[order], end[order], start[order], weight[order])
        return alpha, order

    def expected(self, words: list[str], times: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected count of each piece."""
        first, last, start, end, piece, text = self.edges(words)
        weight = self.weights(piece, text, logp)
        alpha, _ = self.forward(first, start, end, weight, len(text) + 2)
        beta = np.full(len(text) + 2, -np.inf)
        beta[last] = 0
        word = np.searchsorted(first, start, "right") - 1
        level = last[word] - start
        order = np.lexsort((start, level))
        _sweep(beta, level[order], start[order], end[order], weight[order])
        with np.errstate(invalid="ignore"):
            share = np.exp(alpha[start] + weight + beta[end] - alpha[last][word]) * times[word]
        share = np.nan_to_num(share)
        out = np.bincount(np.maximum(piece, 0), np.where(piece < 0, 0, share), self.size)
        for i in np.flatnonzero(piece < 0):
            np.add.at(out, self.byte[list(text[-1 - piece[i]].encode())], share[i])
        return out

    def marginals(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log probability of each word over all its segmentations."""
        first, last, start, end, piece, text = self.edges(words)
        return self.forward(first, start, end, self.weights(piece, text, logp), len(text) + 2)[0][last]


def _sweep(value: np.ndarray, level: np.ndarray, to: np.ndarray, come_from: np.ndarray, weight: np.ndarray) -> None:
    """value[to] = log of the sum of exp(value[come_from] + weight), level by level; edges come ordered by level and to."""
    if not len(level):
        return
    bounds = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)).tolist()
    heads = np.append(True, (to[1:] != to[:-1]) | (level[1:] != level[:-1]))
    for a, b in zip(bounds, bounds[1:], strict=False):
        x = value[come_from[a:b]] + weight[a:b]
        at = np.flatnonzero(heads[a:b])
        most = np.maximum.reduceat(x, at)
        safe = np.where(np.isfinite(most), most, 0)
        with np.errstate(divide="ignore"):
            value[to[a:b][at]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(at, b - a)))), at))


def lattice(path: str) -> _Lattice:
    if path not in _models:
        _models[path] = _Lattice(path)
    return _models[path]


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: how often it stands in training documents (0 for a word of others only); END counts the training documents.

    Tasks count before the shuffle, so a hot word moves once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter = Counter()
        others: set[bytes] = set()

        def out() -> pa.RecordBatch:
            rest = [w for w in others if w not in trained]
            words = [*trained.keys(), *rest]
            return pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()), pa.array([*trained.values(), *repeat(0, len(rest))], pa.int64())], names=["word", "n"])

        for batch in batches:
            text, offsets = common.text_bytes(batch.column(2))
            for i, out_of_training in enumerate(batch.column(1).to_pylist()):
                words = text[offsets[i] : offsets[i + 1]].tobytes().translate(FOLD).split()
                if out_of_training:
                    others.update(words)
                else:
                    trained.update(words)
                    trained[b""] += 1
                if len(trained) + len(others) > _MOST_WORDS:
                    yield out()
                    trained.clear()
                    others.clear()
        if trained or others:
            yield out()

    return _texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _batched(batch: pa.RecordBatch, most: int = 4000) -> Iterator[tuple[list[str], np.ndarray, int, int]]:
    """Slices of a batch of (word, n) without END, words of like length together."""
    words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
    order = np.argsort([len(w) for w in words], kind="stable")
    order = order[[words[i] != END for i in order]] if len(order) else order
    for a in range(0, len(order), most):
        part = order[a : a + most]
        yield [words[i] for i in part], n[part], part


def learn(counted: DataFrame, path: str, rounds: int = 2, prior: float = 0.1) -> np.ndarray:
    """Log weight of each piece after so many rounds; prior: expected counts that each piece starts with, on average."""
    model = lattice(path)
    logp = model.first
    ends = counted.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            model = lattice(path)
            total = np.zeros(model.size)
            for batch in common.gathered(batches, rows=10_000):
                for words, n, _ in _batched(batch):
                    total += model.expected(words, n, logp)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        gathered = counted.where("n > 0").select("word", "n").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece at most
        total = np.exp(model.first) * prior * model.size
        for r in gathered:
            total[r.piece] += r.n
        total[model.end] += ends
        if gathered or ends:
            with np.errstate(divide="ignore"):
                logp = np.log(total / total.sum())
    return logp


def _word_scores(counted: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """Adds score, the log10 marginal probability of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in common.gathered(batches, rows=10_000):
            score = np.full(len(batch), logp[model.end])
            for words, _, part in _batched(batch):
                score[part] = model.marginals(words, logp)
            yield pa.record_batch([*batch.columns, pa.array(score / math.log(10))], names=["word", "n", "score"])

    return counted.select("word", "n").mapInArrow(run, "word string, n long, score double")


def _load(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    if path not in _frequent:
        _frequent.clear()
        fs, at = common.file_system(path)
        with fs.open_input_file(at) as source:
            t = pa.ipc.open_file(source).read_all()
        n = t["n"].to_numpy()
        _frequent[path] = {w.encode(): i for i, w in enumerate(t["word"].to_pylist())}, n, np.log10(n + 0.1), t["score"].to_numpy()
    return _frequent[path]


def score(docs: DataFrame, path: str, rounds: int = 2, share: float = 1e-6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) of each document."""
    common.small_batches(docs.sparkSession)
    counted = common.checkpoint(count_words(docs))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    scored = common.checkpoint(_word_scores(counted, path, learn(counted, path, rounds)))
    frequent = scored.where((F.col("word") == END) | (F.col("n") >= max(1, math.ceil(share * total[0])))).toArrow()
    folder = common.new_folder(docs.sparkSession, "words")
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/frequent") as sink, pa.ipc.new_file(sink, frequent.schema) as out:
        out.write_table(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row with what the table gives, under a key that is no word; and a row for each other distinct word."""
        of, n, base, marginal = _load(f"{folder}/frequent")
        get, row = of.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            text, offsets = common.text_bytes(batch.column(2))
            ids, held = batch.column(0), batch.column(1)
            for a, b in common.slices(offsets, 1 << 20):
                own, rest, times, lengths, sums = [], [], [], [], np.zeros((b - a, 3))
                for i in range(a, b):
                    words = text[offsets[i] : offsets[i + 1]].tobytes().translate(FOLD).split()
                    at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                    known = np.append(at[at >= 0], of.get(b"", [])).astype(np.int64)
                    sums[i - a] = (n[known] > 0).sum(), base[known].sum(), marginal[known].sum()
                    other = Counter([words[j] for j in np.flatnonzero(at < 0)])
                    own.append(len(words) + 1)
                    rest += other.keys()
                    times += other.values()
                    lengths.append(len(other))
                size = b - a
                rows = np.arange(row, row + size)
                row += size
                owner = np.repeat(np.arange(size), lengths)
                keys = pa.concat_arrays([pa.array([f" {r}" for r in rows]), pa.array(rest, pa.binary()).cast(pa.string())])
                index = pa.array(np.concatenate([np.arange(size), owner]) + a)
                zero = np.zeros(len(rest))
                yield pa.record_batch([pa.array(np.concatenate([rows, rows[owner]])), ids.take(index), held.take(index), keys, pa.array(np.concatenate([own, np.array(times, np.int64)])), pa.array(np.append(sums[:, 0], zero).astype(np.int64)), pa.array(np.append(sums[:, 1], zero)), pa.array(np.append(sums[:, 2], zero))], names=["row", "doc_id", "held_out", "word", "times", "known", "base", "marginal"])

    parts = _texts(docs).mapInArrow(run, "row long, doc_id long, held_out boolean, word string, times long, known long, base double, marginal double")
    own = F.substring("word", 1, 1) == " "
    joined = parts.join(scored, "word", "left")
    times = F.col("times")
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.bool_or("held_out").alias("held_out"),
            F.sum(F.when(own, times).otherwise(F.lit(0))).alias("n_tokens"),
            F.sum(F.when(own, F.col("known")).when(F.col("n") > 0, times).otherwise(F.lit(0))).alias("n_known"),
            F.sum(F.when(own, F.col("base")).otherwise(times * F.log10(F.col("n") + F.lit(0.1)))).alias("base"),
            F.sum(F.when(own, F.col("marginal")).otherwise(times * F.col("score"))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total[0])).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total[0] + 0.1 * (total[1] + 1)))).alias("base_score"), "score")
    )
