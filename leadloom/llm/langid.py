"""Language ID of words by a linear-chain conditional random field.

Every word of a text is labelled by forward-backward over hashed affix and n-gram features, lexicon features
and learned transitions; a document's language is the one with most posterior mass over its words. The model
is fitted on a bounded sample of labelled rows (`per_language` texts of each language, in expectation); all
sums over the corpus are Spark jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..names import free_names
from .common import read_table, word_hashes

#: Labelled texts of each language to fit on, in expectation.
PER_LANGUAGE = 80
#: Languages that can be learned, the most frequent ones, and bytes of sample texts of each beyond its first text.
MAX_LANGUAGES, SAMPLE_BYTES = 200, 8_000_000
BITS = 16
LEXICON_BITS = 18
#: A word enters a language's lexicon when the sample holds it so often in that language.
LEXICON_COUNT = 3
#: Characters of text that a worker turns into features at a time, and runs through the chain at a time.
STEP_CHARS, CHAIN_CHARS = 400_000, 2_400_000
#: Words in a block of the chain.
BLOCK = 256
ROUNDS = 25

#: Letters are ASCII letters and every byte of a longer UTF-8 sequence; all else parts words.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORDS_ONLY = bytes(b if _LETTER[b] else 32 for b in range(256))
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


@dataclass
class Words:
    """Feature indices of the words of some texts."""

    grams: np.ndarray  # (orders, bytes): feature of each n-gram that ends at each byte of a word
    first: np.ndarray  # where each word's bytes start
    lexicon: np.ndarray  # slot of each word in the lexicon table
    counts: np.ndarray  # words of each text


def featurise(texts: list[str]) -> Words:
    """Affixes are the n-grams that hold the blank before or after a word."""
    raw = [t.lower().encode("utf-8", "replace").translate(_WORDS_ONLY) for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    hashes, counts = word_hashes(raw)
    letter = buf != 32
    at = np.flatnonzero(letter)
    b0 = buf[at].astype(np.uint32)
    b1 = buf[at - 1].astype(np.uint32)
    b2 = np.where(b1 == 32, 32, buf[np.maximum(at - 2, 0)]).astype(np.uint32)
    after = buf[at + 1].astype(np.uint32)
    two = b1 * _ODD[0] + b0 * _ODD[1]
    three = two + b2 * _ODD[2] + np.uint32(1)
    # The longest gram looks one byte ahead; at a word's end it holds the blank and so is a suffix.
    four = three + after * _ODD[3] + np.uint32(2)
    suffix = np.where(after == 32, (b1 << np.uint32(8) | b0) * _ODD[3] + np.uint32(3), two + after * _ODD[2] + np.uint32(4))
    shift = np.uint32(32 - BITS)
    grams = np.stack([(g * _ODD[0]) >> shift for g in (two, three, four, suffix)])
    starts = np.flatnonzero(b1 == 32)
    return Words(grams, starts, (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64), counts)


@dataclass
class Crf:
    languages: list[str]
    grams: np.ndarray  # (orders, 2**BITS, languages)
    lexicon: np.ndarray  # (2**LEXICON_BITS,): bit l set: in the lexicon of language l mod 30
    lexicon_weight: np.ndarray  # (30 or fewer bits, languages)
    transition: np.ndarray  # (languages, languages), log
    start: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """(words, languages)"""
        total = self.grams[0][w.grams[0]]
        for k in range(1, len(self.grams)):
            total += self.grams[k][w.grams[k]]
        out = np.add.reduceat(total, w.first, axis=0) if len(w.first) else np.zeros((0, len(self.languages)), np.float32)
        return out + _bits(self.lexicon[w.lexicon], len(self.lexicon_weight)) @ self.lexicon_weight

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text; for texts with words, the mean posterior of each language."""
        parts, counts, group, size = [], [], [], 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size >= STEP_CHARS or i == len(texts) - 1:
                w = featurise(group)
                parts.append(self.scores(w))
                counts.append(w.counts)
                group, size = [], 0
        scores, counts = np.concatenate(parts), np.concatenate(counts)
        post, _, first = forward_backward(scores, counts, self.transition, self.start)
        some = counts[counts > 0]
        return counts, np.add.reduceat(post, first, axis=0) / some[:, None] if len(some) else post

    def marginals(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return forward_backward(self.scores(w), w.counts, self.transition, self.start)


def _bits(mask: np.ndarray, n: int) -> np.ndarray:
    return ((mask[:, None] >> np.arange(n)) & 1).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled so that each vector along the last axis sums to 1."""
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each word's label; expected transitions; first word of each text that has one.

    Texts are cut into blocks of BLOCK words. First the product of each block's steps is formed, for all blocks
    at once; then messages pass from block to block of each text; then all blocks run inside at once. The
    result is that of one run over whole texts, in as many steps as a block has words.
    """
    n = scores.shape[1]
    counts = counts[counts > 0]
    first = np.cumsum(counts) - counts
    expected = np.zeros((n, n))
    if not len(counts):
        return np.zeros((0, n)), expected, first
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    move = np.exp(transition)
    n_blocks = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), n_blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = first[text] + nth * BLOCK
    lens = np.minimum(counts[text] - nth * BLOCK, BLOCK)
    order = np.argsort(-lens, kind="stable")
    begin, lens = begin[order], lens[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of each block in text order
    active = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left")  # blocks longer than t
    text_at = np.cumsum(n_blocks) - n_blocks
    into = np.empty((len(order), n))  # what a block's first word gets from before it
    after = np.ones((len(order), n))  # what its last word gets from after it
    rounds = int(n_blocks.max())
    into[place[text_at]] = np.exp(start)
    if rounds > 1:
        whole = np.zeros((len(order), n, n))
        run = np.eye(n) * emit[begin][:, None, :]
        for t in range(1, int(lens[0])):
            done = active[t]
            whole[done : len(run)] = run[done:]
            run = (run[:done].reshape(-1, n) @ move).reshape(-1, n, n) * emit[begin[:done] + t][:, None, :]
            run /= run.sum(axis=(1, 2), keepdims=True)
        whole[: len(run)] = run
        for j in range(1, rounds):
            has = np.flatnonzero(n_blocks > j)
            here, past = place[text_at[has] + j], place[text_at[has] + j - 1]
            into[here] = _unit(np.einsum("ki,kij->kj", into[past], whole[past]) @ move)
        for j in range(rounds - 1, 0, -1):
            has = np.flatnonzero(n_blocks > j)
            here, past = place[text_at[has] + j], place[text_at[has] + j - 1]
            after[past] = _unit(np.einsum("kij,kj->ki", whole[here], after[here]) @ move.T)
    alpha = np.empty_like(emit)
    a = _unit(into * emit[begin])
    alpha[begin] = a
    for t in range(1, int(lens[0])):
        at = begin[: active[t]] + t
        a = _unit((a[: active[t]] @ move) * emit[at])
        alpha[at] = a
    later = nth[order] > 0  # blocks with a block before them: the step between the two
    before, push = alpha[begin[later] - 1], emit[begin[later]]
    beta = after.copy()
    for t in range(int(lens[0]) - 1, 0, -1):
        at = begin[: active[t]] + t
        down = emit[at] * beta[: active[t]]
        past = alpha[at - 1]
        expected += (past / ((past @ move) * down).sum(axis=1, keepdims=True)).T @ down * move
        alpha[at] = _unit(alpha[at] * beta[: active[t]])
        beta[: active[t]] = _unit(down @ move.T)
    push = push * beta[later]
    expected += (before / ((before @ move) * push).sum(axis=1, keepdims=True)).T @ push * move
    alpha[begin] = _unit(alpha[begin] * beta)
    return alpha, expected, first


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = 5) -> Crf:
    """Maximise the conditional likelihood by AdaGrad over whole-sample gradients.

    Besides the texts themselves, sequences that switch language every few lines are spliced from them, so the
    transitions learn how long a stretch lasts.
    """
    languages = sorted(set(labels))
    index = {lang: i for i, lang in enumerate(languages)}
    n = len(languages)
    rng = np.random.default_rng(seed)
    stretches = [(" ".join(words[i : i + 25]), index[lang]) for t, lang in zip(texts, labels, strict=True) for words in [t.split()] for i in range(0, len(words), 25)]
    mixed = [stretches[i] for i in rng.permutation(len(stretches))[: len(stretches) // 3]]
    sequences = [[(t, index[lang])] for t, lang in zip(texts, labels, strict=True)] + [mixed[i : i + 8] for i in range(0, len(mixed), 8)]
    w = featurise([t for s in sequences for t, _ in s])
    gold = np.repeat([lang for s in sequences for _, lang in s], w.counts)
    joined = np.add.reduceat(w.counts, np.cumsum([0, *map(len, sequences)])[:-1]) if sequences else w.counts
    w.counts = joined
    truth = np.zeros((len(gold), n))
    truth[np.arange(len(gold)), gold] = 1

    bits = min(n, 30)
    lexicon = np.zeros(1 << LEXICON_BITS, np.int32)
    for lang in range(n):
        slots, seen = np.unique(w.lexicon[gold == lang], return_counts=True)
        lexicon[slots[seen >= LEXICON_COUNT]] |= np.int32(1 << (lang % bits))
    member = _bits(lexicon[w.lexicon], bits)
    ends = np.cumsum(w.counts)
    gold_moves = np.zeros((n, n))
    inner = np.ones(len(gold), dtype=bool)
    inner[(ends - 1)[w.counts > 0]] = False
    np.add.at(gold_moves, (gold[:-1][inner[:-1]], gold[1:][inner[:-1]]), 1)

    crf = Crf(languages, np.zeros((len(w.grams), 1 << BITS, n), np.float32), lexicon, np.zeros((bits, n), np.float32), np.zeros((n, n)), np.zeros(n))
    word_of = np.repeat(np.arange(len(gold)), np.diff(np.append(w.first, w.grams.shape[1])))
    sums = {"grams": np.full(crf.grams.shape, 1e-6), "lexicon_weight": np.full((bits, n), 1e-6), "transition": np.full((n, n), 1e-6), "start": np.full(n, 1e-6)}
    for _ in range(rounds):
        post, moves, first = crf.marginals(w)
        miss = truth - post
        grads = {"lexicon_weight": member.T @ miss, "transition": gold_moves - moves, "start": miss[first].sum(axis=0), "grams": np.zeros(crf.grams.shape)}
        by_byte = miss[word_of]
        for k in range(len(w.grams)):
            for lang in range(n):
                grads["grams"][k, :, lang] = np.bincount(w.grams[k], weights=by_byte[:, lang], minlength=1 << BITS)
        for name, g in grads.items():
            value = getattr(crf, name)
            g -= 0.01 * value
            sums[name] += g * g
            value += (0.15 * g / np.sqrt(sums[name])).astype(value.dtype)
    return crf


def _predict(model, kept: int):
    """The first `kept` columns of each batch, then lang_pred and score; text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf: Crf | None = model.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < len(texts):
                group, size, first = [], 0, at
                while at < len(texts) and (not group or size < CHAIN_CHARS):
                    group.append(texts[at].as_py() or "")
                    size += len(group[-1])
                    at += 1
                langs, scores = ["und"] * len(group), np.zeros(len(group))
                if crf:
                    counts, mass = crf.shares(group)
                    for i, share in zip(np.flatnonzero(counts), mass, strict=True):
                        if any(map(str.isalpha, group[i])):
                            best = int(share.argmax())
                            langs[i], scores[i] = crf.languages[best], min(1.0, float(share[best]))
                columns = [c.slice(first, len(group)) for c in batch.columns[:kept]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(scores)], [*batch.schema.names[:kept], "lang_pred", "score"])

    return run


def sample_labelled(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of about `per_language` training rows of each language, chosen by a hash of doc_id.

    The only rows that reach the driver: whole texts of the MAX_LANGUAGES most frequent languages, at most twice
    `per_language` of each and SAMPLE_BYTES beyond the first. Rows that repeat an id with its text count once.
    """
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    h, picked = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)), F.lit(False)
    for lang, n in counts:
        picked |= (F.col("lang") == lang) & (h < int(min(1.0, per_language / n) * (1 << 30)))
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    rows = usable.where(picked).select("text", "lang", "doc_id", h.alias("h")).distinct().withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= 2 * per_language)
    size = F.sum(F.octet_length("text").cast("long")).over(by_hash)
    rows = rows.withColumn("size", size).where((F.col("size") <= SAMPLE_BYTES) | (F.col("nth") == 1)).select("text", "lang", "doc_id").collect()
    return [(r[0], r[1]) for r in sorted(rows, key=lambda r: (str(r[2]), r[0]))]


def identify(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of `docs` with the language of their whole text: all columns, then lang_pred and score.

    Score is the mean posterior of the words, 0 to 1. Learns from rows where `training` holds and text and lang
    are not null; lang is never an input of a prediction. Null texts and texts without a letter are 'und' with
    score 0, as is all text when there is nothing to learn from. Ties go to the language that sorts first.
    Null and repeated doc_ids keep their rows; columns of `docs` named lang_pred or score are replaced.
    """
    rows = sample_labelled(docs, training, per_language)
    crf = fit([t for t, _ in rows], [lang for _, lang in rows]) if rows else None
    model = docs.sparkSession.sparkContext.broadcast(crf)
    kept = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    (text,) = free_names(kept.columns, "text_read")
    given = kept.select("*", F.col("text").cast("string").alias(text))
    return given.mapInArrow(_predict(model, len(kept.columns)), f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
