"""N-best segmentation over a SentencePiece vocabulary.

A forward Viterbi pass gives the best score of every prefix. From the end backwards an A-star search takes these as
exact heuristics, so it pops whole segmentations in the order of their scores. No piece of the vocabulary holds a
blank after another character, so a text's lattice is a chain of lattices of its words. The Viterbi passes run over
all new words of a batch at once and also tell what each word's second segmentation costs; the A-star search runs
for the words whose second segmentation costs least, for only these can differ from their best in the N best of a text.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table

BEST = 4
#: A character without a piece costs so much more than the worst piece; it is written as its bytes.
UNKNOWN_PENALTY = 10.0
BLANK = "▁"
#: Words and ids that a worker remembers before it starts anew; longer words are searched one by one.
CACHE_WORDS, CACHE_IDS, CACHE_LENGTH = 250_000, 4_000_000, 40
#: Words that go through the Viterbi passes together.
PASS_WORDS = 4096
STEP_CHARS = 1_000_000
#: A line feed, or a run of blanks with what follows it.
WORDS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


SLOT_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _slot(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(salt)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Pieces:
    """Pieces with their scores, from a model file; bytes stand for characters without a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.id_of: dict[str, tuple[int, float]] = {}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.id_of[model.id_to_piece(i)] = (i, model.get_score(i))
        self.longest = max(map(len, self.id_of))
        self.score_of = np.full(model.get_piece_size() + 1, -np.inf)  # the last: no piece
        self.bytes_of = [b""] * model.get_piece_size()
        for piece, (i, score) in self.id_of.items():
            self.score_of[i], self.bytes_of[i] = score, piece.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self._hash_table()
        self.unknown = min(s for _, s in self.id_of.values()) - UNKNOWN_PENALTY
        inside = re.compile(f"[^{BLANK}]{BLANK}|\n")
        if any(inside.search(p) for p in self.id_of):
            raise ValueError("pieces of this vocabulary cross blanks or line feeds")

    def _hash_table(self) -> None:
        """Two ids for each slot of a table by hash, and every piece's hash."""
        names, ids = list(self.id_of), np.array([i for i, _ in self.id_of.values()])
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in names]
        hashes = np.zeros(len(names), np.uint64)
        for k in range(self.longest):
            has = np.array([len(c) > k for c in codes])
            hashes[has] = hashes[has] * _STEP + np.array([c[k] for c in codes if len(c) > k], np.uint64) + np.uint64(1)
        self.hash_of = np.zeros(len(self.score_of), np.uint64)
        self.hash_of[ids] = hashes
        self.salt = next(s for s in range(1000) if np.bincount(_slot(hashes, s)).max() <= 2)
        self.slots = np.full((2, 1 << SLOT_BITS), len(self.score_of) - 1, np.int32)
        slot = _slot(hashes, self.salt)
        _, first = np.unique(slot, return_index=True)
        rest = np.setdiff1d(np.arange(len(slot)), first)
        self.slots[0, slot[first]], self.slots[1, slot[rest]] = ids[first], ids[rest]

    def _ids(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash; none is the last row of score_of."""
        slot = _slot(hashes, self.salt)
        one = self.slots[0, slot]
        out = np.where(self.hash_of[one] == hashes, one, len(self.score_of) - 1)
        two = self.slots[1, slot]
        return np.where(self.hash_of[two] == hashes, two, out)

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length, as rows of code points: (has all characters, best score, cost of the second
        segmentation, ids of the best one after another, how many each has)."""
        n, length = words.shape
        longest = min(self.longest, length)
        hashes = np.zeros((n, length), np.uint64)
        ids, scores = [None], [None]
        for size in range(1, longest + 1):
            hashes = hashes[:, : length - size + 1] * _STEP + words[:, size - 1 :].astype(np.uint64) + np.uint64(1)
            ids.append(self._ids(hashes))
            scores.append(self.score_of[ids[-1]])
        whole = np.isfinite(scores[1]).all(axis=1)
        ahead = np.full((n, length + 1), -np.inf)
        ahead[:, 0] = 0
        size_at = np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            ways = np.stack([ahead[:, end - k] + scores[k][:, end - k] for k in range(1, min(longest, end) + 1)])
            size_at[:, end] = ways.argmax(axis=0) + 1
            ahead[:, end] = ways.max(axis=0)
        behind = np.full((n, length + 1), -np.inf)
        behind[:, length] = 0
        for start in range(length - 1, -1, -1):
            behind[:, start] = np.stack([scores[k][:, start] + behind[:, start + k] for k in range(1, min(longest, length - start) + 1)]).max(axis=0)
        used = [np.zeros(x.shape, bool) if x is not None else None for x in ids]
        at = np.full(n, length)
        rows, places, pieces = [], [], []
        live = np.flatnonzero(whole)
        while len(live):
            size = size_at[live, at[live]]
            at[live] -= size
            for k in np.unique(size).tolist():
                r = live[size == k]
                used[k][r, at[r]] = True
                rows.append(r)
                places.append(at[r])
                pieces.append(ids[k][r, at[r]])
            live = live[at[live] > 0]
        second = np.full(n, -np.inf)
        with np.errstate(invalid="ignore"):
            for k in range(1, longest + 1):
                through = ahead[:, : length - k + 1] + scores[k] + behind[:, k:]
                through[used[k]] = -np.inf
                second = np.maximum(second, through.max(axis=1))
            cost = ahead[:, -1] - second
        if not rows:
            return whole, ahead[:, -1], cost, np.zeros(0, np.int32), np.zeros(n, np.int64)
        row, place, piece = np.concatenate(rows), np.concatenate(places), np.concatenate(pieces)
        order = np.lexsort((place, row))
        return whole, ahead[:, -1], cost, piece[order].astype(np.int32), np.bincount(row, minlength=n)

    def prefixes(self, word: str) -> array:
        """The best score of every prefix of a word: the forward Viterbi pass."""
        n, get, longest = len(word), self.id_of.get, self.longest
        best = array("d", [-np.inf]) * (n + 1)
        best[0] = 0.0
        for start in range(n):
            at = best[start]
            for end in range(start + 1, min(n, start + longest) + 1):
                found = get(word[start:end])
                score = found[1] if found else self.unknown if end == start + 1 else None
                if score is not None and at + score > best[end]:
                    best[end] = at + score
        return best

    def segmentations(self, word: str, n_best: int) -> list[tuple[float, tuple[int, ...]]]:
        """The `n_best` segmentations with the highest sums of scores: (score, ids), best first.

        A-star from the end. As the heuristic is exact, every open entry holds a segmentation of exactly its value, and
        no two entries hold the same one: so entries beyond the best that are still wanted can go, and the agenda
        never holds more than `n_best`, however long the word.
        """
        get, longest = self.id_of.get, self.longest
        best = self.prefixes(word)
        out: list[tuple[float, tuple[int, ...]]] = []
        agenda: list[tuple] = [(-best[-1], 0, len(word), 0.0, None)]  # in order
        order = 0
        while agenda and len(out) < n_best:
            _, _, at, behind, path = agenda.pop(0)
            if not at:
                ids: list[int] = []
                while path:
                    piece, path = path
                    ids += piece if isinstance(piece, list) else [piece]
                out.append((behind, tuple(ids)))
                continue
            for start in range(max(0, at - longest), at):
                found = get(word[start:at])
                if found:
                    piece, score = found
                elif start == at - 1:
                    piece, score = [self.byte_ids[b] for b in word[start:at].encode()], self.unknown
                else:
                    continue
                order += 1
                total = behind + score
                insort(agenda, (-(best[start] + total), order, start, total, (piece, path)))
            del agenda[n_best - len(out) :]
        return out


def prepared(text: str) -> str:
    """As the model's normaliser has it: a blank before the text, blanks visible; empty text stays empty."""
    return BLANK + text.replace(" ", BLANK) if text else ""


class Words(dict):
    """Row of each word met; rows hold its best segmentation, that one's score and what the second costs."""

    def __init__(self, pieces: Pieces, n_best: int):
        super().__init__()
        self.pieces, self.n_best = pieces, n_best
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.starts, self.lens, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.score, self.step = np.zeros(0), np.zeros(0)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row

    def best_of(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """The word's n_best segmentations; among equal scores the one kept as its best comes first."""
        if word not in self.searched:
            row = self[word]
            own = tuple(self.ids[self.starts[row] : self.starts[row] + self.lens[row]].tolist())
            found = self.pieces.segmentations(word, self.n_best)
            self.searched[word] = [(found[0][0], own), *(f for f in found if f[1] != own)][: self.n_best]
        return self.searched[word]

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._add(self.new)
            self.new = []
        return out

    def _add(self, new: list[str]) -> None:
        n = len(new)
        sizes = np.fromiter(map(len, new), np.int64, n)
        score, step, lens = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        owners, ids, odd = [], [], np.flatnonzero(sizes > CACHE_LENGTH).tolist()
        for size in np.unique(sizes[sizes <= CACHE_LENGTH]).tolist():
            alike = np.flatnonzero(sizes == size)
            for at in range(0, len(alike), PASS_WORDS):
                part = alike[at : at + PASS_WORDS]
                codes = np.frombuffer("".join([new[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                whole, best, cost, found, counts = self.pieces.viterbi(codes)
                odd += part[~whole].tolist()
                score[part], step[part], lens[part] = best, cost, counts
                owners.append(np.repeat(part, counts))
                ids.append(found)
        for i in odd:
            found = self.pieces.segmentations(new[i], self.n_best)
            score[i], step[i], lens[i] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf, len(found[0][1])
            self.searched[new[i]] = found
            owners.append(np.full(len(found[0][1]), i))
            ids.append(np.array(found[0][1], np.int32))
        order = np.argsort(np.concatenate(owners), kind="stable")
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, np.concatenate(ids)[order]])
        self.score, self.step = np.concatenate([self.score, score]), np.concatenate([self.step, step])


def text_segmentations(words: list[str], rows: np.ndarray, known: Words, n_best: int) -> list[tuple[float, np.ndarray]]:
    """The best segmentations of a text from those of its words: (score, ids), best first.

    Only the n_best - 1 words whose second segmentation costs least can differ from their best in any of them.
    """
    lens = known.lens[rows]
    ends = np.cumsum(lens)
    ids = known.ids[np.repeat(known.starts[rows] - (ends - lens), lens) + np.arange(int(ends[-1]))]
    score = float(known.score[rows].sum())
    step = known.step[rows]
    many = min(n_best - 1, len(rows))
    open_to = np.argpartition(step, many - 1)[:many] if many and many < len(rows) else np.arange(many)
    if many and many < len(rows):  # ties go to the words that come first
        limit = step[open_to].max()
        below, equal = np.flatnonzero(step < limit), np.flatnonzero(step == limit)
        open_to = np.concatenate([below, equal[: many - len(below)]])
    open_to = np.sort(open_to[np.isfinite(step[open_to])])
    choices = [known.best_of(words[p]) for p in open_to]
    combos: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for c in choices:  # no more than n_best of the shorter ones can lead to the n_best of the longer ones
        combos = sorted((cost + c[0][0] - c[k][0], (*picks, k)) for cost, picks in combos for k in range(len(c)))[:n_best]
    out = []
    for cost, picks in combos:
        if any(picks):
            parts, at = [], 0
            for p, k, c in zip(open_to, picks, choices, strict=True):
                if k:
                    parts += [ids[at : ends[p] - lens[p]], np.array(c[k][1], np.int32)]
                    at = ends[p]
            out.append((score - cost, np.concatenate([*parts, ids[at:]])))
        else:
            out.append((score, ids))
    return out


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text whose segmentation these ids are."""
    return b"".join(map(pieces.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def _segment(path: str | None, n_best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        pieces = Pieces(path or public_tokenizers.path("piece_bpe_32k.model"))
        known = Words(pieces, n_best)
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(texts):
                rows_out, size, first = [], 0, at
                group: list[str] = []
                while at < len(texts) and (not group or size < STEP_CHARS):
                    group.append(texts[at].as_py() or "")
                    size += len(group[-1])
                    at += 1
                words = [WORDS.findall(prepared(t)) for t in group]
                rows = known.rows([w for ws in words for w in ws])
                ends = np.cumsum([0, *map(len, words)])
                for i, text in enumerate(group):
                    if not words[i]:
                        rows_out.append((1, 0, 0.0, [0.0], [zlib.crc32(b"")], True))
                        continue
                    found = text_segmentations(words[i], rows[ends[i] : ends[i + 1]], known, n_best)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in found]
                    same = decode(found[0][1].tolist(), pieces) == text
                    rows_out.append((len(found), len(found[0][1]), found[0][0], [s for s, _ in found], crcs, same))
                if len(known) > CACHE_WORDS or len(known.searched) > CACHE_WORDS // 4 or len(known.ids) > CACHE_IDS:
                    known.reset()
                n, pieces_n, best, scores, crcs, same = zip(*rows_out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), pa.array(n, pa.int32()), pa.array(pieces_n, pa.int64()), pa.array(best, pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(crcs, pa.list_(pa.int64())), pa.array(same)],
                    ["doc_id", "n_found", "n_pieces", "best_score", "scores", "ids_crc32", "decodes"],
                )

    return run


def segment(docs: DataFrame, model_path: str | None = None, n_best: int = BEST) -> DataFrame:
    """The `n_best` segmentations of every whole text: doc_id, n_found, n_pieces, best_score, scores, ids_crc32, decodes.

    scores and ids_crc32 are best first; ids_crc32 is over little-endian unsigned 32-bit ids; decodes tells whether
    the best one decodes to the text. Null and empty texts have the one segmentation without pieces. Equal scores
    go by the place of the word that changes first, within a word by the order of the search. Null and repeated
    doc_ids keep their rows; further columns are ignored.
    """
    schema = "doc_id long, n_found int, n_pieces long, best_score double, scores array<double>, ids_crc32 array<long>, decodes boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_segment(model_path, n_best), schema)


def op10_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(read_table(spark, sf_dir, "documents"))
