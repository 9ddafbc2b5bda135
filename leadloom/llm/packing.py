"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Bins are planned on the histogram of piece lengths, which has at most `capacity` rows however
large the corpus is; documents meet their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partition_count, read_table

CAPACITY = 4096
END_ID = 1
#: The tokenizer where no path is given, and the only one whose texts are coded by remembered chunks.
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Chunks of text, and characters of them, whose ids a worker remembers; beyond either, the half met most often stays.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 8_000_000
#: Bytes of text handled at a time within a worker.
STEP_CHARS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What the tokenizer's split pattern keeps, within lower-cased Latin-1 text.
_LETTERS, _NUMBERS, _SPACES = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_KEPT = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models write for each byte: its own, or the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {b: chr(b if b in own else next(other)) for b in range(256)}


class ChunkIds(dict):
    """Index of each white-space-free chunk of lower-cased text; its ids are ids[starts[i]:starts[i]+lens[i]].

    Chunks are cut as DEFAULT_TOKENIZER cuts them; with `by_chunks` false every text goes through the tokenizer whole.
    """

    def __init__(self, tokenizer, by_chunks: bool = True):
        super().__init__()
        self.tokenizer, self.by_chunks = tokenizer, by_chunks
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        self.as_bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.new: list[str] = []
        self.chars = 0
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = i = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return i

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks of these indices, one after the other; how many ids each has)."""
        lens = self.lens[at]
        ends = np.cumsum(lens)
        return self.ids[np.repeat(self.starts[at] - (ends - lens), lens) + np.arange(int(lens.sum()))], lens

    def _add(self, ids: np.ndarray, lens: np.ndarray, at: np.ndarray) -> None:
        ends = np.cumsum(lens)
        self.starts[at], self.lens[at] = len(self.ids) + ends - lens, lens
        self.ids = np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        """Keep the chunks met most often, up to half of either limit; what was met once goes, and counts are halved."""
        names = list(self)
        often = np.argsort(-self.uses, kind="stable")[: CACHE_CHUNKS // 2]
        often = often[self.uses[often] > 1]
        sizes = np.fromiter((len(names[i]) for i in often.tolist()), np.int64, len(often))
        keep = often[np.cumsum(sizes) <= CACHE_CHARS // 2]
        self.clear()
        self.update((names[i], k) for k, i in enumerate(keep.tolist()))
        self.chars = sum(map(len, self))
        ids, lens = self.taken(keep)
        self.starts, self.lens, self.uses, self.ids = np.zeros_like(lens), lens, self.uses[keep] // 2, self.ids[:0]
        self._add(ids, lens, np.arange(len(keep)))

    def _code(self) -> None:
        """Ids of the new chunks. Words with signs are put together from their parts, which are chunks too."""
        known = len(self.starts)
        flat: list[int] = []
        alone, lens, joined, parts = [], [], [], []
        for i, chunk in enumerate(self.new, known):  # grows by the parts
            kept = _KEPT.findall(chunk)
            if len(kept) == 1:
                found = [t.id for t in self.tokenizer.model.tokenize(chunk if chunk.isascii() and chunk.isprintable() else chunk.translate(self.as_bytes))]
                flat += found
                alone.append(i)
                lens.append(len(found))
            else:
                joined.append(i)
                parts.append([self[part] for part in kept])
        more = np.zeros(len(self.new), np.int64)
        self.new = []
        self.starts, self.lens, self.uses = (np.concatenate([x, more]) for x in (self.starts, self.lens, self.uses))
        self._add(np.array(flat, dtype=np.uint32), np.array(lens, dtype=np.int64), np.array(alone, dtype=np.int64))
        if joined:
            at = np.array([i for p in parts for i in p], dtype=np.int64)
            ids, sizes = self.taken(at)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            self._add(ids, np.add.reduceat(sizes, np.cumsum(counts) - counts), np.array(joined))
            self.uses += np.bincount(at, minlength=len(self))

    def index(self, chunks: list[str]) -> np.ndarray:
        if len(self) > CACHE_CHUNKS or self.chars > CACHE_CHARS:
            self._forget()
        out = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.new:
            self._code()
        self.uses += np.bincount(out, minlength=len(self))
        return out


def _plain(text: str, added: list[str]) -> bool:
    """Texts whose chunks can be coded one by one: there NFC and lower case act on single characters,
    str.split() parts at the white space of the tokenizer's own patterns, and no added token has an id of its own."""
    if any(token in text for token in added):
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


def encode_texts(texts: list[str], cache: ChunkIds) -> list[np.ndarray]:
    """Ids of each text, equal to those of tokenizer.encode(text, add_special_tokens=False)."""
    out: list[np.ndarray | None] = [None] * len(texts)
    chunks: list[str] = []
    plain, counts, odd = [], [], []
    for i, text in enumerate(texts):
        if cache.by_chunks and _plain(text, cache.added):
            found = text.lower().split()
            chunks += found
            plain.append(i)
            counts.append(len(found))
        else:
            odd.append(i)
    if odd:
        for i, e in zip(odd, cache.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.uint32)
    if plain:
        at = cache.index(chunks)
        ids, lens = cache.taken(at)
        bounds = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        for k, i in enumerate(plain):
            out[i] = ids[bounds[k] : bounds[k + 1]]
    return out


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pieces(path: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        cache = ChunkIds(load_tokenizer(path or public_tokenizers.path(DEFAULT_TOKENIZER)), by_chunks=path is None)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            at = 0
            while at < len(doc_ids):
                group, size, first = [], 0, at
                while at < len(doc_ids) and (not group or size < STEP_CHARS):
                    group.append(texts[at].as_py() or "")
                    size += len(group[-1])
                    at += 1
                rows = []
                for doc_id, ids in zip(doc_ids[first:at], encode_texts(group, cache), strict=True):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only where they exceed `capacity`."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES)


# ---------------------------------------------------------------------------------------
# Planning on the histogram


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for counts[length] pieces of each length: [([(length, times), ...], bins alike), ...].

    A bin takes the longest piece left and then, again and again, the longest that still fits.
    When none fits, its smallest piece makes way for the two unpacked pieces that fill the widened
    gap best, if those two together are longer than it. Bins alike are planned at once.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    plan = []
    sizes = np.arange(capacity + 1)
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return plan
        below = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # longest length present up to each
        use: dict[int, int] = {}
        gap = capacity
        length = int(present[-1])
        while length:
            times = min(gap // length, int(left[length] - use.get(length, 0)))
            if times:
                use[length] = use.get(length, 0) + times
                gap -= times * length
            length = int(below[min(gap, length - 1)])
        smallest = min(use)
        if gap and sum(use.values()) > 1:
            spare = left.copy()
            for k, t in use.items():
                spare[k] -= t
            room = gap + smallest
            have = np.flatnonzero(spare[: room + 1])
            if len(have):
                upto = np.maximum.accumulate(np.where(spare > 0, sizes, 0))
                mate = upto[np.minimum(have, room - have)]  # the second is no longer than the first
                alone = (mate == have) & (spare[have] < 2)
                mate = np.where(alone, upto[np.maximum(have - 1, 0)], mate)
                both = np.where(mate > 0, have + mate, 0)
                best = int(both.argmax())
                if both[best] > smallest:
                    use[smallest] -= 1
                    for k in (int(have[best]), int(mate[best])):
                        use[k] = use.get(k, 0) + 1
        use = {k: t for k, t in use.items() if t}
        alike = min(int(left[k]) // t for k, t in use.items())
        for k, t in use.items():
            left[k] -= t * alike
        plan.append((sorted(use.items(), reverse=True), alike))


def _placer(plan, capacity: int):
    """Arrays that turn (length, rank) into (sequence_id, offset)."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, bins = [], 0
    for use, alike in plan:
        offset = 0
        for length, times in use:
            rows.append((length, taken[length], times, bins, offset))
            taken[length] += times * alike
            offset += length * times
        bins += alike
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` of 1 to `capacity`.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver. The rank within a length comes from
    counts by (length, salt), the salt from the row's own number, which is written with it: so a length that a third
    of the pieces share is dealt over all tasks, identical rows too.
    """
    spark, names = pieces.sparkSession, pieces.columns
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(_placer(plan_bins(counts, capacity), capacity))
    salts = max(256, 4 * partition_count(spark))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "__salt").count()
        .withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("count"))
        .select("length", "__salt", "__before")
    )
    own = Window.partitionBy("length", "__salt").orderBy("__row")
    ranked = salted.withColumn("__n", F.row_number().over(own) - 1).join(before, ["length", "__salt"])
    ranked = ranked.select(*names, (F.col("__before") + F.col("__n")).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] << 48 | t[:, 1]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            row = t[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 2]
            offset = row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole documents (null text: only the end id) and pack their pieces by best-two-fit.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and repeated
    doc_ids keep their rows; further columns of `docs` are ignored; no documents give no rows.
    """
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, end_id), capacity)


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
