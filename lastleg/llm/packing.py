"""Packing token pieces into sequences of a fixed capacity by exact complements.

Documents become token ids and an end id; only documents longer than the capacity are cut. The
packing itself works on the number of pieces of each length, at most ``capacity`` numbers whatever the
corpus holds: for each length, longest first, the gap it leaves is looked up among the available single,
pair and triple length sums, and each combination that fills it exactly is consumed as often as the
counts allow. What remains is packed best-fit, longest first, whole groups of equal sequences at a time.
The resulting patterns say how many sequences take which lengths. Spark then numbers the pieces of
each length and reads off a piece's sequence and offset from its number, so no piece passes through the driver.

Tokens of a text are the tokens of its chunks between white space: the tokenizer drops white space and
no token spans it. Each worker keeps bounded dictionaries of what it has met. Texts in
which this could differ (special token strings, separators that only Python counts as white space) are encoded whole.

Defined cases: a null or empty text is the end id alone; rows with equal doc_id are packed as rows of
their own; null doc_ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import numbered, stage_texts

CAPACITY = 2048
END_ID = 0
_ENCODE_WHOLE = r"<\||[\x1c-\x1f]"
# ASCII but for the apostrophe, with which the tokenizer has words of its own, and composed Latin letters, whose
# lower case takes no context and needs no composing.
_PLAIN = r"\A[ \t\n\r!-&(-~\x{c0}-\x{ff}]*\z"
_ROWS = 1000  # texts encoded at once
_TOGETHER = 100  # words encoded at once
_PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


class ChunkEncoder:
    """Token ids of texts through a dictionary of the chunks between white space.

    Texts of plain letters are first put into lower case, with blanks around their punctuation and
    digits, just as the tokenizer splits them, so their chunks are its words and few. Arrow finds
    and numbers the chunks; each different one is looked up once a batch. A full dictionary keeps what it
    has: the frequent ones come early.
    """

    def __init__(self, tokenizer_file: str | None = None, most_chunks: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        import public_tokenizers
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file or public_tokenizers.path("word_bpe_49k.json"))
        vocabulary = self._tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self._last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._most = most_chunks
        self._known: dict[str, bytes] = {"": b""}

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without nulls."""
        whole = np.nonzero(np.asarray(pc.match_substring_regex(texts, _ENCODE_WHOLE)))[0]
        apart = [self._encode([t])[0] for t in texts.take(pa.array(whole, pa.int64())).to_pylist()]
        chosen = np.ones(len(texts), bool)
        chosen[whole] = False
        texts = pc.if_else(pa.array(chosen), texts, "")
        lists = pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _PLAIN), self._spaced(texts), texts))
        coded = lists.flatten().dictionary_encode()
        different = self._look_up(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, different), np.int64, len(different)) // 4
        ids = np.frombuffer(b"".join(different), "<u4")
        which = np.asarray(coded.indices)
        length = sizes[which]
        end = np.cumsum(length)
        shift = (np.cumsum(sizes) - sizes)[which] - (end - length)
        tokens = ids[np.repeat(shift, length) + np.arange(int(end[-1]) if len(end) else 0)]
        bounds = np.concatenate([[0], end])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        out = [tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, data in zip(whole, apart, strict=True):
            out[i] = np.frombuffer(data, "<u4")
        return out

    @staticmethod
    def _spaced(texts: pa.Array) -> pa.Array:
        runs = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\s\p{L}\p{N}]+)", r" \1 ")
        return pc.replace_substring_regex(runs, r"(\p{N})", r" \1 ")

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self._known.get, chunks))
        if None in found:
            new = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
            extra = dict(zip(new, self._encode(new), strict=True))
            if len(self._known) < self._most:
                self._known.update(extra)
            found = [extra[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return found

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids. Words of letters are encoded many at once and told apart by their last tokens."""
        out: list[bytes] = [b""] * len(chunks)
        words = [i for i, c in enumerate(chunks) if c.isalpha()]
        others = [i for i, c in enumerate(chunks) if not c.isalpha()]
        groups = [words[at: at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        for group, encoded in zip(groups, self._ids([" ".join([chunks[i] for i in g]) for g in groups]), strict=True):
            ends = np.nonzero(self._last[encoded])[0] + 1
            if len(ends) != len(group):
                others += group
                continue
            for i, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = encoded[a:b].tobytes()
        for i, encoded in zip(others, self._ids([chunks[i] for i in others]), strict=True):
            out[i] = encoded.tobytes()
        return out

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 5000):
            for e in self._tokenizer.encode_batch_fast(texts[at: at + 5000], add_special_tokens=False):
                yield np.array(e.ids, "<u4")


_encoders: dict[str | None, ChunkEncoder] = {}


def worker_encoder(tokenizer_file: str | None) -> ChunkEncoder:
    """The encoder of this Python worker: its dictionaries serve all tasks that run there."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = ChunkEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(tokenizer_file)
        end = np.array([END_ID], dtype="<u4")
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            texts = encode(pc.fill_null(batch.column(1), ""))
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                data = np.concatenate([text, end])
                for piece, at in enumerate(range(0, len(data), capacity)):
                    part = data[at: at + capacity]
                    rows.append((doc_id, piece, at, len(part), zlib.crc32(part)))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = _PIECE + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using up ``counts`` of pieces by length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> bool:
        times = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        if times:
            for x in lengths:
                left[x] -= times
            patterns.append((lengths, times))
        return times > 0

    def pair(gap: int, leader: int, third: int = 0) -> tuple[int, int] | None:
        """Two available lengths with this sum, the most unequal pair first."""
        small = np.arange(1, gap // 2 + 1)
        for a in small[(left[small] > 0) & (left[gap - small] > 0)]:
            use = (leader, int(a), gap - int(a)) + ((third,) if third else ())
            if all(left[x] >= use.count(x) for x in use):
                return gap - int(a), int(a)
        return None

    if left[capacity]:
        patterns.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for leader in range(capacity - 1, 0, -1):
        gap = capacity - leader
        if left[leader] and left[gap]:
            consume((leader, gap))
        while left[leader] and (found := pair(gap, leader)):
            consume((leader, *found))
        thirds = [int(c) for c in np.nonzero(left[: max(gap - 1, 0)])[0][::-1]]
        for third in thirds:
            while left[leader] and left[third] and (found := pair(gap - third, leader, third)):
                consume((leader, third, *found))
            if not left[leader]:
                break
    return patterns + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: groups of equal sequences are filled together."""
    gaps: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((pattern, times))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(n, capacity // length)
                put((length,) * each, n // each)
                n %= each
                continue
            gap = gaps[at]
            pattern, times = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            used = min(n, times)
            if times > used:
                put(pattern, times - used)
            put((*pattern, length), used)
            n -= used
    return [group for gap in gaps for group in groups[gap]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, copies in a sequence, first sequence, offset), by first number."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            out.setdefault(length, []).append((used.get(length, 0), copies, base, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        base += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is a stored table with a row for each piece."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan_patterns(counts, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.nonzero(length == x)[0]
                first, copies, base, start = slots[int(x)].T
                i = np.searchsorted(first, rank[at], side="right") - 1
                turn = rank[at] - first[i]
                sequence[at] = base[i] + turn // copies[i]
                offset[at] = start[i] + turn % copies[i] * x
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"],
            )

    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its place; ``with_ids`` adds its token ids."""
    return pack(stage_texts(token_pieces(docs, capacity, tokenizer_file, with_ids), "pieces"), capacity)
