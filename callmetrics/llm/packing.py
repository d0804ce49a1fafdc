"""Packing of documents into sequences of a fixed length by bounded-space best fit.

Each document is encoded and gets an end token. Every partition keeps at most ``open_windows`` windows open. What a
document has beyond whole sequences is placed into the open window with the least room that takes it. Where none does,
a new window is opened, or else the fullest is emitted: as it is if at most ``most_padding`` tokens are missing, and
otherwise filled up with the first tokens of the document at hand, whose rest is placed in turn. So a sequence that is
emitted lacks ``most_padding`` tokens at most, and only what finds no place whole is cut.

Windows still open when a partition ends are leftovers. They are merged at last: put end to end, by running sums over
the partitions, and cut where a sequence is full; what then remains of the last one is dealt into sequences whose
lengths are powers of two, which need no padding. Leftovers are ``open_windows`` windows a partition, whatever its size.

The published vocabulary's ranks are read from the tokenizer file; if its merges are the ranks' order, as they are in
the usual byte-level file, the faster of the two public libraries encodes, and otherwise the file's own. Both give the
same ids. Long texts are encoded in stretches cut where the split pattern ends a word anyway, in a space between letters.

Defined results: a null text is empty and gives the end token alone; texts of any length are encoded whole; repeated
rows are documents of their own; an empty table gives no pieces; a document's other columns are not looked at.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmetrics.llm.common import cut, small_or_not, stored
from callmetrics.llm.mixing import range_starts, running_before

#: Characters of a stretch of a long text, at least.
STRETCH = 1 << 18
#: Tokens of a batch of pieces, about.
BATCH_TOKENS = 1 << 20
#: The split pattern of byte-level files, a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BETWEEN_LETTERS = regex.compile(r"(?<=\p{L})(?= \p{L})")
ID = np.dtype("<u4")
_ENCODERS: dict[str, object] = {}


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level file writes each byte: printable Latin-1 stands for itself, the other bytes take
    the code points from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """``ids(text)`` as the tokenizers library gives them for a byte-level BPE file, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, letters = described["model"], byte_letters()
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self._one = self._library = None
        ranks = {}
        usual = described["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        usual &= described["normalizer"] is None and not model.get("ignore_merges") and model.get("dropout") is None
        usual &= all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in described["added_tokens"])
        if usual:
            ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
            merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
            usual = merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged)
        if usual:
            import tiktoken

            self._one = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        else:
            self._library = Tokenizer.from_file(path)
        self._special = set(special)

    def ids(self, text: str) -> np.ndarray:
        if self._one is None:
            return np.array(self._library.encode(text, add_special_tokens=False).ids, ID)
        return np.concatenate([self._one.encode_to_numpy(part, allowed_special=self._special).astype(ID) for part in stretches(text)])


def stretches(text: str, least: int = STRETCH) -> Iterator[str]:
    """A text in parts of ``least`` characters or more, cut before a space between two letters, where no token spans."""
    at = 0
    while len(text) - at > least and (found := BETWEEN_LETTERS.search(text, at + least)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Windows:
    """The open windows of a partition. ``place`` takes a document's tokens and returns the windows that it closes, each a
    list of pieces (doc_id, start, doc_tokens, ids); an open window's pieces wait here, ``most_open`` windows at most."""

    def __init__(self, size: int, most_open: int, most_padding: int):
        self.size, self.most_open, self.most_padding = size, most_open, most_padding
        self.room: list[tuple[int, int]] = []  # (room, window) of the open windows, in order
        self.waiting: dict[int, list[tuple]] = {}
        self.made = 0

    def place(self, doc_id, tokens: np.ndarray) -> list[list[tuple]]:
        closed, start, n = [], 0, len(tokens)
        while start < n:
            left = n - start
            if left >= self.size:
                closed.append([self._piece(doc_id, tokens, start, self.size)])
                start += self.size
                continue
            at = bisect_left(self.room, (left, -1))
            if at < len(self.room):
                room, window = self.room.pop(at)
            elif len(self.room) < self.most_open:
                room, window, self.made = self.size, self.made, self.made + 1
            else:  # it fits nowhere: the fullest is emitted
                room, window = self.room.pop(0)
                if room <= self.most_padding:
                    closed.append(self.waiting.pop(window))
                    continue
            length = min(left, room)
            self.waiting.setdefault(window, []).append(self._piece(doc_id, tokens, start, length))
            start += length
            if room == length:
                closed.append(self.waiting.pop(window))
            else:
                insort(self.room, (room - length, window))
        return closed

    @staticmethod
    def _piece(doc_id, tokens: np.ndarray, start: int, length: int) -> tuple:
        return doc_id, start, len(tokens), tokens[start : start + length].tobytes()

    def leave(self) -> tuple[list[list[tuple]], list[list[tuple]]]:
        """The windows full enough to be emitted, and the leftovers."""
        full = [self.waiting[w] for room, w in self.room if room <= self.most_padding]
        return full, [self.waiting[w] for room, w in self.room if room > self.most_padding]


def placed_pieces(documents: DataFrame, path: str, end_id: int, size: int, open_windows: int, most_padding: int) -> DataFrame:
    """(part, window, open, offset, doc_id, start, doc_tokens, ids) of every piece as its partition places it. Windows
    and leftovers of a partition are numbered from 0, each by themselves."""
    schema = f"part int, window long, open boolean, offset long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, start long, doc_tokens long, ids binary"
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end, encode = TaskContext.get().partitionId(), np.array([end_id], ID), encoder(path).ids
        windows = Windows(size, open_windows, most_padding)
        rows: list[tuple] = []
        numbers, held, types = [0, 0], 0, []

        def take(window: list[tuple], is_open: bool) -> int:
            offset, number = 0, numbers[is_open]
            for doc_id, start, n, ids in window:
                rows.append((part, number, is_open, offset, doc_id, start, n, ids))
                offset += len(ids) // ID.itemsize
            numbers[is_open] += 1
            return offset

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for taken in batches:
            doc_ids, texts = taken.column("doc_id"), taken.column("text")
            types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), doc_ids.type, pa.int64(), pa.int64(), pa.binary()]
            for doc_id, text in zip(doc_ids, texts):
                tokens = np.concatenate([encode(text.as_py() or ""), end])
                held += sum(take(window, False) for window in windows.place(doc_id.as_py(), tokens))
                if held > BATCH_TOKENS:
                    yield batch()
                    rows, held = [], 0
        full, left = windows.leave()
        for window in full:
            take(window, False)
        for window in left:
            take(window, True)
        if rows:
            yield batch()

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def merged(leftovers: DataFrame, size: int) -> DataFrame:
    """Leftover pieces (part, window, offset, ..., ids) as pieces of full sequences and, from the last, of lengths that are
    powers of two: with ``number``, the sequence's among the merged, in place of part and window."""
    fills = cut(leftovers.groupBy("part", "window").agg((F.sum(F.octet_length("ids")) / ID.itemsize).cast("long").alias("fill")))
    total = fills.agg(F.coalesce(F.sum("fill"), F.lit(0))).first()[0]
    whole, rest = total // size, powers(total % size)
    tail = [whole * size + sum(rest[:i]) for i in range(len(rest))]  # where the last sequences begin
    begun = running_before(fills, range_starts(fills, [], "part", "fill"), ["part"], [F.col("window")], "fill", "begin").select("part", "window", "begin")
    lined_up = leftovers.join(begun, ["part", "window"]).withColumn("at", F.col("begin") + F.col("offset")).withColumn("to", F.col("at") + F.octet_length("ids") / ID.itemsize)
    long = lambda c: c.cast("long")
    first, last = long(F.floor(F.col("at") / size)) + 1, long(F.ceil(F.col("to") / size)) - 1
    grid = F.when(last >= first, F.transform(F.sequence(first, last), lambda x: x * size)).otherwise(F.array().cast("array<long>"))
    tails = F.filter(F.array(*[F.lit(x).cast("long") for x in tail]).cast("array<long>"), lambda x: (x > F.col("at")) & (x < F.col("to")))
    begins = F.array_sort(F.array_distinct(F.concat(F.array("at"), grid, tails)))
    parted = lined_up.withColumn("begins", begins).select("*", F.posexplode("begins").alias("i", "here"))
    until = long(F.coalesce(F.try_element_at("begins", F.col("i") + 2), F.col("to")))
    skipped = F.col("here") - F.col("at")
    ids = F.substring(F.col("ids"), (skipped * ID.itemsize + 1).cast("int"), ((until - F.col("here")) * ID.itemsize).cast("int"))
    number, offset = F.floor(F.col("here") / size), F.col("here") % size
    for i, begin in enumerate(tail):
        inside = F.col("here") >= begin
        number, offset = F.when(inside, whole + i).otherwise(number), F.when(inside, F.col("here") - begin).otherwise(offset)
    return parted.select("doc_id", (F.col("start") + skipped).alias("start"), "doc_tokens", ids.alias("ids"), long(number).alias("number"), long(offset).alias("offset"))


def pack(documents: DataFrame, path: str, end_id: int, size: int = 2048, open_windows: int = 64, most_padding: int = 4) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (unsigned 32-bit little-endian).

    Sequences have at most ``size`` tokens, a power of two; ``most_padding`` bounds what one may lack. They are numbered
    from 0 without gaps, by partition, and the merged ones last.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("the length of a sequence must be a power of two")
    placed = stored(placed_pieces(documents, path, end_id, size, open_windows, most_padding), "packing")
    counts = cut(placed.where("not open").groupBy("part").agg((F.max("window") + 1).alias("made")))
    starts = small_or_not(cut(range_starts(counts, [], "part", "made")))  # a row for each partition
    total = counts.agg(F.coalesce(F.sum("made"), F.lit(0))).first()[0]
    kept = ["doc_id", "start", "doc_tokens", "offset", "ids"]
    closed = placed.where("not open").join(starts, "part").select(*kept, (F.col("_start") + F.col("window")).cast("long").alias("sequence_id"))
    late = merged(placed.where("open"), size).select(*kept, (F.lit(total) + F.col("number")).cast("long").alias("sequence_id"))
    length = (F.octet_length("ids") / ID.itemsize).cast("long").alias("length")
    return closed.unionByName(late).select("doc_id", "start", length, "doc_tokens", "sequence_id", "offset", "ids")
