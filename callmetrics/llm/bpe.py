"""Byte-pair encoding and decoding with a published vocabulary by prefix-sharing trie traversal.

The distinct words of a batch are put into a trie. A depth-first walk gives every node, a prefix, the last token of
that prefix's encoding; it is the one token that ends there and stands beside the last token of the shorter prefix
unchanged. So what words have in common at their beginning is encoded once, and a word's ids are read off backwards
along its path. Whether two tokens may stand side by side is decided by replaying the merges along their common
border and kept.

The file describes the usual word-end BPE: special strings are cut out of the raw text, the rest is put into NFC,
lower-cased character by character, split by the file's pattern, mapped from bytes to letters and merged, the
last letter of a word carrying the word-end mark.

Defined results: a null text counts as empty and gives no ids and an empty decoded text; whole texts of any length
are encoded; repeated rows give repeated rows; an empty table gives none; other columns pass through as they are,
save that columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NEVER = 1 << 60
#: Unicode White_Space, the blanks of the split pattern. str.split() knows four control characters more.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN_ENDS = frozenset(".,:;!?")
ODD_BLANKS = regex.compile("[\x1c-\x1f]")
SPLIT_ON_BLANKS = regex.compile(f"[{BLANK}]+")
#: Letters and digits assigned after Unicode 16, which the tokenizers library doesn't know as such.
LATER = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Capitals of Unicode 16 and 17 and their small letters.
CASES_16 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CASES_16 |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
RARE_CAPITALS = regex.compile("[" + "".join(map(chr, CASES_16)) + "]")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """A printable letter for every byte: printable Latin-1 stands for itself, the others for the code points from 256."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for one vocabulary file (the JSON text of a ``tokenizers`` BPE model)."""

    def __init__(self, file_text: str, keep_words: int = 300_000):
        spec = json.loads(file_text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for text, i in chain(self.vocab.items(), self.special.items()):
            self.tokens[i] = text
        self.rank: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.vocab[left], self.vocab[right]
            made = self.vocab[left + right]
            self.rank[a, b] = at
            self.made_by.setdefault(made, (at, a, b))
        #: By last two letters: letters of the longest token that ends so, inside a word and at its end.
        self.reach: dict[str, int] = {}
        self.reach_end: dict[str, int] = {}
        for text in self.vocab:
            at_end = bool(self.end) and text.endswith(self.end)
            plain = text[: -len(self.end)] if at_end else text
            table = self.reach_end if at_end else self.reach
            table[plain[-2:]] = max(table.get(plain[-2:], 1), len(plain))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(pattern.replace(r"[^\s", f"[^{BLANK}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special))
        self.shown = {b: letter for b, letter in enumerate(byte_letters())}
        self.side_by_side: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.older_words: dict[str, tuple[int, ...]] = {}
        self.older_chunks: dict[str, tuple[int, ...]] = {}
        self.keep_words = keep_words

    # -- borders -----------------------------------------------------------------------------------------------

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """What stands at a token's right or left edge over time: (piece, rank of the merge that ends its time)."""
        steps: list[tuple[int, int]] = []
        until = NEVER
        while True:
            steps.append((token, until))
            if token not in self.made_by:
                return steps[::-1]
            until, a, b = self.made_by[token]
            token = b if right else a

    def _apart(self, first: int, second: int) -> bool:
        """Whether no merge crosses the border of two tokens while each of them is built."""
        lefts, rights = self._edge(first, True), self._edge(second, False)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            crossing = self.rank.get((a, b), NEVER)
            if crossing < a_until and crossing <= b_until and crossing < NEVER:
                return False
            if a_until == b_until == NEVER:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _is_sound(self, token: int) -> bool:
        """Whether a token's own letters are encoded as that token alone."""
        known = self.sound.get(token)
        if known is None:
            made = self.made_by.get(token)
            known = made is None or (self._is_sound(made[1]) and self._is_sound(made[2]) and self._only_merge(made))
            self.sound[token] = known
        return known

    def _only_merge(self, made: tuple[int, int, int]) -> bool:
        """Whether two sound tokens meet unbroken until the merge of the given rank."""
        at, first, second = made
        lefts, rights = self._edge(first, True), self._edge(second, False)
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = lefts[i], rights[j]
            if a_until == b_until == NEVER:
                return self.rank.get((a, b), NEVER) == at
            crossing = self.rank.get((a, b), NEVER)
            if crossing < a_until and crossing <= b_until:
                return False
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _may_follow(self, first: int, second: int) -> bool:
        pair = (first, second)
        known = self.side_by_side.get(pair)
        if known is None:
            if len(self.side_by_side) > 2_000_000:
                self.side_by_side.clear()
            known = self.side_by_side[pair] = self._apart(first, second)
        return known

    # -- trie --------------------------------------------------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct non-empty words, given in byte letters, from one walk over their trie.

        The trie is held as its words in order: that is its depth-first order, and going on from one word to the next
        leaves the states of their common beginning standing on the stacks ``tokens`` and ``sizes``.
        """
        vocab, sound, beside, end = self.vocab, self.sound, self.side_by_side, self.end
        reach, reach_end = self.reach, self.reach_end
        out: dict[str, tuple[int, ...]] = {}
        tokens, sizes = [-1], [0]  # by depth: last token of the prefix and its letters
        before = ""
        for word in sorted(words):
            inner = len(word) - 1
            depth, most = 0, min(len(tokens) - 1, inner)
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del tokens[depth + 1 :], sizes[depth + 1 :]
            while True:
                depth += 1
                last = depth > inner  # the last letter carries the word end and is a leaf
                n = (reach_end if last else reach).get(word[depth - 2 : depth] if depth > 1 else "", 1)
                if n > depth:
                    n = depth
                while n:
                    token = vocab.get(word[depth - n :] + end if last else word[depth - n : depth])
                    if token is not None and (sound.get(token) or self._is_sound(token)):
                        if n == depth:
                            break
                        pair = (tokens[depth - n], token)
                        fits = beside.get(pair)
                        if fits or (fits is None and self._may_follow(*pair)):
                            break
                    n -= 1
                else:
                    raise ValueError(f"the vocabulary has no letter {word[depth - 1]!r}")
                if last:
                    break
                tokens.append(token)
                sizes.append(n)
            ids = [token]
            at = depth - n
            while at:
                ids.append(tokens[at])
                at -= sizes[at]
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    # -- texts -------------------------------------------------------------------------------------------------

    def _letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)

    def _split(self, plain: str) -> list[str]:
        """Words by the file's pattern; letters that came after Unicode 16 count as symbols."""
        if plain.isascii() or not LATER.search(plain):
            return self.piece.findall(plain)
        known = LATER.sub("\ue000", plain)
        return [plain[m.start() : m.end()] for m in self.piece.finditer(known)]

    @staticmethod
    def _plain(part: str) -> str:
        """NFC and small letters, character by character."""
        if part.isascii():
            return part.lower()
        part = unicodedata.normalize("NFC", part)
        if not _is_latin(part):
            part = part.replace("Σ", "σ")
            if RARE_CAPITALS.search(part):
                part = part.translate(CASES_16)
        return part.lower()

    def learn(self, chunks: set[str]) -> None:
        """Make the ids of all given chunks, which are plain and without blanks, known."""
        if len(self.chunks) > self.keep_words:  # what the next generation asks for again moves over to it
            self.older_chunks, self.chunks = self.chunks, {}
            self.older_words, self.words = self.words, {}
        missing = chunks - self.chunks.keys()
        again = missing & self.older_chunks.keys()
        self.chunks.update(zip(again, map(self.older_chunks.__getitem__, again), strict=True))
        fresh = missing - again
        letters = self._letters
        single: dict[str, str] = {}
        several: dict[str, list[str]] = {}
        for chunk in fresh:
            if chunk.isalpha():
                single[chunk] = letters(chunk)
            elif chunk[-1:] in PLAIN_ENDS and chunk[:-1].isalpha():
                several[chunk] = [letters(chunk[:-1]), chunk[-1]]
            else:
                several[chunk] = [letters(w) for w in self._split(chunk)]
        unknown = set(single.values()).union(*several.values()) - self.words.keys()
        again = unknown & self.older_words.keys()
        self.words.update(zip(again, map(self.older_words.__getitem__, again), strict=True))
        self.words |= self.encode_words(unknown - again)
        words, known = self.words, self.chunks
        for chunk, word in single.items():
            known[chunk] = words[word]
        for chunk, pieces in several.items():
            known[chunk] = tuple([i for w in pieces for i in words[w]])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut: list[list[list[str] | int]] = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and self.mark in text else [text]
            cut.append([self.special[p] if p in self.special else self._chunks(self._plain(p)) for p in parts])
        self.learn(set().union(*[c for parts in cut for c in parts if type(c) is list]))
        known = self.chunks.__getitem__
        return [list(chain.from_iterable([(c,) if type(c) is int else chain.from_iterable(map(known, c)) for c in parts])) for parts in cut]

    @staticmethod
    def _chunks(plain: str) -> list[str]:
        return SPLIT_ON_BLANKS.split(plain) if ODD_BLANKS.search(plain) else plain.split()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' texts, with a space between them: the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


_loaded: dict[int, Bpe] = {}


def encode_and_decode(frame: DataFrame, vocabulary: str, text: str = "text", batch_chars: int = 2_500_000) -> DataFrame:
    """``frame`` without ``text``, with ``ids`` (array of int) and ``decoded``. ``vocabulary``: path of the JSON file.

    The file, of a fixed size, is read on the driver and broadcast. Each Python worker keeps the ids of at most
    about 600,000 distinct words and works on at most ``batch_chars`` characters, or one longer text, at a time.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shared = frame.sparkSession.sparkContext.broadcast(file.read())
    rest = [c for c in frame.columns if c not in (text, "ids", "decoded")]
    schema = T.StructType([*[frame.schema[c] for c in rest], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Bpe(shared.value)
        bpe = _loaded[key]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and (not texts or chars < batch_chars):
                    texts.append(column[at + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                ids = bpe.encode_batch(texts)
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
                made = [batch.column(batch.schema.get_field_index(c)).slice(at, len(texts)) for c in rest]
                made += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([bpe.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(made, names=[*rest, "ids", "decoded"])
                at += len(texts)

    return frame.select(*rest, text).mapInArrow(run, schema)
