"""Packing of token pieces into fixed-length sequences by their length histogram."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, small_table

MAX_LEN = 4096
END_ID = 2
#: Rows of one length that are ranked in one task.
RANKED = 2_000
#: Pieces handed back in one batch.
PIECES = 2_000
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


@lru_cache(2)
def _exact(name: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next free one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The pre-tokens of this vocabulary, as its file states them, all but the runs
#: of letters that they leave between them; with white space that this syntax does not count.
BETWEEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\x0b\xa0\p{L}\p{N}]+"
#: Letters beyond Latin ones, control separators, the letter whose lower case has two code points, and special strings.
ODD = "[\x1c-\x1f\x85\u0130\u0250-\U0010ffff]|" + "|".join(regex.escape(s) for s in SPECIAL)
#: Marks the end of a text, and from ``APART`` on texts that are encoded apart; no other text holds such characters.
END, APART = "\ue000", 0xF0000


def _spread(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], one after another."""
    stops = np.cumsum(sizes)
    at = np.repeat(starts - stops + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


class _Words:
    """Token ids of pre-tokens, kept for up to ``most`` of them.

    This vocabulary's tokenizer drops white space and never merges across pre-tokens, so a
    text's ids are those of its pre-tokens, in order. A pre-token is encoded once, by the
    tokenizer's own merges, without its normaliser, which leaves ``_plain`` texts in lower
    case as they are; its ids lie at its slot in ``flat``. Slot 0 is empty, slot 1 the end
    of a text. When there is no more room, the pre-tokens of the last batch stay.
    """

    def __init__(self, name: str, end_id: int, most: int = 400_000):
        self.tokenizer, self.most = _exact(name), most
        self.tokenise, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.ends = np.array([end_id], np.uint32)
        self._keep([], np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _keep(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.slots = {w: i for i, w in enumerate(["", END, *words])}
        self._grow(np.concatenate([[0, 1], sizes]), np.concatenate([self.ends, flat]))

    def _grow(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.sizes, self.flat, self.starts = sizes, flat, np.cumsum(sizes) - sizes

    def encode(self, word: str) -> list[int]:
        if not (word.isascii() and word.isalpha()):
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenise(word)]

    def learn(self, words: list[str]) -> np.ndarray:
        """Slots of distinct ``words``, which are known from then on."""
        found = list(map(self.slots.get, words))
        if None not in found:
            return np.array(found, np.int64)
        slots = np.array([-1 if s is None else s for s in found], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(self.slots) + len(new) > self.most:
            old = np.flatnonzero(slots > 1)
            sizes = self.sizes[slots[old]]
            self._keep([words[i] for i in old.tolist()], sizes, _spread(self.starts[slots[old]], sizes, self.flat))
            slots[old] = np.arange(2, len(old) + 2)
        fresh = [words[i] for i in new.tolist()]
        ids = list(map(self.encode, fresh))
        first = len(self.slots)
        self.slots.update(zip(fresh, range(first, first + len(fresh))))
        slots[new] = np.arange(first, first + len(fresh))
        self._grow(np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))]), np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)]))
        return slots

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the tokens of all texts, each followed by its end, and how many each has."""
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(odd, pa.scalar(""), texts)), BETWEEN, r" \0 ")
        apart = [self.ids(t) for t in texts.filter(odd).to_pylist()]
        if apart:
            marks = iter(range(APART, APART + len(apart)))
            plain = pc.if_else(odd, pa.array([chr(next(marks)) if o else "" for o in odd.to_pylist()]), plain)
        words = pc.utf8_split_whitespace(pc.binary_join_element_wise(plain, END, " ")).flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        # Texts encoded apart follow the known ids, for this batch only.
        at = {chr(APART + k): k for k in range(len(apart))}
        slots = self.learn(["" if w in at else w for w in distinct] if apart else distinct)
        sizes, flat, starts = self.sizes, self.flat, self.starts
        if apart:
            sizes = np.concatenate([sizes, list(map(len, apart))])
            flat = np.concatenate([flat, *apart])
            starts = np.cumsum(sizes) - sizes
            for i, w in enumerate(distinct):
                if w in at:
                    slots[i] = len(self.sizes) + at[w]
        slots = slots[words.indices.to_numpy()]
        each = sizes[slots]
        ends = np.cumsum(each)[slots == 1]
        return _spread(starts[slots], each, flat), np.diff(ends, prepend=0)


@lru_cache(2)
def _words(name: str, end_id: int = END_ID) -> _Words:
    return _Words(name, end_id)


def _plain(text: str) -> bool:
    """Latin letters and general punctuation without control separators or special strings: pre-tokens may be encoded apart."""
    return not pc.match_substring_regex(pa.scalar(text), ODD).as_py()


def _tokenise(name: str, max_len: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(name, end_id)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = words.documents(batch.column("text"))
            pieces = -(-sizes // max_len)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * max_len
            length = np.minimum(max_len, sizes[doc] - start)
            stop = np.cumsum(length)
            data = ids.astype("<u4", copy=False)
            for a in range(0, len(doc), PIECES):
                b = min(a + PIECES, len(doc))
                low = int(stop[a] - length[a])
                offsets = 4 * np.concatenate([[0], stop[a:b] - low])
                part = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[low : int(stop[b - 1])])])
                cols = [batch.column("doc_id").take(pa.array(doc[a:b])), pa.array(start[a:b]), pa.array(length[a:b]), part, pa.array(sizes[doc[a:b]])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens: every document cut at multiples of ``max_len``.

    A document is its tokens and ``end_id``; nulls count as empty texts, so every row gives
    at least one piece. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_tokenise(tokenizer, max_len, end_id)), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, packs, first sequence, offset): where the pieces of each length go.

    Lengths are placed longest first, each into the pack with the most room. Packs filled
    alike are one pattern with a count, a range of sequence numbers, so the work depends
    on the number of lengths and never on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    widest = 0
    placed, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while widest and not room.get(widest):
                room.pop(widest, None)
                widest = max(room, default=0)
            if widest >= length:
                first, packs = room[widest].pop()
                used = min(left, packs)
                offset = max_len - widest
                if packs > used:
                    room[widest].append((first + used, packs - used))
            else:
                first, used, offset = sequences, left, 0
                sequences += left
            placed.append((length, rank, used, first, offset))
            if (rest := max_len - offset - length) > 0:
                room.setdefault(rest, []).append((first, used))
                widest = max(widest, rest)
            rank += used
            left -= used
    return placed


def _rank(pieces: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """``rank`` from 0 within each length; a length with many pieces is ranked in parts of about ``RANKED``."""
    spark = pieces.sparkSession
    parts = {k: -(-n // RANKED) for k, n in counts.items()}
    n_parts = small_table(spark, {"length": list(parts), "n": list(parts.values())}, {"length": _I64, "n": _I64})
    # One row per length: at most max_len rows.
    dealt = pieces.join(F.broadcast(n_parts), "length").withColumn("part", F.pmod(F.xxhash64(*order), F.col("n"))).drop("n")
    sizes = dealt.groupBy("length", "part").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    return dealt.withColumn("rank", inside).join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


_I64 = pa.int64()


def pack(pieces: DataFrame, max_len: int = MAX_LEN, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add sequence_id (from 0, without gaps) and offset to pieces with a ``length`` of 1 to ``max_len``.

    The driver sees the histogram, at most ``max_len`` numbers; the pattern ranges made
    from it are matched by (length, rank) with a binary search in each task. ``order``
    ranks the pieces of one length; pieces that agree in it are told apart arbitrarily,
    once, since the ranks are written down before they are used.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if counts and not (1 <= min(counts) and max(counts) <= max_len):
        raise ValueError(f"lengths must be 1 to {max_len}, got {min(counts)} to {max(counts)}")
    placed = np.asarray(shortest_pack_first(counts, max_len), dtype=np.int64).reshape(-1, 5)
    key = placed[:, 0] << 44 | placed[:, 1]
    by_key = np.argsort(key)
    key, first, offset = key[by_key], placed[by_key, 3], placed[by_key, 4]
    ranked = materialise(_rank(pieces, counts, list(order)), "ranked")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                want = batch.column("length").to_numpy() << 44 | batch.column("rank").to_numpy()
                at = np.searchsorted(key, want, side="right") - 1
                names = [n for n in batch.schema.names if n != "rank"]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(first[at] + want - key[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(lean(place), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_len: int = MAX_LEN) -> DataFrame:
    """Token pieces of whole documents with their place: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return pack(materialise(token_pieces(docs, tokenizer, max_len), "pieces"), max_len)
