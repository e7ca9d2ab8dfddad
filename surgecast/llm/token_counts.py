"""Token counts of whole texts, with huge documents cut into overlapping chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

END = "<|endoftext|>"
END_ID = 50256
#: Texts of more code points than this are cut into chunks of this size.
CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Chunks that one task encodes, about.
CHUNKS = 32


@lru_cache(2)
def _exact(name: str):
    """The reference tokenizer, which also gives offsets."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@lru_cache(2)
def _ranks(name: str):
    """The same vocabulary and merges as ranks, four times as fast; ``None`` where there is no such file."""
    import os

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(name.replace(".json", ".tiktoken"))
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: END_ID})


def _plain(text: str) -> bool:
    """Latin letters and general punctuation, with no very long word: here both libraries are known to agree."""
    return (text.isascii() or max(text) < "ɐ") and (len(text) < 4000 or max(map(len, text.split()), default=0) < 4000)


def count_tokens(text: str, name: str) -> int:
    fast = _ranks(name)
    if fast is not None and _plain(text):
        return len(fast.encode(text, allowed_special="all"))
    return len(_exact(name).encode(text, add_special_tokens=False).ids)


def stable_boundary(text: str, start: int, stop: int) -> int | None:
    """First position in [start, stop) with white space right after anything else.

    No pre-token of the byte-level pattern has white space behind another character, and
    no special string holds white space, so every encoding of any text around it has a
    token boundary there.
    """
    for i in range(max(start, 1), min(stop, len(text))):
        if text[i].isspace() and not text[i - 1].isspace() and text[i] not in "\x1c\x1d\x1e\x1f":
            return i
    return None


def count_between(text: str, lo: int, hi: int, name: str) -> int | None:
    """Tokens of ``text`` that lie in [lo, hi); ``None`` if either is no token boundary."""
    ends = [b for _, b in _exact(name).encode(text, add_special_tokens=False).offsets]
    at = np.asarray(ends, dtype=np.int64)
    for edge in (lo, hi):
        if 0 < edge < len(text) and not (at == edge).any():
            return None
    return int(((at > lo) & (at <= hi)).sum())


def _whole(name: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, n_bytes = [], []
            for text in batch.column("text").to_pylist():
                n_bytes.append(len(text.encode()))
                n_tokens.append(count_tokens(text, name) if len(text) <= chunk else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _pieces(name: str, chunk: int):
    """Tokens between the boundaries that this chunk and its neighbours agree on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, overlap, more = row["body"], row["overlap"], row["more"]
                # Chunks but the first bring the code point before them along.
                extra = int(row["piece"] > 0)
                left = stable_boundary(text, 1, 1 + overlap) if extra else 0
                right = stable_boundary(text, extra + chunk, extra + chunk + overlap) if more else len(text)
                ok = left is not None and right is not None
                out.append(count_between(text, left, right, name) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.int64())], names=["key", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    Texts up to ``chunk`` code points are encoded whole where they lie. A longer one is cut
    into chunks that overlap their successor by ``overlap`` code points and are dealt over
    the cluster; each is encoded with offsets, and neighbours are spliced at the first
    stable boundary of their overlap (``stable_boundary`` says why both have it; the
    offsets are checked). A document with an overlap without such a boundary is cut
    or where the offsets show none is cut anew with eight times the overlap, until the
    overlap covers it whole.

    Nulls count as empty texts; ids may be of any type, null or repeated, and keep a row
    each; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = materialise(rows.mapInArrow(_whole(tokenizer, chunk), f"doc_id {kind}, n_bytes long, n_tokens long"), "tokens")
    done = whole.filter("n_tokens is not null")
    # Huge texts are told apart by place, since ids may repeat or be null.
    left = materialise(rows.filter(F.length("text") > chunk).select("doc_id", "text", F.monotonically_increasing_id().alias("key")), "huge")
    counted = []
    while chunks := left.agg(F.sum(F.ceil(F.length("text") / F.lit(chunk)))).first()[0]:
        n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
        at = F.explode(F.sequence(F.lit(0), n - 1))
        cut = left.select("key", "text", F.length("text").alias("len"), at.alias("piece")).select(
            "key", "piece", F.lit(overlap).alias("overlap"), ((F.col("piece") + 1) * chunk < F.col("len")).alias("more"),
            F.substring("text", F.col("piece") * chunk + F.when(F.col("piece") > 0, 0).otherwise(1), F.lit(chunk + overlap + 1)).alias("body"),
        )
        sums = cut.repartition(-(-chunks // CHUNKS), "key", "piece").mapInArrow(_pieces(tokenizer, chunk), "key long, n_tokens long").groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"), F.count("n_tokens").alias("good"), F.count("*").alias("all"))
        sums = materialise(sums, "spliced")
        sized = left.select("key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
        counted.append(sized.join(sums.filter("good = all").select("key", "n_tokens"), "key").select("doc_id", "n_bytes", "n_tokens"))
        left = materialise(left.join(sums.filter("good < all").select("key"), "key", "left_semi").select("doc_id", "text", "key"), "huge")
        overlap *= 8
        if overlap > chunk:
            chunk = overlap
    for part in counted:
        done = done.unionAll(part)
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
