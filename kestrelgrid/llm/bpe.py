"""Byte-level BPE with the tokenizers library over Arrow batches.

The vocabulary comes from a file of ranks. Every byte stands for one printable
character (the byte table); a token is a string of such characters. The merges
that the library needs are all splits of each token into two tokens, in order of
rank, so that any two neighbours whose union is a token can merge, as with ranks.

Texts are cut before a space that stands between two characters that aren't
white space. No match of the pattern runs across such a cut, so the parts encode
on their own, and a part seen before comes from a bounded table of the task.

Decoding looks up each id's characters and reverses the byte table. Ids are
decoded to bytes; ``decode_text`` also joins characters that two tokens split.
``token_spans`` gives code point offsets: a token that holds part of a character
covers that whole character.

Defined cases: a null or empty text has no tokens; very long texts and words
are encoded whole; repeated rows are encoded each; an empty table gives an empty
result; of other columns those named in ``keep`` stay, under a name with a
leading underscore if it is that of a new column, in whatever case.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .cluster import map_arrow, quoted

#: Parts kept during a task, about 200 bytes each; a Python worker gives them back for its next task.
KEPT_PARTS = 250_000
_CUT = re.compile(r"(?<=[^\s])(?=\x20[^\s])")


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Codec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        chars = byte_table()
        spell = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        vocab = {spell[t]: r for t, r in ranks.items()}
        merges = [(spell[t[:k]], spell[t[k:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        # a match that is a token as a whole needs no merging
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        self.spelled = [""] * size
        for t, r in ranks.items():
            self.spelled[r] = spell[t]
        pieces = [bytes(map(back.__getitem__, s)) for s in self.spelled]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str | None], kept_parts: int = KEPT_PARTS) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        parts = self.parts
        fresh = list({p for c in cut for p in c if p not in parts})
        if len(parts) + len(fresh) > kept_parts:
            parts.clear()
            fresh = list({p for c in cut for p in c})
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                parts[p] = np.array(e.ids, "<u4").tobytes()
        return [b"".join(map(parts.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.flat[at].tobytes()

    def decode_text(self, ids: bytes) -> str:
        """Characters split between tokens come together here; bytes that form none become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def token_spans(self, ids: bytes) -> list[tuple[int, int]]:
        """Code point offsets of each token, end exclusive."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")]) if len(ids) else np.zeros(0, int)
        starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else ends
        inside = (data[starts] & 0xC0) == 0x80 if len(starts) else starts
        return list(zip((lead[starts] - inside).tolist(), lead[ends].tolist(), strict=True))


_codecs: dict[bytes, Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    key = hashlib.sha256(content + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(content), pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_file: str, pattern: str, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_spans: bool = False, kept_parts: int = KEPT_PARTS) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, on request, ids and spans (array of each token's code point offsets) to the columns kept.

    The driver reads the ranks file (under 1 MB) and broadcasts it. ``kept_parts``:
    parts that a Python worker keeps, fewer where other stages need the memory.
    """
    with open(ranks_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = own.encode(batch.column(batch.num_columns - 1).to_pylist(), kept_parts)
                columns = batch.columns[:-1]
                columns.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()))
                columns.append(pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()))
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                if with_spans:
                    columns.append(pa.array([[{"start": a, "end": b} for a, b in own.token_spans(x)] for x in ids], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *new])
        own.parts.clear()

    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["spans"] * with_spans]
    kinds = dict(zip(new, ["long", "string", "string", *["array<int>"] * with_ids, *["array<struct<start:int,end:int>>"] * with_spans], strict=True))
    names = []
    for c in keep:
        while c.lower() in {x.lower() for x in [*new, *names]}:
            c = f"_{c}"
        names.append(c)
    # kept columns pass under plain names, as any name may be one of theirs
    rows = docs.select(*[quoted(c).alias(f"_{k}") for k, c in enumerate(keep)], quoted(text_column).cast("string").alias("_text"))
    schema = StructType([*rows.schema.fields[:-1], *rows.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in kinds.items())).schema.fields])
    return map_arrow(rows, run, schema).toDF(*names, *new)
