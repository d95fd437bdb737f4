"""Packing documents into training sequences by powers of two.

A document's tokens are cut into as many pieces of ``longest`` as fit and then into the binary digits of what is left, largest first. Every piece is a sequence of
its own, whose length is a power of two: no sequence crosses documents and none needs padding. Sequences of one length are numbered in one run, so a
batch is any run of numbers inside a bucket."""
from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import ranked
from .common import stage

LONGEST, END = 2048, 1
CUT, CACHE = 1 << 20, 1 << 19           # characters handled at once, strings a worker remembers
_PLAIN = re.compile("[!-&(-;=-@\\[-~À-ÖØ-öø-ÿ]+")                            # neither an apostrophe nor "<", which may join what stands beside them
_PARTS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^0-9a-zÀ-ÖØ-öø-ÿ]+")
_ENCODERS: dict = {}                    # one per file and worker process


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Remembered(dict):
    """Values by string, made where they are missing; forgotten all at once when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, s: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self.make(s)
        if len(s) <= 256:
            self[s] = value
        return value


class Encoder:
    """Token ids of texts as little-endian bytes, equal to one ``encode`` of the whole text.

    For vocabularies that lower-case, drop white space and never join letters, digits and other marks (``word_bpe_49k``): a text may then be cut at spaces, and a
    string without apostrophes between its runs of letters, digits and other marks. Each distinct string is encoded once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.whole = Tokenizer.from_file(path)
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c).lower())[0][0] for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)}
        self.strings, self.parts = _Remembered(self._string), _Remembered(self._part)

    def _part(self, p: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.whole.model.tokenize(p if p.isalpha() and p.isascii() else p.translate(self.bytes_of))])

    def _string(self, s: str) -> bytes:
        if not s:
            return b""
        if not _PLAIN.fullmatch(s):
            return b"".join([self.packed[i] for i in self.whole.encode(s, add_special_tokens=False).ids])
        return b"".join([self.parts[p] for p in _PARTS.findall(s)])

    def __call__(self, text: str) -> bytes:
        """Texts are cut at spaces near every ``CUT`` characters; a text without spaces is one string."""
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + CUT)
            piece = text[at:end if end >= 0 else len(text)]
            at += len(piece) + 1
            if "<|" not in piece:               # names of special tokens are matched as written
                piece = piece.encode().lower().decode()
            strings = piece.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(b"".join(map(self.strings.__getitem__, strings)))
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to n, largest first, none above ``longest``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end: int = END, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids) of every piece: ``ids`` (array of int, left out where ``ids=False``) are the piece's tokens.

    Null and empty texts are one piece that holds the end id; repeated rows and null ids are packed like any other row; other columns are ignored. A long text is
    encoded in parts, its ids (4 bytes each) are held together once."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_tokenizer()
    last = end.to_bytes(4, "little")
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fields = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"] + (["ids"] if ids else [])

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                b = batch.slice(first, 512)
                row, start, length, total, crc, flat = [], [], [], [], [], []
                for i, t in enumerate(b.column(1)):
                    body = memoryview(encode(t.as_py()) + last)
                    n, at = len(body) // 4, 0
                    for size in binary_lengths(n, longest):
                        part = body[4 * at:4 * (at + size)]
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        crc.append(zlib.crc32(part))
                        if ids:
                            flat.append(part)
                        at += size
                cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc))]
                if ids:
                    offsets = [0]
                    for size in length:
                        offsets.append(offsets[-1] + size)
                    tokens = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(flat))])
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens))
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return slim.mapInArrow(run, fields)


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end: int = END, ids: bool = True) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. Each piece fills its sequence, so ``offset`` is 0; sequences are numbered from 0 without gaps, longest first, so
    equal lengths form one bucket of neighbouring numbers. Numbers follow from the rows' values: reruns agree. An empty table gives no rows."""
    cut = stage(pieces(docs, tokenizer, longest, end, ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    order = ["_bucket", "doc_id", "start", "ids_crc32", "doc_tokens", "_row"]
    numbered = ranked(cut.drop("ids").withColumn("_bucket", -F.col("length")), [], order, "_no").withColumn("sequence_id", F.col("_no") - 1)
    if ids:                                  # only the slim columns go through the numbering
        numbered = cut.join(numbered.select("_row", "sequence_id"), "_row")
    return numbered.withColumn("offset", F.lit(0).cast("long")).drop("_row", "_bucket", "_no")


def write_buckets(packed: DataFrame, path: str, rows: int = 1 << 16) -> None:
    """Writes packed sequences as one folder per length, in files of at most ``rows`` rows: a batch reader opens one bucket and gets equal shapes."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").option("maxRecordsPerFile", rows).parquet(path)


def packing_digest(docs: DataFrame) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return pack(docs, ids=False).select("doc_id", *[long(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
