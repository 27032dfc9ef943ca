"""BPE encoding and decoding with content-defined chunks that are encoded once.

A rolling hash over the last 32 bytes cuts texts into chunks of about
2**BITS bytes, so that equal passages are cut alike wherever they stand.

1. Chunks are counted by a digest of 128 bits. Those that occur twice or more
   make a Bloom filter of a bounded size (false positives cost time only).
2. A text without such a chunk is encoded where it is read. The others are
   written down as spans: runs of chunks of their own as text, shared chunks
   as digests, with their text once per task.
3. Every distinct shared chunk is encoded once, but for its first and last
   word, which the cut may have split: head (to the first white space), ids,
   tail (from the last).
4. Spans meet their chunks' ids and are put together by text, in order. At
   each join the window between the white space before it and the white space
   behind it is encoded again. A window without white space at both ends grows
   by the next span, until it has it; as the vocabulary never joins text across
   white space, the ids then agree with those of the whole text exactly.

A vocabulary that does join text across white space (see packing) has all
texts encoded whole. Decoding joins the ids' strings as the tokenizer does.

Defined results: null text is an empty one and has no ids; texts that are
repeated, in other rows or as rows, get a row each; null ids are ids like
others; strings of special tokens in a text are those tokens; an empty table
gives no rows. Other columns, whatever their names, take no part. Bytes that
are not UTF-8 are replaced as Python's "replace" has it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.packing import Encoder, encoder
from strataweave.llm.tables import stored

BITS = 9
#: Shortest and longest chunk in bytes; only a text's last one may be shorter.
LEAST, MOST = 64, 8192
#: Bytes that are hashed at once; a longer text is hashed in overlapping blocks.
BLOCK = 1 << 20
WINDOW = 32
#: Bits of the filter: so many for each shared chunk, as long as it stays within 64 MiB.
FILTER_BITS, FILTER_MOST = 16, 1 << 29

GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), dtype="<u4")
#: What bytes.split() takes for white space.
SPACES = {b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"}


def cuts(data: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text in UTF-8, its length last. No character is cut."""
    if not data:
        return []
    flat = np.frombuffer(data, dtype=np.uint8)
    ends = []
    for at in range(0, len(flat), BLOCK):
        first = max(0, at - WINDOW + 1)
        g = GEAR[flat[first : at + BLOCK]]
        for k in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
            wider = g.copy()
            wider[k:] += g[:-k] << np.uint32(k)
            g = wider
        ends.append(np.flatnonzero(g[at - first :] >> np.uint32(32 - bits) == 0) + at + 1)
    found = np.concatenate(ends)
    found = found[found < len(flat)]
    found = found[flat[found] & 0xC0 != 0x80]
    out, last = [], 0
    for end in [*found.tolist(), len(flat)]:
        while end - last > most:
            last += most
            while flat[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end - last >= least or end == len(flat):
            out.append(end)
            last = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Filter:
    """A Bloom filter over digests, by their own four words."""

    def __init__(self, bits: int) -> None:
        self.mask, self.bytes = np.uint32(bits - 1), np.zeros(bits // 8, dtype=np.uint8)

    def _at(self, keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), dtype="<u4").reshape(-1, 4) & self.mask

    def add(self, keys: list[bytes]) -> None:
        at = self._at(keys).reshape(-1)
        np.bitwise_or.at(self.bytes, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, keys: list[bytes]) -> list[bool]:
        at = self._at(keys)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1).tolist()


def _filter_of(keys: DataFrame, bits: int) -> Filter:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Filter(bits)
        for batch in batches:
            if batch.num_rows:
                one.add(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([one.bytes.tobytes()], pa.binary())], names=["f"])

    def either(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()

    whole = Filter(bits)
    whole.bytes = np.frombuffer(keys.mapInArrow(part, "f binary").rdd.map(lambda r: bytes(r["f"])).treeReduce(either, 3), np.uint8)
    return whole


def _encode_digests(ids: bytes, enc: Encoder, say: Callable[[np.ndarray], str]) -> tuple[int, str, str]:
    flat = np.frombuffer(ids, dtype=enc.width)
    return len(flat), hashlib.sha256(flat.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(say(flat).encode("utf-8", "replace")).hexdigest()


def decoder(enc: Encoder) -> Callable[[np.ndarray], str]:
    """As the tokenizer's decode with skip_special_tokens=False; without a decoder of its own, that joins the tokens by blanks."""
    if enc.tokenizer.decoder is not None:
        return lambda ids: enc.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    names = [enc.tokenizer.id_to_token(i) or "" for i in range(enc.tokenizer.get_vocab_size())]
    return lambda ids: " ".join(map(names.__getitem__, ids.tolist()))


def split(chunk: bytes) -> tuple[bytes, bytes, bytes | None]:
    """A chunk's text up to its first white space, the text between, and the text from its last on: None if it has none."""
    head = chunk.split(None, 1)[0] if chunk[:1] not in SPACES else b""
    if len(head) == len(chunk):
        return chunk, b"", None
    tail = chunk.rsplit(None, 1)[-1] if chunk[-1:] not in SPACES else b""
    return head, chunk[len(head) : len(chunk) - len(tail)], tail


class Joiner:
    """Puts a text's spans together; the word at the end waits until it is known to be whole."""

    def __init__(self, enc: Encoder) -> None:
        self.enc, self.ids, self.word = enc, [], []

    def _end_word(self, more: bytes) -> None:
        self.ids.append(self.enc.encode(b"".join([*self.word, more])))

    def text(self, span: bytes) -> None:
        head, middle, tail = split(span)
        self.chunk(head, self.enc.encode(middle), tail)

    def chunk(self, head: bytes, ids: bytes, tail: bytes | None) -> None:
        if tail is None:
            self.word.append(head)
            return
        self._end_word(head)
        self.ids.append(ids)
        self.word = [tail]

    def done(self) -> bytes:
        self._end_word(b"")
        return b"".join(self.ids)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: a row per row."""
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() < 1 << 16 else "<u4"
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"))
    digests = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoder(tokenizer, width).by_word:
            return
        for batch in batches:
            found: Counter[bytes] = Counter()
            for value in batch.column(0):
                data, at = value.as_py(), 0
                for end in cuts(data, bits):
                    found[digest(data[at:end])] += 1
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])

    counts = texts.select("_b").mapInArrow(count, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    shared = stored(counts.filter(F.col("n") > 1).select("key"), "shared-chunks")
    n = shared.count()
    size = min(1 << max(10, (FILTER_BITS * n - 1).bit_length()), FILTER_MOST)
    known = _filter_of(shared, size) if n else Filter(size)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, told = encoder(tokenizer, width), set()
        say = decoder(enc)
        for batch in batches:
            rows, out = [], []
            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                ends = cuts(data, bits) if enc.by_word else []
                starts = [0, *ends[:-1]]
                keys = [digest(data[a:b]) for a, b in zip(starts, ends, strict=False)]
                hits = known.has(keys) if keys else []
                if not any(hits):
                    rows.append(i)
                    out.append((-1, None, None, *_encode_digests(enc.encode(data), enc, say)))
                    continue
                own = 0  # where the run of own chunks starts
                for a, b, key, hit in zip(starts, ends, keys, hits, strict=True):
                    if not hit:
                        continue
                    if own < a:
                        rows.append(i)
                        out.append((own, None, data[own:a], None, None, None))
                    rows.append(i)
                    out.append((a, key, None if key in told else data[a:b], None, None, None))
                    told.add(key)
                    own = b
                if own < len(data):
                    rows.append(i)
                    out.append((own, None, data[own:], None, None, None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
            at = pa.array(rows, pa.int64())
            arrays = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_id", "at", "key", "part", "n_tokens", "ids_sha256", "decoded_sha256"])

    numbered = texts.select(F.monotonically_increasing_id().alias("_row"), "_id", "_b")
    written = stored(numbered.mapInArrow(spans, f"_row bigint, _id {kind}, at bigint, key binary, part binary, {digests}"), "spans", "zstd")
    finished = written.filter(F.col("at") < 0).select(F.col("_id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, width)
        for batch in batches:
            parts = [split(value.as_py()) for value in batch.column(1)]
            columns = [[p[0] for p in parts], [enc.encode(p[1]) for p in parts], [p[2] for p in parts]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=["key", "head", "ids", "tail"])

    own = written.filter((F.col("at") >= 0) & F.col("key").isNull())
    chunks = written.filter(F.col("key").isNotNull() & F.col("part").isNotNull()).groupBy("key").agg(F.first("part").alias("part"))
    encoded = chunks.mapInArrow(encode, "key binary, head binary, ids binary, tail binary")
    # A chunk that very many texts share is one key of many small rows: adaptive execution splits them.
    met = written.filter(F.col("key").isNotNull()).select("_row", "_id", "at", "key").join(encoded, "key")
    pieces = own.select("_row", "_id", "at", "part", *(F.lit(None).cast("binary").alias(c) for c in ("head", "ids", "tail"))).unionByName(
        met.select("_row", "_id", "at", F.lit(None).cast("binary").alias("part"), "head", "ids", "tail"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, width)
        say = decoder(enc)
        row, joiner, id_, out = None, None, None, []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_kind, pa.int64(), pa.string(), pa.string()], strict=True)], names=names)

        for batch in batches:
            id_kind, names = batch.schema.field(1).type, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            for now, this, part, head, ids, tail in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                if now != row:
                    if joiner is not None:
                        out.append((id_, *_encode_digests(joiner.done(), enc, say)))
                    row, id_, joiner = now, this, Joiner(enc)
                if part is not None:
                    joiner.text(part)
                else:
                    joiner.chunk(head, ids, tail)
            yield rows()
            out = []
        if joiner is not None:
            out.append((id_, *_encode_digests(joiner.done(), enc, say)))
            yield rows()

    # A partition's texts go by one after the other, never all at once.
    ordered = pieces.repartition("_row").sortWithinPartitions("_row", "at")
    return finished.unionByName(ordered.mapInArrow(assemble, f"`{id_col}` {kind}, {digests}"))
