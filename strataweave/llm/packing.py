"""Best-two-fit packing of token pieces into sequences of bounded length.

Tokenising gives one row per piece of a document. Packing needs only how many
pieces there are of each length, a table of at most `capacity` rows however
large the corpus: on it, the driver fills a bin greedily (largest piece that
fits, again and again), then replaces the bin's smallest piece by two unpacked
pieces that fill the widened gap more tightly. The bin, once found, is repeated
as often as the counts allow, so a plan is a short list of bins and
multiplicities. Pieces then take their places by rank among the pieces of
their length; ranks come from windows over groups of about RANK_ROWS pieces, so
one frequent length does not land in one task.

Defined results: null text is a text of no tokens, which still ends with the
separator; repeated rows are packed row by row; an empty table gives no rows.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.tables import stored

CAPACITY = 2048
#: Pieces of one length are ranked in groups of about so many.
RANK_ROWS = 500
#: Words whose ids a worker remembers.
MEMORY = 600_000
# Letters that normalisation leaves as they are but for their case (Latin-1 and Latin Extended-A, without
# U+0130, which lower-cases to two characters), then ASCII punctuation without the apostrophe.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

_encoders: dict[tuple[str, str, bool], Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: the byte's
    own character where it is printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _by_word(conf: dict) -> bool:
    """Whether a vocabulary lower-cases and takes runs of letters and of punctuation apart from
    one another and from white space, so that words can be encoded one by one as below."""
    normal = conf["normalizer"] or {}
    steps = [n["type"] for n in normal.get("normalizers", [normal] if normal else [])]
    pre = (conf["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = [p["pattern"].get("Regex", "") for p in pre if p["type"] == "Split" and p["invert"] and p["behavior"] == "Removed"]
    level = [p for p in pre if p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"]]
    runs = any({r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(x.split("|")) for x in split)
    return conf["model"]["type"] == "BPE" and "Lowercase" in steps and {*steps} <= {"NFC", "Replace", "Lowercase"} and runs and len(level) == 1 and len(pre) == 2


class Encoder(dict):
    """Maps a blank-free byte string to its ids, packed little-endian.

    The vocabulary's pre-tokeniser never joins text across white space, so a
    text's ids are those of its words one after another; most words recur. A
    word of plain letters, with or without punctuation after it, needs none of
    the normaliser and the pre-tokeniser, so its parts go to the vocabulary's
    model at once. Strings of special tokens are those tokens, as the
    tokeniser has it; with plain=True they are ordinary text.
    """

    def __init__(self, path: str, width: str = "<u4", plain: bool = False) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.width = width
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # encode() has cut them out before; a word only looks like one by its lower case
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.by_word = _by_word(json.loads(self.tokenizer.to_str()))
        special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in sorted(special, key=len, reverse=True)) + b")") if special else None

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.width).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = PLAIN.fullmatch(word)
        if found is None:
            ids = self._whole(word)
        elif found.end(1) < len(word):
            ids = self[found[1]] + self[found[2]]
        else:
            text = word.decode() if word.isascii() else "".join(self.letters[b] for b in word.decode().lower().encode())
            ids = self._pack([t.id for t in self.model.tokenize(text)])
        if len(self) < MEMORY:
            self[word] = ids
        return ids

    def _whole(self, text: bytes) -> bytes:
        return self._pack(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        if self.special and b"<" in text and self.special.search(text):
            parts = self.special.split(text)
            return b"".join(self._pack([self.tokenizer.token_to_id(x.decode())]) if i % 2 else self.encode_plain(x) for i, x in enumerate(parts))
        return self.encode_plain(text)

    def encode_plain(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split())) if self.by_word else self._whole(text)


def encoder(path: str, width: str = "<u4", plain: bool = False) -> Encoder:
    key = (path, width, plain)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def counted(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """docs with, in place of text, the number of its tokens (bigint); null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            n = pa.array([len(encode(value.as_py())) // 4 for value in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*kept, name])

    kept = [c for c in docs.columns if c != text]
    slim = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b"))
    schema = ", ".join([*(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` bigint"])
    return slim.mapInArrow(run, schema)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer).encode, 4 * capacity
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column(1)):
                flat = encode(value.as_py()) + last
                for k, at in enumerate(range(0, len(flat), step)):
                    part = flat[at : at + step]
                    rows.append(row)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * ids
    return docs.select(id_col, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_b")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as ([(length, how many)], times repeated), for pieces counted by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    present = sum(1 << n for n in left)
    at_most = lambda bits, n: (bits & ((2 << n) - 1)).bit_length() - 1 if n > 0 else -1
    plan = []
    while left:
        bin_: dict[int, int] = {}
        gap = capacity
        while (n := at_most(present, gap)) > 0:
            spare = left[n] - bin_.get(n, 0)
            if not spare:  # all of this length are in this bin
                present_below = present & ((1 << n) - 1)
                while (n := at_most(present_below, gap)) > 0 and left[n] == bin_.get(n, 0):
                    present_below &= (1 << n) - 1
                if n <= 0:
                    break
                spare = left[n] - bin_.get(n, 0)
            k = min(spare, gap // n)
            bin_[n] = bin_.get(n, 0) + k
            gap -= n * k
        if gap:
            least = min(bin_)
            room, best = gap + least, (least, 0, 0)
            spare = lambda n: left.get(n, 0) - bin_.get(n, 0)
            a = at_most(present, room - 1)
            while a > 0 and 2 * a > best[0] and best[0] < room:
                if spare(a) > 0:
                    b = at_most(present, min(a, room - a))
                    while b > 0 and (spare(b) - (a == b)) <= 0:
                        b = at_most(present, b - 1)
                    if b > 0 and a + b > best[0]:
                        best = (a + b, a, b)
                a = at_most(present, a - 1)
            if best[1]:
                bin_[least] -= 1
                for n in best[1:]:
                    bin_[n] = bin_.get(n, 0) + 1
                bin_ = {n: k for n, k in bin_.items() if k}
        times = min(left[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                present ^= 1 << n
        plan.append((sorted(bin_.items(), reverse=True), times))
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies per bin, first sequence, offset)."""
    rows, used, sequence = [], {}, 0
    for bin_, times in plan:
        offset = 0
        for n, k in bin_:
            first = used.get(n, 0)
            used[n] = first + k * times
            rows.append((n, first, used[n], k, sequence, offset))
            offset += n * k
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with length, and _nth, any number that no two rows share) and their
    sequence_id and offset. Read more than once: pass a stored table.

    Pieces that fill a sequence take one of their own, numbered down from -1;
    only shorter ones are ranked.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # as many rows as lengths, capacity at most
    own = F.col("length") == capacity
    full = parts.filter(own).withColumns({"sequence_id": -1 - F.col("_nth"), "offset": F.lit(0).cast("long")}).drop("_nth")
    counts.pop(capacity, None)
    if not counts:
        return full
    # Both tables have a row per length or per place in a bin: bounded by capacity, not by the corpus.
    groups = spark.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in counts.items()], "length bigint, _groups bigint")
    place = spark.createDataFrame(places(best_two_fit(counts, capacity)), "_length bigint, _first bigint, _end bigint, _copies bigint, _sequence bigint, _offset bigint")
    dealt = parts.filter(~own).join(F.broadcast(groups), "length").withColumn("_group", F.pmod(F.xxhash64("_nth"), "_groups")).drop("_groups")
    # Where a group's ranks start; the list grows with the pieces, so it is merge-joined, on the key that pieces are dealt by anyway.
    starts = dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select("length", "_group", F.coalesce(before, F.lit(0)).alias("_start"))
    order = Window.partitionBy("length", "_group").orderBy("_nth")
    ranked = dealt.withColumn("_rank", F.row_number().over(order)).join(starts.hint("merge"), ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_start"))
    placed = ranked.join(F.broadcast(place), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    nth = F.col("_rank") - F.col("_first")
    return full.unionByName(placed.select(
        *(c for c in parts.columns if c != "_nth"),
        (F.col("_sequence") + F.floor(nth / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.col("length") * (nth % F.col("_copies"))).cast("long").alias("offset"),
    ))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    cut_up = pieces(docs, tokenizer, id_col, text, capacity).withColumn("_nth", F.monotonically_increasing_id())
    return pack(stored(cut_up, "pieces"), capacity)
