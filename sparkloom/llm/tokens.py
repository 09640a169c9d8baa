"""Token-ID output: binary shards with a shared zstandard dictionary, one frame a document, and an offset index.

A shard is one binary value (a row of a Parquet table, so any store that Spark writes will do): a fixed header with the
dictionary's hash, then document ids, token counts and frame offsets, then the frames. A reader takes one document's ids
by seeking to its frame; nothing else is decompressed. The dictionary lies beside the shards, is trained on a bounded
sample of serialized id arrays, and is checked against the hash in every shard.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, in_chunks, mix, scratch, small, staged

#: The dictionary is trained on the id arrays of so many documents of at most so many bytes each (those of least hash).
DICTIONARY_SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 1 << 16, 1 << 16
SHARD_BYTES = 1 << 20
MAGIC = b"LOOMTOK1"
HEAD = struct.Struct("<8sBxxxI32s")  # magic, bytes an id, documents, sha256 of the dictionary
#: Units that a worker knows at most (some forty bytes each).
CACHED_WORDS = 1_500_000
LATE_WORDS = 100_000
END_ID = 0


class Encoder:
    """The tokenizers library with a cache of units.

    A text is cut where byte-level BPE always begins a token: at the start of each run of white space, before its last
    character if a word follows, and after that unless it is a plain space (which belongs to the word). Units between cuts
    are encoded once each, so the ids are the same as for the whole text. A unit of up to 8 * COLUMNS bytes is known by
    those bytes themselves and its length: a hash finds it, the bytes decide. Longer units are encoded anew, and so is a
    whole text that holds an added token, around which white space goes by other rules. All lies in flat arrays.
    """

    SIGNS = ",.;:!?#$%&*"
    COLUMNS = 3
    # White space beyond ASCII.
    WIDE = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
    GLUE = 0xFF  # no byte of UTF-8

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # a token's characters stand for its bytes, one by one
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.wide = np.array([int.from_bytes(w.ljust(3, b"\0"), "big") for w in self.WIDE], np.uint32)
        self.lead = np.isin(np.arange(256), [w[0] for w in self.WIDE])
        self.below = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        self.tails: dict[str, bytes] = {}
        # the known units in the order of their hashes, and those of late, merged now and then
        self.old = self.late = self.table(np.empty((self.COLUMNS + 1, 0), np.uint64), np.empty(0, np.uint64), [])[0]
        self.flat = np.empty(0, self.kind)

    @staticmethod
    def table(same: np.ndarray, keys: np.ndarray, lengths: list[int], base: int = 0) -> tuple[tuple, np.ndarray, np.ndarray]:
        """A table of units (hash, bytes and length, place of the ids, number of ids) and the last two in the order given."""
        n = np.array(lengths, np.uint8)
        at = (base + np.cumsum(n, dtype=np.int64) - n).astype(np.uint32)
        order = np.argsort(keys, kind="stable")
        return (keys[order], same[:, order], at[order], n[order]), at, n

    def find(self, keys: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each unit's ids begin (-1 for an unknown unit), how many they are, and whether the hash is taken."""
        at, n, taken = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for known, units, start, count in (self.old, self.late):
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = np.flatnonzero(known[place] == keys)
                taken[found] = True
                hit = found[(units[:, place[found]] == same[:, found]).all(axis=0)]
                at[hit], n[hit] = start[place[hit]], count[place[hit]]
        return at, n, taken

    @staticmethod
    def merge(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]], axis=1)[:, order], np.concatenate([a[2], b[2]])[order], np.concatenate([a[3], b[3]])[order]

    def alone(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()

    def tail(self, signs: str) -> bytes:
        if len(signs) > 8:
            return self.alone(signs)
        if signs not in self.tails:
            self.tails[signs] = self.alone(signs)
        return self.tails[signs]

    def spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space. Signs after a word's last letter or digit are a token of their own."""
        stems = [w if (w := p.rstrip(self.SIGNS)) and w[-1].isalnum() else p for p in words]
        plain = list({w for w in stems if w.isalnum()})
        known: dict[str, bytes] = {}
        # Words after a space stay apart in one long text, too; the bytes of its tokens tell which are whose.
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.searchsorted(self.n_bytes[ids].cumsum(), np.cumsum([len(w.encode()) + 1 for w in some])) + 1
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, (ends * self.width).tolist(), strict=True):
                known[w] = raw[start:end]
                start = end
        others = list({w for w in stems if w not in known})
        for w, e in zip(others, self.tokenizer.encode_batch_fast([" " + w for w in others], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, self.kind).tobytes()
        return [known[w] if len(p) == len(w) else known[w] + self.tail(p[len(w) :]) for p, w in zip(words, stems, strict=True)]

    def ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of units as the tokenizer has them."""
        words = [u[0] == " " and len(u) > 1 and not any(map(str.isspace, u[1:])) for u in units]
        spaced = iter(self.spaced([u[1:] for u, w in zip(units, words, strict=True) if w]))
        others = iter(self.tokenizer.encode_batch_fast([u for u, w in zip(units, words, strict=True) if not w], add_special_tokens=False))
        return [next(spaced) if w else np.array(next(others).ids, self.kind).tobytes() for w in words]

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """buffer, starts and ends of all units; bounds[i]:bounds[i + 1] are those of text i."""
        glue = bytes([self.GLUE])
        raw = glue.join(texts) + glue
        buffer = np.frombuffer(raw + bytes(8 * self.COLUMNS), np.uint8)
        body = buffer[: len(raw)]
        space, glued = self.space[body], body == self.GLUE
        blank = space
        lead = np.flatnonzero(self.lead[body])
        if len(lead):
            three = (buffer[lead].astype(np.uint32) << 16) + (buffer[lead + 1].astype(np.uint32) << 8) + buffer[lead + 2]
            wide = lead[np.isin(np.where(buffer[lead] < 0xE0, three & 0xFFFF00, three), self.wide)]
            if len(wide):
                blank = space.copy()
                blank[wide] = blank[wide + 1] = True
                blank[wide[buffer[wide] >= 0xE0] + 2] = True
        word = ~blank & ~glued
        cuts = blank.copy()
        cuts[1:] &= ~blank[:-1]
        inner = np.zeros(len(body), bool)  # the last character of a run, before a word, and the word after other than a plain space
        inner[:-1] = space[:-1] & word[1:]
        after = np.zeros(len(body), bool)
        after[1:] = inner[:-1] & (body[:-1] != 0x20)
        if blank is not space:  # a run with other white space stays whole, with the word after it
            run = np.cumsum(cuts)
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[blank & ~space]] = True
            inner &= ~mixed[run]
            after &= ~mixed[run]
        cuts |= inner | after | glued
        cuts[0] = True
        cuts[1:] |= glued[:-1]
        starts = np.flatnonzero(cuts)
        ends = np.append(starts[1:], len(body))
        kept = ~glued[starts]
        starts, ends = starts[kept], ends[kept]
        return buffer, starts, ends, np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))

    def clean(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        buffer, starts, ends, bounds = self.cut(texts)
        length = ends - starts
        eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        same = np.stack([eight[np.minimum(starts + 8 * j, len(eight) - 1)] & self.below[np.clip(length - 8 * j, 0, 8)] for j in range(self.COLUMNS)] + [length.astype(np.uint64)])
        keys = mix(same[0] + same[-1])
        for column in same[1:-1]:
            keys = mix(keys ^ column)
        used, example, which = np.unique(keys, return_index=True, return_inverse=True)
        at, n, taken = self.find(used, same[:, example])
        long = length[example] > 8 * self.COLUMNS
        at[long], n[long] = -1, 0
        new = np.flatnonzero(at < 0)
        # occurrences that only share the hash of their example, or are too long to be known by their bytes
        odd = np.flatnonzero((same != same[:, example[which]]).any(axis=0) | (length > 8 * self.COLUMNS))
        new = new[~long[new]]
        flat, full = self.flat, len(self.old[0]) + len(self.late[0]) + len(new) > CACHED_WORDS

        def texts_of(units: np.ndarray) -> list[str]:
            return [buffer[s:e].tobytes().decode("utf-8", "surrogatepass") for s, e in zip(starts[units].tolist(), ends[units].tolist(), strict=True)]

        if len(new):
            raw = self.ids_of(texts_of(example[new]))
            learned, at[new], n[new] = self.table(same[:, example[new]], used[new], [len(x) // self.width for x in raw], len(flat))
            flat = np.concatenate([flat, np.frombuffer(b"".join(raw), self.kind)])
            if not full and not taken[new].any():  # the first units are the frequent ones and stay
                self.flat, self.late = flat, self.merge(self.late, learned)
                if len(self.late[0]) > LATE_WORDS:
                    self.old, self.late = self.merge(self.old, self.late), tuple(x[..., :0] for x in self.late)
        at, n = at[which], n[which]
        if len(odd):
            raw = self.ids_of(texts_of(odd))
            n[odd] = [len(x) // self.width for x in raw]
            at[odd] = len(flat) + np.cumsum(n[odd]) - n[odd]
            flat = np.concatenate([flat, np.frombuffer(b"".join(raw), self.kind)])
        end = np.cumsum(n)
        ids = flat[np.repeat(at - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        return np.split(ids, np.append(0, end)[bounds[1:-1]]) if len(texts) > 1 else [ids]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids and END_ID, as bytes."""
        end = np.array([END_ID], self.kind).tobytes()
        out = [b""] * len(texts)
        tidy = []
        for i, t in enumerate(texts):
            if any(a in t for a in self.added):
                out[i] = self.alone(t) + end
            else:
                tidy.append(i)
        for at, chunk in in_chunks([texts[i] for i in tidy], 2 << 20):
            for i, ids in zip(tidy[at : at + len(chunk)], self.clean(chunk), strict=True):
                out[i] = ids.tobytes() + end
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, self.width, self.n, digest = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        n, at = self.n, HEAD.size
        self.doc_ids, self.valid = np.frombuffer(blob, "<i8", n, at), np.frombuffer(blob, np.uint8, n, at + 8 * n)
        self.counts, self.offsets = np.frombuffer(blob, "<u8", n, at + 9 * n), np.frombuffer(blob, "<u8", n + 1, at + 17 * n)
        self.frames = memoryview(blob)[at + 17 * n + 8 * (n + 1) :]
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        raw = self.reader.decompress(self.frames[int(self.offsets[i]) : int(self.offsets[i + 1])])
        return np.frombuffer(raw, f"<u{self.width}")


def pack_shard(width: int, digest: bytes, doc_ids: list, counts: list[int], frames: list[bytes]) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
    return b"".join((HEAD.pack(MAGIC, width, len(frames), digest), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array([i is not None for i in doc_ids], np.uint8).tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), *frames))


def _frames(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(path), compressor(shared.value)
        for batch in small(batches):
            raw = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // enc.width for r in raw], pa.int64()), pa.array([press.compress(r) for r in raw], pa.binary())], names=["doc_id", "n", "frame"])

    return run


def _shards(width: int, digest: bytes, size: int):
    names = ["part", "shard", "start", "n_tokens", "n_docs", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, held = [], [], [], 0

        def row():
            values = [[part], [shard], [start], [sum(counts)], [len(ids)], [pack_shard(width, digest, ids, counts, frames)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=names)

        for batch in small(batches):
            for i, n, f in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids.append(i)
                counts.append(n)
                frames.append(f)
                held += len(f) + 25
                if held >= size:
                    yield row()
                    shard, start = shard + 1, start + sum(counts)
                    ids, counts, frames, held = [], [], [], 0
        if ids:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the ids of every text of docs (doc_id, text) under path, in ascending doc_id order (null last).

    Each document's ids end with END_ID; a null text has only that. Rows that repeat a doc_id stay, in the order of
    their frames' hashes. Frames are written once before they are sorted, so no text is tokenized twice, and the sort
    moves compressed frames instead of texts.
    """
    spark = bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = rows.where(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_SAMPLES)
    plain = rows.join(F.broadcast(picked.distinct()), "doc_id", "left_semi").where(F.octet_length("text") <= SAMPLE_BYTES)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array(encoder(tokenizer).encode(batch.column(1).to_pylist()), pa.binary())], names=["raw"])

    samples = sorted(bytes(r.raw) for r in plain.mapInArrow(arrays, "raw binary").limit(DICTIONARY_SAMPLES).collect())
    dictionary = train_dictionary(samples)
    digest = hashlib.sha256(dictionary).digest()
    width = encoder(tokenizer).width
    spark.createDataFrame([(digest.hex(), dictionary, width)], "sha256 string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    frames = staged(rows.mapInArrow(_frames(tokenizer, shared), "doc_id long, n long, frame binary"), "frames", compression="none")
    # Ids that repeat, null among them, spread by their frames and equal frames by their place in the staged files.
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("place")]
    placed = frames.withColumns({"h": F.xxhash64("frame"), "place": F.monotonically_increasing_id()})
    shards = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "frame").mapInArrow(_shards(width, digest, shard_bytes), "part int, shard int, start long, n_tokens long, n_docs long, data binary")
    shards.write.option("compression", "none").parquet(f"{path}/shards")


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `before`: the number of ids before each, in the order of all documents."""
    shards = spark.read.schema("part int, shard int, start long, n_tokens long, n_docs long, data binary").parquet(f"{path}/shards")
    totals = sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a writing task
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    return shards.join(F.broadcast(spark.createDataFrame(starts, "part int, offset long")), "part").withColumn("before", F.col("offset") + F.col("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the shards under path."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for before, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py(), shared.value)
                starts = before + np.concatenate(([0], np.cumsum(shard.counts)[:-1])).astype(np.int64)
                ids = [shard.ids(i).astype("<u4") for i in range(shard.n)]
                columns = [pa.array([int(d) if v else None for d, v in zip(shard.doc_ids, shard.valid, strict=True)], pa.int64()), pa.array(starts), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return shard_table(spark, path).select("before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_report(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of docs, read the files back: (doc_id, start, n_tokens, ids_crc32) a document."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{scratch(spark)}/loom-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or default_tokenizer())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
