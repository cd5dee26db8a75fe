"""Token ids as directly addressable codes, written and read as Parquet tables.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every id,
level 1 the next chunk of the ids that need one, and so on; a bitmap per level
says which ids go on, and a directory with the count of ones before every 512
bits turns a place on one level into the place on the next. So any token is read
with one look per level, without decoding what lies around it.

A row of the table is a block: consecutive whole documents with their ids, token
counts and levels. ``shard`` and ``block`` give the order of blocks.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imprint.llm.common import batch, slices, utf8
from imprint.session import checkpoint_dir

#: Tokens in a block, give or take its last document.
BLOCK_TOKENS = 1 << 18
#: Entries of a worker's table of known pieces; a full one keeps the half seen most often.
CACHE = 300_000
#: New pieces given to the tokenizer at once.
_PIECES = 10_000

_RANK = 512
_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("rank", pa.binary())])
_LEVEL_SQL = "array<struct<chunks:binary,more:binary,rank:binary>>"


@dataclass
class Codes:
    """Levels of (chunks, continuation bitmap, ones before every 512 bits)."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, ids = [], ids.astype(np.uint32)
        while True:
            more = ids > 255
            bits = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more, np.arange(0, len(more), _RANK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if len(ones) else ones
            levels.append(((ids & 255).astype(np.uint8), bits, rank))
            if not more.any():
                return cls(levels)
            ids = ids[more] >> 8

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def decode(self) -> np.ndarray:
        """All ids."""
        values = None
        for chunks, bits, _ in reversed(self.levels):
            out = chunks.astype(np.uint32)
            if values is not None:
                out[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= values << 8
            values = out
        return values

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ids at these places, by rank and without decoding others."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.uint32)
        rows = np.arange(len(places))
        for level, (chunks, bits, rank) in enumerate(self.levels):
            out[rows] |= chunks[places].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            rows, places = rows[more], places[more]
            if not len(rows):
                break
            block = places // _RANK
            spread = np.arange(_RANK // 8)
            full = bits[np.minimum(block[:, None] * (_RANK // 8) + spread, len(bits) - 1)]
            inside = (places % _RANK)[:, None] - 8 * spread
            mask = ((1 << np.clip(inside, 0, 8)) - 1).astype(np.uint8)
            places = rank[block].astype(np.int64) + np.bitwise_count(full & mask).sum(1, dtype=np.int64)
        return out

    def row(self) -> list[dict]:
        return [{"chunks": c.tobytes(), "more": m.tobytes(), "rank": r.tobytes()} for c, m, r in self.levels]

    @classmethod
    def from_row(cls, levels: list[dict]) -> Codes:
        return cls([
            (np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["rank"], np.uint32))
            for x in levels
        ])


class Encoder:
    """The tokenizer's ids of whole texts, each piece between single spaces encoded once.

    The byte-level pre-tokenizer always begins a token before a single space or
    line break between two other characters, so such a text may be cut there and
    its pieces encoded apart. Texts with other white space go to the tokenizer whole,
    and so do texts that contain an added token such as ``<|endoftext|>``, which has
    the id that the tokenizer gives it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Contents of added tokens, which are found before a text is cut into tokens.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: May an added token reach over white space, or be found only in normalized text?
        self.uncut = self.tokenizer.normalizer is not None or any(t.split() != [t] for t in self.added)
        vocabulary = self.tokenizer.get_vocab()
        # Byte-level tokens are spelled with one character for each byte.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)
        #: Number of each known piece; -1: a text with it is not to be cut.
        self.known: dict[str, int] = {}
        #: Where the ids of each piece begin in ``ids``, with the end of the last.
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        #: How many columns had each piece.
        self.seen = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Forget pieces seen once; of the others, keep those seen most often, half a table at most."""
        size, keep = np.diff(self.begin), self.seen > 1
        if keep.sum() > CACHE // 2:
            keep[np.argsort(-self.seen, kind="stable")[CACHE // 2 :]] = False
        number = np.append(np.where(keep, np.cumsum(keep) - 1, -1), -1)
        self.known = {p: n for p, n in zip(self.known, number[list(self.known.values())].tolist()) if n >= 0}
        self.ids = self.ids[np.repeat(keep, size)]
        self.begin = np.concatenate([[0], np.cumsum(size[keep])])
        self.seen = self.seen[keep]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces, which follow a space unless they start with a line break.

        Joined they are a text that may be cut between them, so many are encoded
        at once, and the lengths of the tokens say where each piece ends.
        """
        bare = [p[1:] if p[:1] == "\n" else p for p in pieces]
        if " ".join(bare).split() != bare:
            solid = [b.split() == [b] for b in bare]
            self.known.update((p, -1) for p, good in zip(pieces, solid) if not good)
            pieces = [p for p, good in zip(pieces, solid) if good]
        begins, ids, count = [self.begin], [self.ids], len(self.begin) - 1
        for a in range(0, len(pieces), _PIECES):
            part = pieces[a : a + _PIECES]
            joined = (" " + " ".join(part)).replace(" \n", "\n")
            found = self._whole(joined)
            data = np.frombuffer(joined.encode(), np.uint8)
            # Each piece begins with its space or line break and has no other.
            ends = np.append(np.flatnonzero((data == 32) | (data == 10))[1:], len(data))
            token_ends = np.cumsum(self.bytes[found])
            last = np.searchsorted(token_ends, ends)
            if len(ends) != len(part) or (token_ends[last] != ends).any():
                raise ValueError("this tokenizer joins what stands apart; it is not a byte-level one")
            self.known.update(zip(part, range(count, count + len(part))))
            count += len(part)
            begins.append(begins[-1][-1] + last + 1)
            ids.append(found)
        self.begin, self.ids = np.concatenate(begins), np.concatenate(ids)
        self.seen = np.append(self.seen, np.zeros(count - len(self.seen), np.int32))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column of large strings without nulls."""
        if self.uncut:
            return [self._whole(t) for t in texts.to_pylist()]
        if len(self.known) > CACHE:
            self._forget()
        # A text with an added token is cut as if it were empty, so it goes whole.
        plain = texts
        for content in self.added:
            plain = pc.if_else(pc.match_substring(plain, content), pa.scalar("", texts.type), plain)
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy()
        later = np.ones(offsets[-1] - offsets[0], bool)
        later[offsets[:-1] - offsets[0]] = False
        coded = cut.flatten().filter(pa.array(later)).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, pieces))
        fresh = [i for i, number in enumerate(found) if number is None]
        self._learn([pieces[i] for i in fresh])
        for i in fresh:
            found[i] = self.known[pieces[i]]
        number = np.array(found, np.int64)
        self.seen[number[number >= 0]] += 1
        numbers = number[coded.indices.to_numpy()]
        begin = self.begin[numbers]
        size = np.where(numbers < 0, 0, self.begin[numbers + 1] - begin)
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
        body = self.ids[where]
        # The first piece of each text is not among the numbers.
        at = offsets - offsets[0] - np.arange(len(offsets))
        token = np.concatenate([[0], ends])[at]
        whole = np.concatenate([[0], np.cumsum(numbers < 0)])[at]
        whole = whole[1:] > whole[:-1]
        out = []
        for i, text in enumerate(texts.to_pylist()):
            first = text[: re.search("[ \n]|$", text).start()]
            if whole[i] or at[i] == at[i + 1] or first.split() != [first]:
                out.append(self._whole(text))
            else:
                out.append(np.concatenate([self._whole(first), body[token[i] : token[i + 1]]]))
        return out


#: One encoder for each tokenizer in a worker, so that later tasks know what earlier ones learned.
_ENCODERS: dict[str, Encoder] = {}


def _writer(path: str, end_id: int, block_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        shard, block, held = TaskContext.get().partitionId(), 0, []
        keys, sizes, begin = [], [], 0

        def row():
            nonlocal block, held, keys, sizes, begin
            ids = np.concatenate(held)
            out = {
                "shard": shard, "block": block, "begin": begin, "n_tokens": len(ids), "doc_id": keys, "sizes": sizes,
                "levels": Codes.encode(ids).row(),
            }
            block, begin, held, keys, sizes = block + 1, begin + len(ids), [], [], []
            return out

        total = 0
        for b in batches:
            schema = _block_schema(b.schema.field("doc_id").type)
            ids = b.column("doc_id").to_pylist()
            texts = b.column("text").fill_null("").cast(pa.large_string())
            for a, z in slices(utf8(texts)[1]):
                for key, tokens in zip(ids[a:z], encoder.encode(texts.slice(a, z - a))):
                    held.append(np.append(tokens, np.uint32(end_id)))
                    keys.append(key)
                    sizes.append(len(tokens) + 1)
                    total += len(tokens) + 1
                    if total >= block_tokens:
                        total = 0
                        yield pa.RecordBatch.from_pylist([row()], schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    return run


def _block_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("begin", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_id", pa.list_(kind)), ("sizes", pa.list_(pa.int64())), ("levels", pa.list_(_LEVEL)),
    ])


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int = 2,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text and write the ids to ``folder`` in ascending id order.

    ``end_id`` ends each document. A text is encoded as the tokenizer does by default,
    so the written form of an added token gives that token. ``tokenizer_path`` must be readable on all
    executors. Null text is empty and has the end id only. Null ids come first;
    rows that repeat an id are all written, in the order of their texts. Other
    columns are ignored. An empty table writes an empty one.

    One range exchange of the texts; each range is encoded and written by its own
    task, a block at a time, and a lost task writes its range again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    (
        rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(
            _writer(tokenizer_path, end_id, block_tokens),
            f"shard int, block int, begin bigint, n_tokens bigint, doc_id array<{kind}>, sizes array<bigint>, levels {_LEVEL_SQL}",
        )
        .write.option("compression", "zstd").parquet(folder)
    )


def _describe(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = Codes.from_row(r["levels"]).decode().astype("<u4")
            sizes = np.array(r["sizes"], np.int64)
            ends = np.cumsum(sizes)
            kind = b.schema.field("doc_id").type.value_type
            yield batch(
                shard=pa.array([r["shard"]] * len(sizes), pa.int32()),
                doc_id=pa.array(r["doc_id"], kind),
                inner=ends - sizes + r["begin"],
                n_tokens=sizes,
                ids_crc32=np.array([zlib.crc32(ids[e - n : e]) for e, n in zip(ends, sizes)], np.int64),
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned checksum of its ids as little-endian 32-bit integers.
    """
    blocks = spark.read.parquet(folder)
    kind = dict(blocks.dtypes)["doc_id"].removeprefix("array<")[:-1]
    # One row for each writing task.
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    docs = blocks.mapInArrow(_describe, f"shard int, doc_id {kind}, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(offsets, "shard").select(
        "doc_id", (F.col("inner") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """Tokens at given places of documents (doc_id, place), read by rank: doc_id, place, token.

    Places outside a document and documents that are not there give no row.
    """
    blocks = spark.read.parquet(folder).withColumn("doc", F.explode(F.arrays_zip("doc_id", "sizes")))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                starts = dict(zip(r["doc_id"], zip(np.cumsum(sizes) - sizes, sizes)))
                asked = [(d, p) for d, p in ((x["doc_id"], x["place"]) for x in r["asked"]) if 0 <= p < starts[d][1]]
                found = Codes.from_row(r["levels"]).at(np.array([starts[d][0] + p for d, p in asked], np.int64))
                yield batch(
                    doc_id=pa.array([d for d, _ in asked], b.schema.field("doc_id").type.value_type),
                    place=pa.array([p for _, p in asked], pa.int64()), token=found.astype(np.int64),
                )

    kind = dict(blocks.dtypes)["doc_id"].removeprefix("array<")[:-1]
    where = blocks.select("shard", "block", F.col("doc.doc_id").alias("doc_id"))
    asked = where.join(places.select("doc_id", F.col("place").cast("bigint").alias("place")), "doc_id").groupBy("shard", "block").agg(
        F.collect_list(F.struct("doc_id", "place")).alias("asked")
    )
    return spark.read.parquet(folder).join(asked, ["shard", "block"]).select("doc_id", "sizes", "levels", "asked").mapInArrow(
        run, f"doc_id {kind}, place bigint, token bigint"
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
