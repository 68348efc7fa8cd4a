"""Operator 10: token ids as length-delimited binary records with a separate offset index.

A record file holds frames: payload length (uint64), masked crc32 of those 8 bytes (uint32), payload, masked crc32 of
the payload (uint32), all little-endian. A payload is a flag byte (bit 0: the document has an id; bit 1: ids take 4
bytes, else 2), the document's id (int64) and its token ids. The mask rotates a crc by 15 bits and adds a constant,
so that a crc stored inside checked data does no harm. crc32 is the polynomial of zlib.

A task writes one file under a name that only that attempt uses; what the index (a Parquet table with one row a record:
shard, file, seq, doc_id, offset, length, n_tokens) doesn't name isn't part of the output, so a repeated or
lost task leaves only a file that nobody reads.
"""

from __future__ import annotations

import itertools
import os
import string
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import new_folder
from .shingles import give_back, slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Pieces whose ids a process keeps (about 200 bytes each).
CACHED_PIECES = 1 << 18
#: Bytes of text that are encoded at a time.
SLICE = 1 << 22
#: Code points of a text by which rows of one id are dealt to files.
BEGINNING = 64
#: A character that the tokenizer makes one id of; texts that have it are encoded as they are.
MARK = "\x01"
#: A text that tells whether a tokenizer works piece by piece.
PROBE = "It's THE quick-brown (fox_2) of 1984; they'll e-mail a.b@c.org: x==y && 'quoted words' 3.14% don't!! naïve Ünïcode, co\u0301mbined"

INDEX = "shard int, file string, seq long, doc_id long, offset long, length long, n_tokens long"
RECORDS = "shard int, seq long, doc_id long, before long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17 & 0xFFFFFFFF)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize == 4
    return struct.pack("<Bq", (doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return doc_id if flags & 1 else None, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def read_frames(stream) -> Iterator[bytes]:
    """The payloads in a stream, each checked. A damaged or cut frame is an error."""
    while head := stream.read(12):
        if len(head) < 12 or masked_crc(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("damaged length in a record file")
        n = struct.unpack_from("<Q", head)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked_crc(body[:n]) != struct.unpack_from("<I", body, n)[0]:
            raise ValueError("damaged record")
        yield body[:n]


def read_at(path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """The record at an offset that the index gives."""
    fs, at = _filesystem(path)
    with fs.open_input_file(at) as f:
        f.seek(offset)
        return parse_payload(next(read_frames(f)))


def _filesystem(uri: str):
    """pyarrow's file system for a URI: local paths, object stores and hdfs alike, on executors without a JVM."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Encoder:
    """Token ids of whole texts.

    A tokenizer that ends its tokens at white space and between ASCII letters, digits and other signs, and takes letters of
    either case alike, gives a text the ids of its pieces; so each distinct piece of a run of texts is encoded once, and pieces
    met before aren't encoded again while they are remembered. Whether a file's tokenizer does so is tried when it is loaded; if not, and for
    texts that hold a special token's spelling, texts are encoded as they are. Apostrophes and other scripts are never cut at.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # pieces with their numbers, in that order; of each number where its ids lie in the pool, how many, and when it was met last
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.pool, self.turn = np.zeros(0, self.type), 0
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.by_piece = self.mark is not None and self._holds()

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """This process's encoder for a file: workers outlive tasks, and the pieces they know are worth keeping.

        Functions arrive anew with each task, so it hangs on a module of the process.
        """
        home = sys.modules.setdefault("_ledgerlake_of_process", types.ModuleType("_ledgerlake_of_process"))
        known = home.__dict__.setdefault("encoders", {})
        return known.get(path) or known.setdefault(path, cls(path))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _holds(self) -> bool:
        """Whether texts have the ids of their pieces, tried on each pair of kinds of characters and each white space."""
        glue = ("a", "Zq", "7", "42", ",", "(", "!!", "-", "_", "don't", "é", "漢", "'s")
        texts = [x + y for x in glue for y in glue] + [f"Ab{w}c{w}{w}9" for w in " \t\n\x0b\x0c\r"] + [" lead trail\n", PROBE]
        return all(np.array_equal(ids, self._ids(t)) for t, (ids, _) in zip(texts, (self._by_pieces(pa.array([t])) for t in texts), strict=True))

    def _encode(self, found: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All pieces in the order in which their ids lie in a row, the ids, and how many each piece has.

        A piece of printable ASCII without an apostrophe is of one kind, so the tokenizer's model takes it as it is; the others go through
        the whole tokenizer, many as one text, kept apart by a mark that is one id and in no piece.
        """
        plain, other = [], []
        for p in found:
            (plain if p.isascii() and p.isprintable() and "'" not in p else other).append(p)
        ids: list[int] = []
        ends = []
        model = self.tokenizer.model.tokenize
        for p in plain:
            ids += [t.id for t in model(p)]
            ends.append(len(ids))
        all_ids, sizes = [np.array(ids, self.type)], [np.diff(np.array([0, *ends], dtype=np.int64))]
        for g in (other[i : i + 512] for i in range(0, len(other), 512)):
            marked = self._ids(f" {MARK} ".join(g))
            at = np.flatnonzero(marked == self.mark)
            if len(at) != len(g) - 1:
                raise ValueError("a mark between pieces was lost")
            all_ids.append(np.delete(marked, at))
            sizes.append(np.diff(np.concatenate([[-1], at, [len(marked)]])) - 1)
        return plain + other, np.concatenate(all_ids), np.concatenate(sizes)

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        """The number of each piece; new ones are encoded, and of too many known ones the half that was met last stays."""
        if len(self.known) > CACHED_PIECES:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: CACHED_PIECES // 2])
            names = list(self.known)
            self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
            self.pool = _gathered(self.pool, self.starts[keep], self.sizes[keep])
            self.sizes, self.met = self.sizes[keep], self.met[keep]
            self.starts = np.cumsum(self.sizes) - self.sizes
        new = [p for p in distinct if p not in self.known]
        if new:
            new, ids, sizes = self._encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes, self.met = np.concatenate([self.sizes, sizes]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.pool = np.concatenate([self.pool, ids])
        numbers = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        self.turn += 1
        self.met[numbers] = self.turn
        return numbers

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, coded = pieces(texts)
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        each = numbers[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        sizes = self.sizes[each]
        return _gathered(self.pool, self.starts[each], sizes), np.concatenate([[0], np.cumsum(sizes)])[offsets].astype(np.int64)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one place more than texts). Null texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.ones(len(texts), dtype=bool)
        if self.by_piece:
            low = pc.ascii_lower(texts)
            whole = pc.match_substring(low, MARK).to_numpy(zero_copy_only=False)
            for s in self.special:
                whole |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_pieces(texts)
        # some are encoded as they are, and put where they belong
        ids, at = self._by_pieces(pc.if_else(pa.array(whole), "", texts)) if not whole.all() else (np.zeros(0, self.type), np.zeros(len(texts) + 1, np.int64))
        own = {i: self._ids(texts[i].as_py()) for i in np.flatnonzero(whole).tolist()}
        parts = [own[i] if i in own else ids[at[i] : at[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where each text's pieces begin (one place more than texts), and the pieces of all, each distinct one once.

    ASCII letters are lowered; texts are cut at ASCII white space, and where an ASCII letter, digit or sign meets one of another
    kind or two digits meet. White space at a text's ends leaves an empty piece.
    """
    low = pc.ascii_lower(texts)
    ends = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64) if len(low) else np.zeros(1, np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = KINDS[data]
    cut = np.flatnonzero(CUTS[kind[:-1], kind[1:]]) + 1
    out = np.full(len(data) + len(cut), 32, np.uint8)
    kept = np.ones(len(out), dtype=bool)
    kept[cut + np.arange(len(cut))] = False
    out[kept] = data
    ends = (ends + np.searchsorted(cut, ends)).astype(np.int32)
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(out))
    parts = pc.ascii_split_whitespace(spaced)
    return parts.offsets.to_numpy(), parts.flatten().dictionary_encode()


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte (letter, digit, sign, or none of them), and between which kinds texts are cut."""
    kinds = np.zeros(256, np.uint8)
    for k, signs in enumerate((string.ascii_letters, string.digits, string.punctuation.replace("'", "")), 1):
        kinds[list(signs.encode())] = k
    cuts = np.zeros((4, 4), dtype=bool)
    cuts[1:, 1:] = ~np.eye(3, dtype=bool)
    cuts[2, 2] = True
    return kinds, cuts


KINDS, CUTS = _kinds()


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, order: list[str] | None = None) -> DataFrame:
    """Writes the token ids of every text in ascending doc_id order below folder; returns the index as a table.

    Files are shards in order: every doc_id of a shard is at most the first of the next one. Null texts are empty (only the
    end id), null ids come first, and repeated rows get records of their own, ordered by order's further columns.
    """
    order = order or ["doc_id", "text"]
    placed = docs.select("doc_id", "text", *[c for c in order if c not in ("doc_id", "text")])
    # rows that share an id, or have none, are told apart by how their texts begin, which follows the order of whole texts
    ranges = [F.substring(c, 1, BEGINNING) if c == "text" else F.col(c) for c in order[:2]]
    placed = placed.repartitionByRange(*ranges).sortWithinPartitions(*order)
    placed = placed.select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard, encoder = first.column("shard")[0].as_py(), Encoder.of_process(tokenizer)
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        fs, at = _filesystem(name)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        seq = offset = 0
        rows = []
        with fs.open_output_stream(at) as out:
            for b in slices(itertools.chain([first], batches), chars=SLICE):
                ids, at = encoder.batch(b.column("text"))
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))  # each document ends with it
                for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                    data = frame(payload_of(doc_id, ids[at[i] : at[i + 1]]))
                    out.write(data)
                    rows.append((shard, name, seq, doc_id, offset, len(data), int(at[i + 1] - at[i])))
                    seq, offset = seq + 1, offset + len(data)
        give_back()
        for i in range(0, len(rows), 10_000):  # only now is the file whole
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), TYPES, strict=True)], names=NAMES)

    TYPES = [pa.int32(), pa.string(), *[pa.int64()] * 5]
    NAMES = [c.split()[0] for c in INDEX.split(", ")]
    index = f"{folder}/index"
    placed.mapInArrow(write, INDEX).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX).parquet(index)


def read_records(index: DataFrame) -> DataFrame:
    """Reads every file that the index names from its start to its end; a row for each record, with crc32 of its ids.

    before: ids in the records before it in its file. Ids are checked as little-endian unsigned 32-bit integers.
    """
    files = index.select("shard", "file").distinct()
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 5]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, name in zip(b.column("shard").to_pylist(), b.column("file").to_pylist(), strict=True):
                fs, at = _filesystem(name)
                before, rows = 0, []
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    for seq, payload in enumerate(read_frames(f)):
                        doc_id, ids = parse_payload(payload)
                        rows.append((shard, seq, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                        before += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # names are small, files are not
    return files.repartition(tasks, "shard").mapInArrow(read, RECORDS)


def digest(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes all documents as records, reads the files back, and returns doc_id, start, n_tokens, ids_crc32, shard, seq.

    start counts the ids of all documents before it, over all files. The sums over files are one row a file. Null and empty texts are their end id
    alone, null ids come first, rows that repeat get a record each, and rows that tie in doc_id are ordered by text. Texts of any length are
    encoded whole. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    folder = folder or new_folder(docs.sparkSession, "records")
    index = write_records(docs, folder, tokenizer)
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))
    out = read_records(index).join(F.broadcast(starts), "shard")  # one row a file
    return out.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq")
