"""Token ids in files of independent zstandard frames with a seek table.

A file is a run of frames, then an index frame and a seek table, both in
skippable frames, so any zstandard decoder can read the file. The seek table
has the layout of the public seekable format: per frame the compressed size,
the size and the low half of the content's XXH64, then the number of frames,
a flag byte and a magic number. The index holds each frame's first and last
doc_id. A reader fetches the tail, picks the frames that can hold the wanted
documents, checks each frame's checksum and decompresses nothing else.

A frame's content: u32 number of documents, i64 doc_ids, u8 null flags, u64
numbers of ids, then all ids as u32; little-endian throughout.

Files follow each other in ascending doc_id order (nulls first; rows of one
doc_id lie together, in the order of their text), and rows inside a file do
too. A file is written under a name of its own by each attempt of a task, and
counts only once its name is in the manifest, so lost or repeated tasks leave
at worst an unread file. Null text is encoded as the empty text.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import map_batches, written
from tilewright.session import shared_dir

END_ID = 2
FRAME_BYTES = 256 << 10
FILE_BYTES = 64 << 20
_SKIPPABLE = 0x184D2A5E
_INDEX = 0x184D2A5D
_SEEKABLE = 0x8F92EAB1
_FOOTER, _ENTRY = "<IBI", "<qqBQ"
#: Words whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Characters of a text, or of a block of texts, that are encoded at a time.
PIECE = 1 << 16


class Encoder:
    """The tokenizer with a memory of words.

    Splitting a text at blanks and line ends never changes its ids here, since
    the tokenizer treats those as separators and joins nothing across them.
    Most words of a text were met before, so only new ones go to the library.
    A word of Latin letters goes straight to its merges, spelled as the
    normaliser and the splitter would spell it; ASCII marks behind such a word
    are a piece of their own. Everything else, such as a Turkish capital dotted
    I, whose dot joins the marks, goes through the whole tokenizer.

    A tokenizer for which this does not hold is refused.
    """

    _MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
    _PROBES = ("Ab cd", "ab\ncd", "Word, word", "word?! Été.", "x 1 'y' -z-", "straße ÀÉ; ß", "Łódź ŷŽž", "can't it's")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is None or self.tokenizer.pre_tokenizer is None:
            raise ValueError(f"{path} is not a tokenizer of separate words")
        self.merges = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, bytes] = {"": b""}
        #: How a Latin letter that is a letter to the tokenizer, too, is spelled for the merges.
        self.spelled: dict[str, str] = {}
        for letter in map(chr, range(0x250)):
            normal = self.tokenizer.normalizer.normalize_str(letter) if letter.isalpha() else ""
            if normal.isalpha():
                self.spelled[letter] = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        self.latin = frozenset(self.spelled)
        if any(self.encode(x) != self._plain(x) for x in self._PROBES):
            raise ValueError(f"{path} is not a tokenizer of separate words")

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        known, latin, packed, merges, spell = self.known, self.latin, self.packed, self.merges.tokenize, self.spelled.__getitem__
        for word in words:
            base, marks = word, ""
            if not word.isalpha() and (m := self._MARKED.fullmatch(word)):
                base, marks = m.groups()
            if not latin.issuperset(base):
                known[word] = self._plain(word)
                continue
            if marks not in known:
                known[marks] = self._plain(marks)
            spelled = "".join(map(spell, base))
            if base.isascii():
                # Upper and lower case are one entry.
                base = spelled
            ids = known.get(base)
            if ids is None:
                ids = known[base] = b"".join([packed[x.id] for x in merges(spelled)])
            if base is not word:
                known[word] = ids + known[marks]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        split = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        missing = set().union(*split).difference(self.known)
        if missing:
            self._learn(missing)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        """Ids of one text, which may be long: it is cut at blanks."""
        out, at = [], 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                if cut < at:
                    # No blank in reach: the word is taken whole.
                    found = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                    cut = min(found, default=len(text))
                end = cut + 1
            out += self.encode_all([text[at:end]])
            at = end
        return b"".join(out)


def _opened(uri: str):
    """(filesystem, path) of a folder that Spark also reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _frame(ids: list[int | None], lengths: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(
        [
            struct.pack("<I", len(ids)), np.array([i or 0 for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], np.uint8).tobytes(), np.array(lengths, "<u8").tobytes(), *tokens,
        ]
    )


class FrameWriter:
    """Appends documents to one file."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self._clear()

    def _clear(self) -> None:
        self.ids, self.lengths, self.tokens, self.held = [], [], [], 0

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(tokens) // 4)
        self.tokens.append(tokens)
        self.held += len(tokens) + 17
        if self.held >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if not self.ids:
            return
        content = _frame(self.ids, self.lengths, self.tokens)
        packed = self.zstd.compress(content)
        self.stream.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        present = [i for i in self.ids if i is not None]
        self.index.append((min(present, default=0), max(present, default=-1), len(present) < len(self.ids), sum(self.lengths)))
        self._clear()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack(_ENTRY, *entry) for entry in self.index)
        self.stream.write(struct.pack("<II", _INDEX, len(index)) + index)
        seek = b"".join(struct.pack("<III", *entry) for entry in self.table) + struct.pack(_FOOTER, len(self.table), 0x80, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(seek)) + seek)
        self.stream.close()


class FrameReader:
    """Reads documents of one file, decompressing only the frames it must."""

    def __init__(self, stream, size: int):
        self.stream, self.frames_read = stream, 0
        stream.seek(size - 9)
        count, flags, magic = struct.unpack(_FOOTER, stream.read(9))
        if magic != _SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        tail = count * 12 + 9
        index = count * struct.calcsize(_ENTRY)
        stream.seek(size - tail - 8 - index)
        self.index = list(struct.iter_unpack(_ENTRY, stream.read(index)))
        stream.seek(size - tail)
        self.table = list(struct.iter_unpack("<III", stream.read(count * 12)))
        self.starts = np.concatenate([[0], np.cumsum([c for c, _, _ in self.table])]).astype(int)

    def frame(self, number: int):
        """(doc_ids, lengths, ids) of one frame, after its checksum."""
        import xxhash
        import zstandard

        packed, size, checksum = self.table[number]
        self.stream.seek(int(self.starts[number]))
        content = zstandard.ZstdDecompressor().decompress(self.stream.read(packed), max_output_size=size)
        self.frames_read += 1
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"checksum of frame {number} differs")
        n = struct.unpack_from("<I", content)[0]
        ids = np.frombuffer(content, "<i8", n, 4)
        nulls = np.frombuffer(content, np.uint8, n, 4 + 8 * n)
        lengths = np.frombuffer(content, "<u8", n, 4 + 9 * n).astype(np.int64)
        tokens = np.frombuffer(content, "<u4", int(lengths.sum()), 4 + 17 * n)
        return [None if x else int(i) for i, x in zip(ids, nulls)], lengths, tokens

    def documents(self, wanted: set[int | None] | None = None):
        """(doc_id, ids) in file order, of all or only the wanted documents."""
        for number, (low, high, has_null, _) in enumerate(self.index):
            if wanted is not None and not (None in wanted and has_null) and not any(i is not None and low <= i <= high for i in wanted):
                continue
            ids, lengths, tokens = self.frame(number)
            at = 0
            for doc_id, n in zip(ids, lengths.tolist()):
                if wanted is None or doc_id in wanted:
                    yield doc_id, tokens[at : at + n]
                at += n


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes doc_id and text; returns the manifest ``file_no, path, bytes, n_docs, n_tokens``.

    ``tokenizer`` is the tokenizer file's path on every machine. Files go to a
    new folder under ``out`` (default: the shared folder).
    """
    spark = docs.sparkSession
    folder = f"{(out or shared_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    source = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS text")
    size = source.agg(F.expr("coalesce(sum(octet_length(text)), 0) AS b")).first()["b"]
    files = int(max(1, -(-size // file_bytes)))
    # Range partitions are numbered in key order. Many small ones keep all cores busy while encoding.
    files = max(files, min(2 * spark.sparkContext.defaultParallelism, -(-size // (1 << 20)) or 1))
    ordered = source.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.expr("CAST(spark_partition_id() AS BIGINT)"))
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encoder, writer, docs_in, tokens_in, part = None, None, 0, 0, -1
        for batch in batches:
            if writer is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
                encoder = Encoder(tokenizer)
                where, root = _opened(folder)
                where.create_dir(root, recursive=True)
                name = f"{root}/{part:08d}-{uuid.uuid4().hex}.tok.zst"
                writer = FrameWriter(where.open_output_stream(name, compression=None), frame_bytes)
            ids, texts, at = batch.column("doc_id").to_pylist(), batch.column("text"), 0
            while at < len(ids):
                # One text after another, so that a batch is never held as Python objects.
                block, held = [], 0
                while at + len(block) < len(ids) and held < PIECE:
                    block.append(texts[at + len(block)].as_py())
                    held += len(block[-1])
                last = [encoder.encode(block.pop())] if held >= PIECE else []
                for doc_id, tokens in zip(ids[at:], encoder.encode_all(block) + last):
                    writer.add(doc_id, tokens + end)
                    docs_in += 1
                    tokens_in += len(tokens) // 4 + 1
                at += len(block) + len(last)
        if writer is not None:
            writer.close()
            yield [part], [f"{folder}/{name.rsplit('/', 1)[1]}"], [where.get_file_info(name).size], [docs_in], [tokens_in]

    schema = "file_no BIGINT, path STRING, bytes BIGINT, n_docs BIGINT, n_tokens BIGINT"
    return written(map_batches(ordered.select("doc_id", "text", "part"), write, schema), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, part_no, row_no`` of every document, from the files."""
    starts = manifest.selectExpr(
        "path", "bytes", "file_no",
        "coalesce(sum(n_tokens) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start",
    )

    def read(batches):
        for batch in batches:
            for path, size, number, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                where, name = _opened(path)
                out = [[] for _ in range(5)]
                with where.open_input_file(name) as stream:
                    for row, (doc_id, ids) in enumerate(FrameReader(stream, size).documents()):
                        for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), row)):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) == 20_000:
                            yield *out[:4], [number] * len(out[0]), out[4]
                            out = [[] for _ in range(5)]
                yield *out[:4], [number] * len(out[0]), out[4]

    files = manifest.sparkSession.sparkContext.defaultParallelism
    return map_batches(
        starts.repartition(files, "path"), read,
        "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, file_no BIGINT, row_no BIGINT",
    )
