"""Token ids in length-delimited binary records with masked checksums, and an offset index beside them."""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, KEPT, keeps, new_path, parts, stored, tidy, tune

END_ID = 1
#: Words of a generation: a worker keeps the ids of the last one and of this one.
CACHE_WORDS = 300_000
#: Stands between new words that are encoded together: one id of its own, and no word with it is encoded so.
_MARK, _TOGETHER = "~", 2000
_MASK = 0xA282EAD8
_HEAD_BYTES, ID_BYTES = 12, 9


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_END_OF_WORD = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[^\W\d_].)[!-&(-/:-@\[-`{-~]*(?=[ \n]|\Z)")
_NOT_SPACE = "\x1c\x1d\x1e\x1f"  # white space for str.split, not for the tokenizer


def words_of(text: str | None) -> list[str]:
    """Words whose ids, one after the other, are those of the text; few distinct ones.

    Signs after a word are words of their own (apostrophes and special tokens aside), and letters are lower case where
    all are Latin-1, which the tokenizer's own normal forms leave alone.
    """
    if not text:
        return []
    if "<|" not in text:
        text = _END_OF_WORD.sub(r" \g<0>", text)
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.split(" ") if any(c in text for c in _NOT_SPACE) else text.split()


class Encoder:
    """Whole texts to token ids with the tokenizers library.

    A vocabulary whose normalizer and splitter never join anything across a space or a line feed is encoded by words:
    each word once, its ids are kept, and the ids of a text are those of its words in order. Whether a vocabulary is of
    that kind is tried on texts of all sorts of joints; any other is encoded by whole texts.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.by_words = self.mark is not None and self._splits()

    def _splits(self) -> bool:
        signs = [chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))]
        texts = ["Two words\nand  a line\n\n end ", " a", "it's 12.5 (x) <b> É\u0301 ßtraße\tñ", " ".join(signs), " ".join(f"a{x} {x}b a{x}b 1{x}2" for x in signs), "\n".join(signs), "a\u00a0b\u2003c \u4e2d\u6587 \U0001f600x", "~ ~x x~ ~"]
        whole = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        try:
            got = [np.frombuffer(x, self.width).tolist() for x in self._by_words(texts)]
        except ValueError:
            return False
        return got == whole

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty), packed in self.width."""
        if self.by_words:
            return self._by_words(texts)
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def _by_words(self, texts: list[str | None]) -> list[bytes]:
        split = [words_of(t) for t in texts]
        cache = self.cache
        if len(cache) > self.cache_words:
            self.older, self.cache = cache, (cache := {})
        new = set().union(*split).difference(cache)
        known = new.intersection(self.older)
        cache.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new -= known
        alone = [w for w in new if _MARK in w] if self.mark is not None else list(new)
        for word, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            cache[word] = np.array(e.ids, self.width).tobytes()
        new = list(new.difference(alone))
        groups = [new[i : i + _TOGETHER] for i in range(0, len(new), _TOGETHER)]
        for words, e in zip(groups, self.tokenizer.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.width)
            cuts = np.flatnonzero(ids == self.mark) * self.width.itemsize
            if len(cuts) != len(words) - 1:
                raise ValueError("the tokenizer joins words")
            packed, step = ids.tobytes(), self.width.itemsize
            for word, a, b in zip(words, [0, *(cuts + step).tolist()], [*cuts.tolist(), len(packed)], strict=True):
                cache[word] = packed[a:b]
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker: its words stay known from task to task."""
    return Encoder(path)


KEPT["tokens"] = encoder_of.cache_clear


def id_bytes(doc_id: int | None) -> bytes:
    return struct.pack("<?q", doc_id is None, doc_id or 0)


def id_of(payload: bytes) -> int | None:
    null, doc_id = struct.unpack_from("<?q", payload)
    return None if null else doc_id


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Length (u64), masked crc of the length, payload, masked crc of the payload; little-endian."""
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(zlib.crc32(n))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def read_frame(stream) -> bytes | None:
    """The next payload, None at the end; ValueError if a length, checksum or the end doesn't fit."""
    head = stream.read(_HEAD_BYTES)
    if not head:
        return None
    if len(head) < _HEAD_BYTES:
        raise ValueError("a record's head is cut off")
    n, crc = struct.unpack("<QI", head)
    if masked(zlib.crc32(head[:8])) != crc:
        raise ValueError("a record's length is damaged")
    payload, end = stream.read(n), stream.read(4)
    if len(payload) < n or len(end) < 4 or masked(zlib.crc32(payload)) != struct.unpack("<I", end)[0]:
        raise ValueError("a record is damaged or cut off")
    return payload


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write_records(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the token ids of docs below path in ascending id order; returns the stored manifest, a row per file.

    A file `part-N.rec` holds the records of one range of ids, `part-N.idx` the offset (u64) and number of ids (u64)
    of each, for reads in any order. A payload is a null flag, the id (i64) and the token ids (2 bytes each if the
    vocabulary allows, else 4), end_id last. Files appear under their names when they are whole, so a task that is
    run again replaces its file. Null ids come first; of equal ids texts go by hash; repeated rows are records each. Null
    and empty texts are one end id; long texts are one record. Other columns are ignored. An empty table has no files.
    """
    spark = tune(docs.sparkSession)
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(parts(spark), "_id", "_tie").sortWithinPartitions("_id", "_tie")
    out = pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps("tokens")
        part = TaskContext.get().partitionId()
        encoder, n_docs, n_tokens, offset, index, sink = encoder_of(tokenizer), 0, 0, 0, [], None
        fs, root = _fs(path)
        end, width = np.array([end_id], encoder.width).tobytes(), encoder.width.itemsize
        name, draft = f"{root}/part-{part:06d}", f"{root}/.{uuid.uuid4().hex}"
        for b in batches:
            if b.num_rows and sink is None:
                sink = fs.open_output_stream(f"{draft}.rec")
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                record = frame(id_bytes(doc_id) + ids + end)
                index.append((offset, len(ids) // width + 1))
                sink.write(record)
                offset, n_docs, n_tokens = offset + len(record), n_docs + 1, n_tokens + index[-1][1]
        if sink is None:
            return
        sink.close()
        with fs.open_output_stream(f"{draft}.idx") as f:
            f.write(np.array(index, "<u8").tobytes())
        tidy()
        for kind in ("idx", "rec"):
            fs.move(f"{draft}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"part-{part:06d}", "n_docs": n_docs, "n_tokens": n_tokens}], out)

    manifest, _ = stored(rows.mapInArrow(write, "part long, file string, n_docs long, n_tokens long"), "records-manifest")
    return manifest.withColumn("start", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def read_records(manifest: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Reads the files of a manifest: doc_id, start (ids before it in the whole), n_tokens, ids_crc32 and file, offset.

    Lengths, checksums and the index are checked; damage raises ValueError.
    """
    spark = manifest.sparkSession
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("offset", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        width = encoder_of(tokenizer).width
        for b in batches:
            for m in b.to_pylist():
                with fs.open_input_stream(f"{root}/{m['file']}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                start, rows = m["start"], []

                def batch(rows):
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

                with fs.open_input_stream(f"{root}/{m['file']}.rec", buffer_size=1 << 20) as f:
                    for offset, n in index.tolist():
                        payload = read_frame(f)
                        if payload is None or len(payload) != ID_BYTES + n * width.itemsize:
                            raise ValueError(f"{m['file']} and its index differ")
                        ids = np.frombuffer(payload, width, offset=ID_BYTES)
                        rows.append((id_of(payload), start, n, zlib.crc32(ids.astype("<u4").tobytes()), m["file"], offset))
                        start += n
                        if len(rows) == BATCH_ROWS:
                            yield batch(rows)
                            rows = []
                    if read_frame(f) is not None:
                        raise ValueError(f"{m['file']} has more records than its index")
                if rows:
                    yield batch(rows)
        tidy()

    one_each = manifest.repartition(parts(spark), "part")
    return one_each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, offset long")


def tokenize_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs to record files in the shared folder and returns what read_records finds there; nulls, long texts,
    ties, repeated rows, other columns and empty tables as in write_records."""
    path = new_path(docs.sparkSession, "records")
    return read_records(write_records(docs, path, tokenizer, id_col, text_col), path, tokenizer)
