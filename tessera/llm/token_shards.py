"""Token ids in binary shards: a wavelet matrix for each shard.

Documents are range-partitioned by id, tokenized where they land, and written in
ascending order, one file for each shard, to the shared folder. The table of shards
(path, order, counts) is what the job returns and commits: a task that is run again
writes a file of its own name, and only the files of the committed table count.

Tokenizing: the library encodes each distinct white-space word of a batch once. Words
are independent of each other in these tokenizers: no piece spans white space.

Defined results: a null text is empty and has the end id alone; a null id comes first; rows
with one id are ordered by a digest of the text; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import wavelet
from tessera.llm._shared import map_batches, materialize, partitions, session_of, shared_path, table

#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 24
#: Distinct words whose ids a worker keeps; the others are encoded anew in each group of texts.
REMEMBERED = 500_000
#: Words that are encoded as one text.
_GROUP = 256
#: Bytes of text whose words are looked up together.
_TEXT_BYTES = 8 << 20
#: Words whose ids are gathered in one step.
_STEP = 1 << 14

_SHARDS = "shard long, path string, n_docs long, n_tokens long, bytes long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class WordEncoder:
    """Ids of texts, by way of their distinct words."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known = pa.array([], pa.large_string())  # a word's place is its number
        self.begin = np.zeros(1, np.int32)  # where the ids of each number begin in flat
        self.flat = np.zeros(0, self.dtype)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and their number in each."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        return np.fromiter(chain.from_iterable(lists), self.dtype, int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, their ids and sizes. Words of letters alone are one
        piece each, and the last id of a piece is marked, so many of them are encoded as
        one text and cut apart again; a text that yields another number of pieces than
        words is encoded word by word."""
        plain = [w for w in words if w.isalpha() and (w.isascii() or unicodedata.is_normalized("NFC", w))]
        chosen = set(plain)
        rest = [w for w in words if w not in chosen]
        groups = [plain[i : i + _GROUP] for i in range(0, len(plain), _GROUP)]
        flat, sizes = self._encode([" ".join(g) for g in groups])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(self.ends[flat])])
        right = (ends[bounds[1:]] - ends[bounds[:-1]]) == np.fromiter(map(len, groups), np.int64, len(groups))
        if not right.all():
            rest += [w for g, ok in zip(groups, right, strict=True) if not ok for w in g]
            flat = flat[np.repeat(right, sizes)]
            groups = [g for g, ok in zip(groups, right, strict=True) if ok]
        cuts = np.flatnonzero(self.ends[flat]) + 1
        more, more_sizes = self._encode(rest)
        return [*chain.from_iterable(groups), *rest], np.concatenate([flat, more]), np.concatenate([np.diff(cuts, prepend=0).astype(np.int32), more_sizes])

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the number of ids of each text."""
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary
        number = pc.index_in(distinct, value_set=self.known)
        new = number.is_null()
        words, ids, sizes = self._words(distinct.filter(new).to_pylist())
        learned = pa.array(words, pa.large_string())
        flat, begin = np.concatenate([self.flat, ids]), np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes, dtype=np.int32)])
        number = number.fill_null(0).to_numpy().copy()
        number[new.to_numpy(zero_copy_only=False)] = pc.index_in(distinct.filter(new), value_set=learned).to_numpy() + len(self.known)
        at = number[coded.indices.to_numpy()]
        if room := max(0, min(len(words), REMEMBERED - len(self.known))):
            self.known = pa.concat_arrays([self.known, learned[:room]])
            self.begin = begin[: len(self.known) + 1].copy()
            self.flat = flat[: self.begin[-1]].copy()
        first, size = begin[at], begin[at + 1] - begin[at]
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
        per_text = before[offsets[1:]] - before[offsets[:-1]] + 1
        ids = np.empty(int(before[-1]), self.dtype)
        for lo in range(0, len(at), _STEP):  # a step's index arrays stay in the processor's cache
            hi = min(lo + _STEP, len(at))
            a, b = before[lo], before[hi]
            ids[a:b] = flat[np.arange(a, b, dtype=np.int32) + np.repeat(first[lo:hi] - before[lo:hi], size[lo:hi])]
        out = np.full(len(ids) + len(texts), end, self.dtype)
        done = 0
        for i, n in enumerate((per_text - 1).tolist()):
            out[done + i : done + i + n] = ids[done : done + n]
            done += n
        return out, per_text


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it. The schemes that Hadoop has
    for one object store (s3a, s3n) are one scheme here."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _write(folder: str, vocabulary: str, end: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        encode = encoder(vocabulary).encode
        part, seq = TaskContext.get().partitionId(), 0
        tokens, sizes, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal seq
            every = np.concatenate(tokens)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
            file = wavelet.encode(every, bounds, ids)
            path = f"{root}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            with fs.open_output_stream(path) as out:
                out.write(file)
            row = [[(part << 32) + seq], [path], [len(ids)], [len(every)], [len(file)]]
            seq += 1
            tokens.clear(), sizes.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["shard", "path", "n_docs", "n_tokens", "bytes"])

        for batch in batches:
            # A batch's texts are encoded a few MB at a time, so memory follows a shard.
            nbytes = pc.binary_length(batch["text"]).fill_null(0).to_numpy()
            group = np.cumsum(nbytes, dtype=np.int64) // _TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                out, per = encode(batch["text"].slice(lo, hi - lo), end)
                tokens.append(out), sizes.append(per)
                ids.extend(batch["doc_id"].slice(lo, hi - lo).to_pylist())
                if sum(map(len, tokens)) >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    return run


def write_shards(docs: DataFrame, vocabulary: str, end: int = 1, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards of ``docs`` (doc_id, text) and returns their committed table:
    shard (ascending in document order), path, n_docs, n_tokens, bytes, start (tokens of
    all shards before it)."""
    spark = session_of(docs)
    folder = folder or shared_path(spark, "token-shards")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = materialize(map_batches(ordered, _write(folder, vocabulary, end, shard_tokens), _SHARDS), "shard-table")
    # A row for each shard, not for each document: few enough for one task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return shards.withColumn("start", F.sum("n_tokens").over(before) - F.col("n_tokens")).withColumn("root", F.lit(folder))


def _read():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, root in zip(*(batch[c].to_pylist() for c in ("path", "start", "root")), strict=True):
                fs, _ = file_system(root)
                with fs.open_input_stream(path) as file:
                    shard = wavelet.decode(file.read())
                tokens = shard.decode().astype("<u4")
                bounds = shard.bounds.tolist()
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(start + shard.bounds[:-1]), pa.array(np.diff(shard.bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(shards: DataFrame) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens (end id included), ids_crc32."""
    n = partitions(session_of(shards))
    return map_batches(shards.select("shard", "path", "start", "root").repartition(n, "shard"), _read(), _DOCS)


def open_shard(path: str, root: str) -> wavelet.Shard:
    fs, _ = file_system(root)
    with fs.open_input_stream(path) as file:
        return wavelet.decode(file.read())


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_documents(write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))
