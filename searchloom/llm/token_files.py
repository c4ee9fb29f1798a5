"""Token ids as flat binary files that are read back through memory maps.

Format, one shard per partition of the range-partitioned, sorted documents, in one folder of the shared storage:

- ``NAME.ids``: the ids of all documents of the shard, little-endian unsigned 16 bit if the vocabulary fits, else 32 bit;
- ``NAME.off``: little-endian unsigned 64-bit offsets into the shard, one more than documents;
- ``NAME.doc``: the document ids, little-endian signed 64 bit; ``NULL_ID`` stands for a null id;
- the shard table (Parquet): shard number, file name, documents, ids, and the shard's bases: documents and
  ids in all shards before it, from prefix sums over the shard counts.

A document's global start is its shard's base plus its offset, so no shard needs rewriting. A task writes under a name of
its own and hands the name on; a task that runs twice leaves a file nobody refers to.

Defined results: a null text is an empty one and holds the end id alone; an id that is no whole number counts as null; null ids come first; repeated rows are
written one by one, those of one id in the order of their text's hash; an empty table gives no shard and no row.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.session import scratch_path

NULL_ID = -(2**63)
END_ID = 2
# white space as the tokenizer's own pattern has it, without and with the blank and the line feed
_RARE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = f" \n{_RARE}"
_ODD = re.compile(f"[{_RARE}]")
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# marks at a word's end that are always a piece of their own behind a letter or digit
_TAIL = ".,;:!?"
# words and parts of words that one Python worker remembers for good, about 200 bytes each: workers live on, so this stays in the other stages' memory
MEMO = 400_000


class Encoder:
    """Ids of whole texts from a byte-level tokenizer of the tokenizers library, as packed unsigned integers.

    Such a tokenizer cuts a text at white space before anything else, so a word with the blank before it always has the
    same ids wherever it stands. Words already encoded are remembered; the new ones of a batch go to the library as one text, a line for each.
    Texts of words parted by single blanks and line feeds are split plainly, others by the tokenizer's
    rule for white space; texts with one of its added tokens are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self._ids("\n")
        self.first: dict[str, bytes] = {}  # without a blank before it; also chunks, which bring their own
        self.later: dict[str, bytes] = {}  # after a blank

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text, without the end id."""
        found: list[list[list[bytes]] | None] = []
        missing: tuple[list, list] = [], []  # places without a blank and with one: list, index, word
        one, more = self.first.get, self.later.get
        for text in texts:
            lines = self._cut(text)
            if lines is None:
                found.append(None)
                continue
            own = []
            for head, rest in lines:
                values = [*map(one, head), *map(more, rest)]
                if None in values:
                    i = -1
                    for _ in range(values.count(None)):
                        i = values.index(None, i + 1)
                        later = i >= len(head)
                        missing[later].append((values, i, rest[i - len(head)] if later else head[i]))
                own.append(values)
            found.append(own)
        for places, memo, blank in ((missing[0], self.first, ""), (missing[1], self.later, " ")):
            full, before = len(self.first) + len(self.later) >= MEMO, len(self.first)
            known = self._learn({word for _, _, word in places}, memo, blank)
            for values, i, word in places:
                values[i] = memo[word]
            # what comes early comes often: a full memory keeps that and forgets all that this batch brought
            if full:
                for word in known:
                    memo.pop(word, None)
                while len(self.first) > before:
                    self.first.popitem()
        feed = self.line.tobytes()
        return [
            self._ids(text).tobytes() if lines is None else feed.join([b"".join(values) for values in lines]) for text, lines in zip(texts, found)
        ]

    def _cut(self, text: str) -> list[tuple[list[str], list[str]]] | None:
        """Lines as words without, and words with, a blank before them; one line of chunks for other texts; None: encode whole."""
        if any(map(text.__contains__, self.added)):
            return None
        plain = not _ODD.search(text) and not any(map(text.__contains__, ("  ", "\n\n", " \n", "\n ")))
        if not plain or text[:1] in (" ", "\n", "") or text[-1] in " \n":
            return [(_CHUNK.findall(text), [])]
        lines = [line.split(" ") for line in text.split("\n")]
        return [(words[:1], words[1:]) for words in lines]

    def _learn(self, words: set[str], memo: dict[str, bytes], blank: str) -> set[str]:
        """Puts ``words``, and what they begin with, into ``memo``; returns what is new there."""
        cores = {}
        for word in words:
            core = word.rstrip(_TAIL)
            cores[word] = core if core and core[-1].isalnum() else word
        new = {c for c in cores.values() if c not in memo}
        memo.update(self._encoded(new, blank))
        tails = {word[len(core) :] for word, core in cores.items() if len(core) < len(word)}
        self.first.update(self._encoded({t for t in tails if t not in self.first}, ""))
        for word, core in cores.items():
            if len(core) < len(word):
                memo[word] = memo[core] + self.first[word[len(core) :]]
        new.update(words)
        return new

    def _encoded(self, words: set[str], blank: str) -> dict[str, bytes]:
        """Ids of words after ``blank``; words that are white space or hold a line feed are encoded one by one."""
        alone = [w for w in words if "\n" in w or not w or w.isspace()]
        out = {w: self._ids(w).tobytes() for w in alone}
        lines = list(words.difference(alone))
        for low in range(0, len(lines), 1000):
            some = lines[low : low + 1000]
            ids = self._ids("\n".join([blank + w for w in some]))
            ends = np.flatnonzero(ids == self.line[0]).tolist()
            if len(ends) != len(some) - 1:
                raise ValueError("the tokenizer does not keep a line feed apart")
            raw, size, start = ids.tobytes(), self.kind.itemsize, 0
            for word, end in zip(some, [*ends, len(ids)]):
                out[word] = raw[size * start : size * end]
                start = end + 1
        return out


@contextmanager
def _without_cycles() -> Iterator[None]:
    """No search for reference cycles meanwhile: many lists of many words are made and dropped here, and none has a cycle."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file; it lives on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` into shards below ``folder`` (default: a new one in the shared folder); returns the shard table."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "llm-tokens")
    # a null id would make pandas read all ids as floats, which large ids do not survive
    number = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NULL_ID))
    rows = docs.select(number.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    # the text's hash parts the rows of one id, or of none, over shards
    ordered = rows.withColumn("_hash", F.xxhash64("body")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "body").drop("_hash")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.kind).tobytes()
        store.create_dir(base, recursive=True)
        offsets, ids, at = [np.zeros(1, "<u8")], [], 0
        with store.open_output_stream(f"{base}/{name}.ids") as out, _without_cycles():
            for frame in batches:
                for low in range(0, len(frame), 256):
                    part = frame.iloc[low : low + 256]
                    packed = enc.encode([b if b is not None else "" for b in part["body"]])
                    out.write(end.join(packed) + end)
                    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // enc.kind.itemsize + 1
                    stops = at + np.cumsum(sizes)
                    offsets.append(stops.astype("<u8"))
                    at = int(stops[-1])
                ids.append(frame["doc_id"].to_numpy("<i8"))
        found = np.concatenate(ids) if ids else np.empty(0, "<i8")
        for ending, values in (("off", np.concatenate(offsets)), ("doc", found)):
            with store.open_output_stream(f"{base}/{name}.{ending}") as out:
                out.write(values.tobytes())
        yield pd.DataFrame({"shard": [shard], "name": [name], "docs": [len(found)], "ids": [at], "bytes_per_id": [enc.kind.itemsize]})

    counts = ordered.mapInPandas(write, "shard int, name string, docs bigint, ids bigint, bytes_per_id int")
    table = f"{folder}/shards.parquet"
    counts.write.parquet(f"{folder}/counts.parquet")
    # one row per shard, far fewer than documents: prefix sums on the driver give the bases
    found = [r for r in spark.read.parquet(f"{folder}/counts.parquet").orderBy("shard").toLocalIterator() if r["docs"]]
    doc_base = accumulate((r["docs"] for r in found), initial=0)
    id_base = accumulate((r["ids"] for r in found), initial=0)
    rows = [(*r, d, i) for r, d, i in zip(found, doc_base, id_base)]
    kind = "shard int, name string, docs bigint, ids bigint, bytes_per_id int, doc_base bigint, id_base bigint"
    spark.createDataFrame(rows, kind).write.parquet(table)
    return spark.read.parquet(table).withColumn("folder", F.lit(folder))


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file of the store as an array: a memory map where it is a local path, else one read."""
    store, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    path = f"{base}/{name}"
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def read_tokens(spark: SparkSession, shards: DataFrame, step: int = 2000) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (ids as 32-bit integers), ``shard``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.itertuples():
                ids = _mapped(r.folder, f"{r.name}.ids", f"<u{r.bytes_per_id}")
                offsets = _mapped(r.folder, f"{r.name}.off", "<u8")
                docs = _mapped(r.folder, f"{r.name}.doc", "<i8")
                for low in range(0, len(docs), step):
                    ends = offsets[low : low + step + 1].astype(np.int64)
                    wide = ids[ends[0] : ends[-1]].astype("<u4")
                    cuts = ((ends - ends[0]) * 4).tolist()
                    raw = memoryview(wide).cast("B")
                    part = docs[low : low + step]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.Series(part).astype("Int64").mask(part == NULL_ID) if (part == NULL_ID).any() else part,
                            "start": ends[:-1] + r.id_base,
                            "n_tokens": np.diff(ends),
                            "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])],
                            "shard": r.shard,
                        }
                    )

    n = max(1, shards.count())
    names = shards.select("shard", "name", "bytes_per_id", "id_base", "folder").repartition(n, "shard")
    return names.mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")
