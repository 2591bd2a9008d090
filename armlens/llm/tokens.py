"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, for each part, ``*.tokens`` (unsigned ids, little-endian), ``*.offsets`` (unsigned
64-bit, where each document starts in the part, and the end) and ``*.ids`` (signed 64-bit
document ids), and ``manifest.json`` with the width of an id and every part's base: the ids in
all parts before it, a prefix sum of the parts' counts. Parts are ranges of ascending ids.
"""

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: The id written for a document without one.
NO_ID = -(1 << 63)
#: Pieces a worker remembers, and characters tokenised at a time.
REMEMBERED = 1_000_000
AT_ONCE = 1 << 20
DOCS_AT_ONCE = 4096

# White space as the vocabulary's splitting rule knows it, and letters that it
# surely takes for letters. A run of such letters that ends before an ASCII non-letter, and a run
# without white space, begin and end where the rule splits, so pieces encode on their own.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PIECE = re.compile(rf" ?[{LETTER}]++(?=[\x00-@\[-`{{-\x7f]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BREAK = re.compile(rf"(?<=[^{SPACE}]) (?=[A-Za-z])")
ONE_WORD = re.compile(rf" ?[^{SPACE}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by a tokenizer file, with the ids of each piece remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # texts are cut at added tokens before it sees them
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.line = self._ids("\n")
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.added = {t: np.array([i], self.width).tobytes() for t, i in added.items()}
        longest_first = sorted(added, key=lambda t: (-len(t), t))
        self.cuts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _learn(self, pieces: list[str]) -> None:
        """Encode unknown pieces; words go through together, a line break between them."""
        words = [p for p in pieces if ONE_WORD.fullmatch(p)]
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            ids = self._ids("\n".join(some))
            cuts = np.flatnonzero(ids == self.line[0])
            if len(self.line) == 1 and len(cuts) == len(some) - 1:
                parts = np.split(ids, cuts)
                self.known.update((p, (x[1:] if k else x).tobytes()) for k, (p, x) in enumerate(zip(some, parts)))
        for p in pieces:
            if p not in self.known:
                self.known[p] = self._ids(p).tobytes()

    def segments(self, text: str) -> Iterator[str]:
        """The text in parts of bounded size, cut before a word."""
        at = 0
        while len(text) - at > AT_ONCE:
            cut = BREAK.search(text, at + AT_ONCE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the library gives them by default: an added token in a text is one id."""
        if not self.cuts:
            return self.encode(texts)
        cut = [self.cuts.split(t) for t in texts]  # text, token, text, ..., text
        plain = iter(self.encode([part for parts in cut for part in parts[::2]]))
        return [b"".join(self.added[p] if k % 2 else next(plain) for k, p in enumerate(parts)) for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``width``, with added tokens read as any other text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.segments(text):
                waiting.append((k, PIECE.findall(part)))
                size += len(part)
                if size >= AT_ONCE:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [b"".join(x) for x in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        new = set().union(*(w for _, w in waiting)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*(w for _, w in waiting))
        self._learn(sorted(new))
        for k, pieces in waiting:
            out[k].append(b"".join(map(self.known.__getitem__, pieces)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> dict:
    """Write every document's ids and the manifest, which is also returned.

    Documents are dealt to parts by ranges of ids and written in ascending order; those that share
    an id are ordered by a hash of the text and the text. A null text is an empty one and has
    only the end id; a null id comes first. A part's name holds its attempt, and the manifest names
    the parts of successful attempts only, so a task that is run again does no harm.
    """
    disk, root = fs.FileSystem.from_uri(folder)
    disk.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(path)
        tail = np.array([end_id], enc.width).tobytes()
        out_disk, out_root = fs.FileSystem.from_uri(folder)
        part = context.partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        files, docs_done, ids_done = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [out_disk.open_output_stream(f"{out_root}/{name}.{x}") for x in ("tokens", "offsets", "ids")]
            ids = batch.column(0).fill_null(NO_ID)
            coded = enc.ids([t or "" for t in batch.column(1).to_pylist()])
            counts = np.array([len(c) // enc.width.itemsize + 1 for c in coded], np.uint64)
            starts = ids_done + np.concatenate(([0], np.cumsum(counts)[:-1])).astype("<u8")
            for c in coded:
                files[0].write(c)
                files[0].write(tail)
            files[1].write(starts.astype("<u8").tobytes())
            files[2].write(ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs_done += len(coded)
            ids_done += int(counts.sum())
        if files is not None:
            files[1].write(np.array([ids_done], "<u8").tobytes())
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "name": [name], "docs": [docs_done], "tokens": [ids_done], "width": [enc.width.str]}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    done = rows.mapInArrow(write, "part long, name string, docs long, tokens long, width string").collect()
    parts = [r.asDict() for r in sorted(done, key=lambda r: r["part"])]  # one row per part
    for p, base in zip(parts, accumulate([p["tokens"] for p in parts], initial=0)):
        p["base"] = base
    manifest = {"end_id": end_id, "parts": parts}
    with disk.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(disk: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file of numbers: memory-mapped where the store is a file system of this machine, else read."""
    if isinstance(disk, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with disk.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files of a folder.

    ``start`` counts the ids of all documents before it; the checksum is over the ids as
    little-endian unsigned 32-bit integers.
    """
    disk, root = fs.FileSystem.from_uri(folder)
    with disk.open_input_stream(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame([(p["name"], p["base"], p["width"]) for p in parts], "name string, base long, width string")

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        in_disk, in_root = fs.FileSystem.from_uri(folder)
        for row in batch.to_pylist():
            tokens = _mapped(in_disk, f"{in_root}/{row['name']}.tokens", row["width"])
            offsets = _mapped(in_disk, f"{in_root}/{row['name']}.offsets", "<u8").astype(np.int64)
            ids = _mapped(in_disk, f"{in_root}/{row['name']}.ids", "<i8")
            for at in range(0, len(ids), DOCS_AT_ONCE):
                cut = offsets[at : at + DOCS_AT_ONCE + 1]
                crc = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(cut[:-1], cut[1:])]
                some = ids[at : at + DOCS_AT_ONCE]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.asarray(some), mask=np.asarray(some == NO_ID)),
                        pa.array(cut[:-1] + row["base"]),
                        pa.array(np.diff(cut)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = listed.repartition(max(len(parts), 1))
    return spread.mapInArrow(lambda batches: (out for b in batches for out in read(b)), schema)
