"""Token ids as binary files: one zstandard frame per document, one shared
dictionary, an index to every document.

Layout of a store (Parquet carries the bytes, so that any file system Spark
knows will do and a lost task's output is replaced by the commit protocol):

* ``dictionary``: one row, the zstandard dictionary and its SHA-256;
* ``segments``: rows of about ``SEGMENT_BYTES``: shard, segment, the
  dictionary's hash, ``payload`` (frames end to end) and ``entries``, the index:
  doc_id, offset and length of the frame, n_tokens, and the ids of the shard
  before it.  Shards follow each other in doc_id order;
* ``shards``: shard, n_tokens, and the ids of all shards before it.

A short document is read with one index entry, the dictionary and its own
frame.  Ids are serialised as little-endian unsigned integers of 2 or 4 bytes
by vocabulary size.  The dictionary is trained on the serialised ids of a
random sample of about ``SAMPLE_DOCS`` documents, ``SAMPLE_BYTES`` of each at most.

Edge cases: null text counts as empty and gives the end id alone; rows with
equal ids stay, ordered by their frames; null ids come first; an empty table gives
an empty store; further columns are not read."""

from __future__ import annotations

import hashlib
import os
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitext.llm.common import parts, stored, text_of
from bitext.session import ensure_checkpoint_dir

DICT_BYTES = 64 << 10
SAMPLE_DOCS = 1000
SEGMENT_BYTES = 1 << 20
LEVEL = 3
WORDS, PIECES = 120_000, 120_000  # remembered; as many older ones are kept beside them
SAMPLE_BYTES = 8 << 10  # of a sampled document's ids

_ENTRY = "struct<doc_id:bigint,offset:bigint,length:bigint,n_tokens:bigint,before:bigint>"


class WordIds:
    """Ids of texts by the tokenizers library.

    The file's tokenizer composes, drops white space, folds case and cuts by
    its pattern before it merges.  Ids of a word between spaces never depend on
    its neighbours, so words are remembered; the pieces of new words go to the
    library in batches, joined by spaces, and are told apart by the word-end
    suffix of their last token.

    With ``added`` the file's added tokens are recognised inside a text, as the
    library does by default: texts that may hold one go whole to an untouched
    tokenizer.  Without, they are cut like any other characters."""

    def __init__(self, path_or_json: str, wide: bool | None = None, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        make = Tokenizer.from_str if path_or_json.lstrip().startswith("{") else Tokenizer.from_file
        self.whole = make(path_or_json)
        self.whole.encode_special_tokens = True
        self.untouched = make(path_or_json) if added else None
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()] if added else []
        self.lean = make(path_or_json)
        self.lean.encode_special_tokens = True
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.whole.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 65536 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: The tokenizer's own pattern (a fixed value of its file).
        self.pieces = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+| "
        ).findall  # and the space between words that are cut together
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}
        self.older_words: dict[str, bytes] = {}
        #: what every added token begins with, where that has no case; most texts lack it
        start = os.path.commonprefix(self.added)
        self.sign = start if start == start.lower() == start.upper() else ""
        self.any_added = regex.compile("|".join(map(regex.escape, self.added)), regex.IGNORECASE) if self.added else None

    def _plain(self, words: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn(self, words: list[str]) -> None:
        # words with characters that composition or folding could treat in
        # context, or with inner white space, go to the whole tokenizer
        easy, hard = [], []
        for w in words:
            (easy if w.isascii() and w.isprintable() or _EASY(w) else hard).append(w)
        self.words.update(zip(hard, self._plain(hard)))
        # most words are letters alone, or letters and a mark: their pieces are plain
        letters, marked, other = [], [], []
        for w in easy:
            (letters if w.isalpha() else marked if w[-1] in _MARKS and w[:-1].isalpha() else other).append(w)
        cut = self.pieces(unicodedata.normalize("NFC", " ".join(other)).lower())
        low, ends = [w.lower() for w in letters], [w[:-1].lower() for w in marked]
        wanted = {*cut, *low, *ends, *(w[-1] for w in marked)} - {" "}
        new = self._missing(wanted, self.known, self.older)
        step = 512
        groups = [new[i : i + step] for i in range(0, len(new), step)]
        found = self.lean.encode_batch_fast([" ".join(part) for part in groups], add_special_tokens=False)
        for part, encoding in zip(groups, found):
            ids = np.array(encoding.ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                self.known.update(zip(part, self._plain(part)))
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            self.known.update((p, raw[a * size : b * size]) for p, a, b in zip(part, [0, *cuts], cuts))
        find = self.known.__getitem__
        self.words.update(zip(letters, map(find, low)))
        self.words.update((w, find(p) + find(w[-1])) for w, p in zip(marked, ends))
        if not other:
            return
        done, word = [], []
        for p in cut:
            if p == " ":
                done.append(word[0] if len(word) == 1 else b"".join(word))
                word = []
            else:
                word.append(self.known[p])
        done.append(b"".join(word))
        self.words.update(zip(other, done))

    @staticmethod
    def _missing(wanted: set[str], known: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
        """What neither knows; what only ``older`` knows is remembered again."""
        left = wanted.difference(known)
        back = left.intersection(older)
        known.update(zip(back, map(older.__getitem__, back)))
        return list(left.difference(back))

    def _may_hold(self, text: str) -> bool:
        """An added token, whatever the file says of folding before the search."""
        return self.sign in text and self.any_added.search(text) is not None

    def encode(self, texts: list[str], chunk_chars: int = 2_000_000) -> list[bytes]:
        whole = {}
        if self.added:
            for i, t in enumerate(texts):
                if self._may_hold(t):
                    whole[i] = np.array(self.untouched.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
        if whole:
            rest = iter(self._by_words([t for i, t in enumerate(texts) if i not in whole], chunk_chars))
            return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        return self._by_words(texts, chunk_chars)

    def _by_words(self, texts: list[str], chunk_chars: int) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= chunk_chars):
                size += len(texts[to])
                to += 1
            if len(self.words) > WORDS:
                self.older_words, self.words = self.words, {"": b""}
            if len(self.known) > PIECES:
                self.older, self.known = self.known, {}
            cut = [t.replace("\n", " ").split(" ") for t in texts[at:to]]
            known = self.words
            self._learn(self._missing(set().union(*cut), known, self.older_words))
            out += [b"".join(map(known.__getitem__, words)) for words in cut]
            at = to
        return out


#: Latin letters with marks as single characters, digits, ASCII marks; the rest
#: is left to the library as it stands.
_MARKS = frozenset(".,;:!?)\"'")
_EASY = regex.compile(r"[!-~À-ÖØ-öø-ÿŒœ]*").fullmatch

_CODERS: dict = {}  # of the worker


def _coder(text: str) -> WordIds:
    key = hash(text)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordIds(text, added=True)
    return _CODERS[key]


def _train(samples: list[bytes]) -> bytes:
    """A dictionary's bytes; raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b"\0")[:DICT_BYTES].ljust(256, b"\0")


def write_store(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Encode and write; returns the store's folder."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = sc.broadcast(f.read())  # a vocabulary file, under 2 MB
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def coded(texts: list[str]) -> list[bytes]:
        coder = _coder(tokenizer.value)
        end = np.array([end_id], coder.dtype).tobytes()
        return [ids + end for ids in coder.encode(texts)]

    def sample(batches):
        for b in parts(batches):
            some = [ids[:SAMPLE_BYTES] for ids in coded([t[:SAMPLE_BYTES] for t in b.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["ids"])

    share = SAMPLE_DOCS / max(docs.count(), SAMPLE_DOCS)
    some = rows.filter(F.rand(7) < share).select("text").mapInArrow(sample, "ids binary")
    dictionary = _train([bytes(r.ids) for r in some.collect()])
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, dictionary)], "hash binary, dictionary binary").write.parquet(f"{path}/dictionary")
    shared = sc.broadcast(dictionary)

    def compress(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value))
        size = _coder(tokenizer.value).dtype.itemsize
        for b in parts(batches):
            ids = coded(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // size for x in ids], pa.int64()),
                 pa.array([packer.compress(x) for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "frame"],
            )

    frames = stored(rows.mapInArrow(compress, "doc_id long, n_tokens long, frame binary"), "frames")
    dealt = frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")

    def segments(batches):
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        payload, entries = bytearray(), []

        def row():
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "segment": segment, "dictionary": digest, "payload": bytes(payload), "entries": entries}],
                schema=pa.schema(
                    [("shard", pa.int32()), ("segment", pa.int32()), ("dictionary", pa.binary()),
                     ("payload", pa.binary()),
                     ("entries", pa.list_(pa.struct([(k, pa.int64()) for k in ("doc_id", "offset", "length", "n_tokens", "before")])))]
                ),
            )

        for b in batches:
            for doc_id, n_tokens, frame in zip(*(c.to_pylist() for c in b.columns)):
                if payload and len(payload) + len(frame) > SEGMENT_BYTES:
                    yield row()
                    segment, payload, entries = segment + 1, bytearray(), []
                entries.append({"doc_id": doc_id, "offset": len(payload), "length": len(frame), "n_tokens": n_tokens, "before": before})
                payload += frame
                before += n_tokens
        if entries:
            yield row()

    schema = f"shard int, segment int, dictionary binary, payload binary, entries array<{_ENTRY}>"
    dealt.mapInArrow(segments, schema).write.parquet(f"{path}/segments")
    # one row per shard: as many as the sort had partitions
    sizes = spark.read.parquet(f"{path}/segments").select(
        "shard", F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["n_tokens"]).alias("n")
    )
    sizes = sizes.groupBy("shard").agg(F.sum("n").alias("n_tokens"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("before", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).write.parquet(f"{path}/shards")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers),
    read from the files through the index."""
    kept = spark.read.parquet(f"{path}/dictionary").first()
    digest, dictionary = bytes(kept["hash"]), bytes(kept["dictionary"])
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the dictionary is damaged")
    shared = spark.sparkContext.broadcast(dictionary)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value))
        for b in batches:
            for row in b.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError("a segment was written with another dictionary")
                out = []
                for e in row["entries"]:
                    raw = unpacker.decompress(row["payload"][e["offset"] : e["offset"] + e["length"]])
                    size, left = divmod(len(raw), e["n_tokens"])
                    if left or size not in (2, 4):
                        raise ValueError("a frame does not hold what its index entry says")
                    ids = np.frombuffer(raw, f"<u{size}").astype("<u4").tobytes()
                    out.append((row["shard"], e["doc_id"], e["before"], e["n_tokens"], ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["shard", "doc_id", "local", "n_tokens", "ids"],
                )

    rows = spark.read.parquet(f"{path}/segments").mapInArrow(
        run, "shard int, doc_id long, local long, n_tokens long, ids binary"
    )
    shards = spark.read.parquet(f"{path}/shards").select("shard", "before")
    return rows.join(shards, "shard").select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids"
    )
