"""Byte-level BPE by a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch.llm.common import modest_batches, spread_count, text_or_empty

# fixed values: how the vocabulary's published tokenizer cuts texts into words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# characters that both pattern engines put in the same classes; other texts are cut by the library itself
UNUSUAL = re.compile("[^\x00-\u052f\u2000-\u206f]")
USUAL = [chr(c) for c in range(0x2070) if not UNUSUAL.match(chr(c))]

#: Documents of about this many characters share one list of words and meet in one task.
CHUNK_CHARACTERS = 8_000_000
#: Words are dealt to so many buckets; the distinct words of one bucket meet in one task.
WORD_BUCKETS = 256


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _listed(pattern: str) -> str:
    """The usual characters of a class, as ranges of their codes."""
    ranges: list[list[int]] = []
    for code in map(ord, regex.findall(pattern, "".join(USUAL))):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in ranges)


@lru_cache(maxsize=1)
def _usual_words() -> re.Pattern[str]:
    """``WORDS`` with its classes written out: on usual characters ``re`` finds the same words in half the time."""
    letters, numbers, spaces = map(_listed, (r"\p{L}", r"\p{N}", r"\s"))
    pattern = WORDS.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    for name, listed in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        pattern = pattern.replace(name, listed)
    return re.compile(pattern)


@lru_cache(maxsize=2)
def _cutter(path: str):
    """The text's words in order; a special token is a word, and words end where one begins."""
    words, library = _usual_words(), _tokenizer(path).pre_tokenizer
    special = sorted(_special_tokens(path), key=len, reverse=True)
    split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def plain(text: str) -> list[str]:
        if UNUSUAL.search(text):
            return [text[start:end] for _, (start, end) in library.pre_tokenize_str(text)]
        return words.findall(text)

    def cut(text: str) -> list[str]:
        if split is None or not any(s in text for s in special):
            return plain(text)
        out: list[str] = []
        for k, part in enumerate(split.split(text)):
            out += [part] if k % 2 else plain(part)
        return out

    return cut


def _byte_values() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable bytes stand for themselves, the rest follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def _piece_list(path: str) -> list[bytes]:
    """Bytes of every token by id."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    value = _byte_values()
    special = _special_tokens(path)
    found = {i: bytes(value[c] for c in piece) for piece, i in vocabulary.items() if piece not in special}
    found |= {i: token.encode() for token, i in special.items()}
    return [found.get(i, b"") for i in range(max(found) + 1)]


@lru_cache(maxsize=2)
def _id_texts(path: str) -> list[bytes]:
    """Every token id in decimal."""
    return [b"%d" % k for k in range(len(_piece_list(path)))]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id and piece (bytes) of every token: as many rows as the vocabulary has, whatever the corpus."""
    return spark.createDataFrame(pd.DataFrame(list(enumerate(_piece_list(path))), columns=["id", "piece"]), "id int, piece binary")


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()


def _squeezed(values: np.ndarray) -> bytes:
    """Compressed 32-bit numbers, all first bytes first, as the high ones are mostly equal."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return _zstd()[0].compress(planes.tobytes())


def _unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _pack(path: str):
    """One row per chunk of documents: each document's words as places in the chunk's list of distinct words, and that list by buckets."""

    def packed(ids: list, places: list[np.ndarray], words: dict[str, int]) -> pd.DataFrame:
        ordered = sorted(words)
        bucket = np.fromiter((zlib.crc32(w.encode()) % WORD_BUCKETS for w in ordered), np.int32, len(ordered))
        by_bucket = np.argsort(bucket, kind="stable")
        ordered, bucket = [ordered[k] for k in by_bucket.tolist()], bucket[by_bucket]
        place = np.empty(len(words), np.int32)
        place[np.fromiter(map(words.__getitem__, ordered), np.int64, len(ordered))] = np.arange(len(words), dtype=np.int32)
        flat = place[np.concatenate(places)]
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(ordered)]
        groups = [(int(bucket[a]), json.dumps(ordered[a:b], ensure_ascii=False).encode()) for a, b in zip(edges, edges[1:])]
        squeeze = _zstd()[0].compress
        # the name is taken from the contents, so a task that runs twice gives the same one
        name = hashlib.sha256(flat.tobytes() + repr(ids).encode())
        for _, group in groups:
            name.update(group)
        name = name.digest()
        row = {
            "chunk": int.from_bytes(name[:8], "little", signed=True), "doc_ids": ids, "lengths": [len(p) for p in places], "places": _squeezed(flat),
            "buckets": [k for k, _ in groups], "lists": [squeeze(g) for _, g in groups],
        }
        return pd.DataFrame([row])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = _cutter(path)
        ids, places, words, size = [], [], defaultdict(count().__next__), 0
        for frame in batches:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                found = cut(text)
                places.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                size += len(text)
                if size >= CHUNK_CHARACTERS:
                    yield packed(ids, places, words)
                    ids, places, words, size = [], [], defaultdict(count().__next__), 0
        if ids:
            yield packed(ids, places, words)

    return run


def _open_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lists of each chunk; takes whole rows, so that their one shuffle serves the documents as well."""
    for frame in batches:
        for chunk, buckets, lists in zip(frame["chunk"], frame["buckets"], frame["lists"]):
            yield pd.DataFrame({"chunk": chunk, "bucket": buckets, "list": lists})


def _encode_lists(path: str):
    """Ids of the words of each list, for lists sorted by bucket: the library sees every word of a bucket once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task has one core: threads of the library's own would only wait for it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, special = _tokenizer(path), _special_tokens(path)
        known: dict[str, bytes] = {}
        current = None
        for frame in batches:
            rows = []
            for chunk, bucket, packed in zip(frame["chunk"], frame["bucket"], frame["list"]):
                if bucket != current:
                    known, current = {}, bucket
                words = json.loads(_zstd()[1].decompress(packed))
                new = [w for w in words if w not in known]
                for w, coded in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                    known[w] = array("i", [special[w]] if w in special else coded.ids).tobytes()
                found = [known[w] for w in words]
                sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
                rows.append((chunk, bucket, _squeezed(sizes), _squeezed(np.frombuffer(b"".join(found), np.int32))))
            yield pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "ids"])

    return run


def _join_back(path: str, with_text: bool):
    """Each document's words take, by place, their ids and the bytes of the ids' pieces."""

    def run(chunks: pa.Table, words: pa.Table) -> pa.Table:
        piece, name = _piece_list(path), _id_texts(path)
        # chunks of equal contents have equal names and lists
        lists = dict(zip(words["bucket"].to_pylist(), zip(words["counts"].to_pylist(), words["ids"].to_pylist())))
        counts, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for bucket in sorted(lists):
            own_counts, own_ids = map(_unsqueezed, lists[bucket])
            counts.append(own_counts)
            ids.append(own_ids)
        counts, ids = np.concatenate(counts), np.concatenate(ids)
        end = np.cumsum(counts, dtype=np.int64)
        begin = end - counts

        def of_words(values: list[bytes], between: bytes) -> list[bytes]:
            own = list(map(values.__getitem__, ids.tolist()))
            at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + len(between))])
            joined, starts, ends = between.join(own), at[begin], np.maximum(at[end] - len(between), at[begin])
            return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

        listed, decoded = of_words(name, b","), of_words(piece, b"")
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")}
        values = [np.zeros(0, np.int32)]
        for doc_ids, lengths, packed in zip(*(chunks[c].to_pylist() for c in ("doc_ids", "lengths", "places"))):
            for doc_id, own in zip(doc_ids, np.split(_unsqueezed(packed), np.cumsum(lengths)[:-1])):
                places, sizes = own.tolist(), counts[own].astype(np.int64)
                n = int(sizes.sum())
                raw = b"".join(map(decoded.__getitem__, places))
                # as the library does, bytes that are no UTF-8 become U+FFFD
                back = raw.decode("utf-8", "replace") if with_text or not raw.isascii() else None
                digest = hashlib.sha256(b",".join(map(listed.__getitem__, places))).hexdigest()
                decoded_digest = hashlib.sha256(raw if raw.isascii() else back.encode()).hexdigest()
                for column, value in zip(out, (doc_id, n, digest, decoded_digest, back if with_text else None)):
                    out[column].append(value)
                if with_text:  # each word's run of ids, end to end
                    values.append(ids[np.repeat(begin[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(n)])
        columns = [pa.array(out["doc_id"], pa.string()), pa.array(out["n_tokens"], pa.int64()), *[pa.array(out[c], pa.string()) for c in ("ids_sha256", "decoded_sha256")]]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_text:
            ends = np.cumsum([0, *out["n_tokens"]]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(ends, np.concatenate(values)), pa.array(out["decoded"], pa.string())]
            names += ["ids", "decoded"]
        return pa.table(columns, names=names)

    return run


def encode(docs: DataFrame, path: str, with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text.

    Each task cuts its documents into words and packs them in chunks: the list
    of a chunk's distinct words, and every document as places in that list.  The
    lists meet by buckets of words, each distinct word of the corpus is encoded
    once, and its ids go back to the chunks that asked, where the documents take
    them by position.  So the texts themselves are never shuffled, only packed
    places and lists.

    Null and empty texts have no tokens; special tokens written in a text are
    read as such, as the library does; null ids and repeated rows are kept as
    they are; only doc_id and text are looked at.  A single text is handled
    whole, however long.
    """
    modest_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text, so that pandas keeps null and large ones as they are
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    n = spread_count(docs.sparkSession)
    kinds = "chunk long, doc_ids array<string>, lengths array<long>, places binary, buckets array<int>, lists array<binary>"
    packed = slim.mapInPandas(_pack(path), kinds).repartition(n, "chunk")
    lists = packed.mapInPandas(_open_chunks, "chunk long, bucket int, list binary")
    sorted_lists = lists.repartition(n, "bucket").sortWithinPartitions("bucket")
    coded = sorted_lists.mapInPandas(_encode_lists(path), "chunk long, bucket int, counts binary, ids binary")
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_text else "")
    out = packed.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_join_back(path, with_text), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of ``tokens`` (doc_id, ids) by a join of every id with its piece.

    Rows are told apart by (doc_id, ids); null or empty ids give an empty text;
    an id outside the vocabulary adds nothing.  Bytes that are no UTF-8 become U+FFFD.
    """
    distinct = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    keyed = distinct.groupBy("doc_id", "ids").agg(F.count(F.lit(1)).alias("copies"))
    placed = keyed.select("doc_id", "ids", "copies", F.posexplode_outer("ids").alias("at", "id"))
    met = placed.join(F.broadcast(pieces(tokens.sparkSession, path)), "id", "left")
    joined = F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece"))))
    texts = met.groupBy("doc_id", "ids").agg(F.first("copies").alias("copies"), F.array_join(joined["piece"], "").alias("hex"))
    read = F.pandas_udf(lambda s: s.map(lambda h: bytes.fromhex(h).decode("utf-8", "replace")), "string")
    out = texts.select("doc_id", read(F.coalesce("hex", F.lit(""))).alias("decoded"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return out.select("doc_id", "decoded")
