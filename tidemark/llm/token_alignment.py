"""Alignment of the tokens of two tokenizers over the same bytes: a byte-level BPE (A) and a sentencepiece model (B).

A text is cut into chunks at each single space between two characters that are not white space.  Neither tokenizer has
tokens across such a place (A splits there; no piece of B has a space behind another character, which is checked when the
model is read, or else a text is one chunk), so both end a token there, and a chunk has the same tokens wherever it
stands.  The distinct chunks of a block of texts are encoded once; the rest is numpy over the numbers of the chunks.

The ends of tokens are byte offsets.  The character offsets of A and the spans of B (which the installed sentencepiece
gives as offset mappings, having given up its immutable protos) are coarse cuts; where several tokens
share a character (the bytes of one character, byte fallback) the decoded bytes of the tokens refine them.  Elementary
stretches between neighbouring ends of either tokenizer are the links: each lies in one token of A and one of B.

How often a pair of ids is linked in the corpus takes no broadcast: each block sums its own pairs, Spark adds them up by
pair, and the totals go back to the blocks that asked for them, where the texts wait as numbers of chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, pieces, written
from tidemark.shipping import ship

#: A block ends at so many distinct chunks or so many bytes of text.
BLOCK_CHUNKS, BLOCK_BYTES = 1 << 19, 1 << 25
#: Distinct chunks that are encoded together.
BATCH = 1 << 15
#: Characters of a long text that are cut into chunks at a time.
PIECE = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_loaded: dict[tuple[str, str], Aligner] = {}


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Both tokenizers and the tables of their tokens' bytes; one per worker."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = _byte_alphabet()
        with open(byte_path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary = told["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max([*vocabulary.values(), *(x["id"] for x in told["added_tokens"])]))
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.bytes_a[i] = bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
        self.splits = not any(_SPACE in p.lstrip(_SPACE) for p in names)
        self.byte = np.array([self.b.is_byte(i) for i in range(len(names))])
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.told = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(most)], object)
        self.told_sizes = np.array([len(x) for x in self.told])
        self.most = most

    @staticmethod
    def at(byte_path: str, piece_path: str) -> Aligner:
        key = (byte_path, piece_path)
        if key not in _loaded:
            _loaded[key] = Aligner(*key)
        return _loaded[key]

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text in order, some at a time."""
        if not self.splits:
            yield [text]
            return
        low = 0
        while len(text) - low > PIECE:
            cut = _CUT.search(text, low + PIECE)
            if cut is None:
                break
            yield _CUT.split(text[low : cut.start()])
            low = cut.end()
        yield _CUT.split(text[low:] if low else text)

    def ends_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte ends) of A's tokens over a text that begins with the space."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans = np.array(found.ids, np.int64), _pairs(found.offsets)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        places = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
        # a token's cut is sure if the next token begins no earlier, with a character of its own
        sure = spans[:, 1] <= np.append(spans[1:, 0], len(points))
        return ids, _refined(places[spans[:, 1]], sure, self.sizes_a[ids])

    def ends_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same of B, which adds the space itself; its spans are bytes of the text without it."""
        found = self.b.encode(text[1:], return_type="offset_mapping", return_bytes=True)
        ids, spans = np.array(found["ids"], np.int64), _pairs(found["offsets"])
        return ids, _refined(spans[:, 1] + 1, ~self.byte[ids], self.sizes_b[ids])

    def align(self, chunks: list[str]) -> dict[str, np.ndarray | list]:
        """Of each chunk: whether it has tokens, its numbers of tokens, groups and links, the text of its groups; and the pairs of all links.

        Chunks are encoded as one text with single spaces between them; one at whose ends is white space goes alone.
        """
        plain = [i for i, c in enumerate(chunks) if not (c[0].isspace() or c[-1].isspace() or _SPACE in c)] if self.splits else []
        found: list = [None] * len(chunks)
        self._align_all(chunks, plain, found)
        for i in set(range(len(chunks))).difference(plain):
            self._align_all(chunks, [i], found)
        out: dict[str, np.ndarray | list] = {k: np.array([x[j] for x in found], np.int64) for j, k in enumerate(COUNTS)}
        out["good"], out["texts"] = out["n_a"] > 0, [x[4] for x in found]
        out["pairs"] = np.concatenate([x[5] for x in found]) if found else np.empty(0, np.int64)
        return out

    def _align_all(self, chunks: list[str], places: list[int], found: list) -> None:
        """Sets ``found`` of the chunks at ``places``; where joined bytes differ, the halves go on their own."""
        if not places:
            return
        spaced = " " + " ".join([chunks[i] for i in places])
        raw, (ids_a, ends_a), (ids_b, ends_b) = spaced.encode(), self.ends_a(spaced), self.ends_b(spaced)
        if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != raw:
            if len(places) == 1:
                found[places[0]] = (0, 0, 0, 0, b"", np.empty(0, np.int64))
            else:
                self._align_all(chunks, places[: len(places) // 2], found)
                self._align_all(chunks, places[len(places) // 2 :], found)
            return
        stops = np.cumsum([1 + len(chunks[i].encode()) for i in places])
        both = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        common, cuts = ends_b[both], np.sort(np.concatenate((ends_a, ends_b[~both])), kind="stable")
        pairs = ids_a[np.searchsorted(ends_a, cuts)] << 32 | ids_b[np.searchsorted(ends_b, cuts)]
        counts = [np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in (ends_a, ends_b, common, cuts)]
        # tokens by group, those of A before those of B; the mark after each tells what follows
        side = np.concatenate((2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((ids_a, ids_b))[order]
        step = np.append(side[1:], len(common) * 2) - side
        codes = np.where(step == 0, 0, np.where(side % 2 == 0, 1, 2)) * self.most + ids
        told = b"".join(self.told[codes].tolist())
        edges = np.concatenate(([0], np.cumsum(self.told_sizes[codes])))[np.concatenate(([0], np.cumsum(counts[0] + counts[1])))].tolist()
        links = np.concatenate(([0], np.cumsum(counts[3]))).tolist()
        for k, (i, *each) in enumerate(zip(places, *(c.tolist() for c in counts))):
            found[i] = (*each, told[edges[k] : edges[k + 1]], pairs[links[k] : links[k + 1]])


def _pairs(spans: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * len(spans)).reshape(-1, 2)


def _refined(coarse: np.ndarray, sure: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens: the coarse cuts where they are sure, and elsewhere the last sure cut before plus the bytes decoded since."""
    decoded = np.cumsum(sizes)
    off = np.where(sure, coarse - decoded, 0)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(sure)), -1))
    return decoded + np.where(last >= 0, off[last], 0)


class _Block:
    """Texts as numbers of chunks, until there are enough of them."""

    def __init__(self, name: int) -> None:
        self.name, self.numbers, self.ids, self.texts, self.bytes = name, _Numbers(), [], [], 0

    def add(self, doc_id, text: str | None, aligner: Aligner) -> None:
        found = [np.fromiter(map(self.numbers.__getitem__, some), np.uint32, len(some)) for some in aligner.chunks(text)] if text else []
        self.ids.append(doc_id)
        self.texts.append(np.concatenate(found) if found else np.empty(0, np.uint32))
        self.bytes += len(text or "")

    def full(self) -> bool:
        return len(self.numbers) >= BLOCK_CHUNKS or self.bytes >= BLOCK_BYTES

    def rows(self, aligner: Aligner, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The texts' rows, and one row of the block: links of each chunk as places in the block's pairs, and the pairs with their counts."""
        every = list(self.numbers)
        found = [aligner.align(every[i : i + BATCH]) for i in range(0, len(every), BATCH)]
        joined = {k: np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in ("good", "pairs", *COUNTS)}
        told = [t for x in found for t in x["texts"]]
        columns, digests, kept = {k: [] for k in COUNTS}, [], []
        for numbers in self.texts:
            fine = len(numbers) > 0 and bool(joined["good"][numbers].all())
            numbers = numbers if fine else numbers[:0]
            for k in COUNTS:
                columns[k].append(int(joined[k][numbers].sum()))
            digests.append(hashlib.sha256(b"".join(map(told.__getitem__, numbers.tolist()))[:-1]).hexdigest() if fine else "")
            kept.append(numbers)
        used = np.bincount(np.concatenate(kept), minlength=len(every)).astype(np.int64)
        n, none = len(self.ids), lambda t: pa.nulls(len(self.ids), t)
        head = [pa.array([self.name] * n, pa.int64()), pa.array([False] * n), pa.array(self.ids, kind)]
        body = [pa.array(columns[k], pa.int64()) for k in COUNTS]
        yield pa.RecordBatch.from_arrays([*head, *body, pa.array(digests), pa.array([x.tobytes() for x in kept], pa.binary()), none(pa.binary()), none(pa.list_(pa.int64())), none(pa.list_(pa.int64()))], FIELDS)
        pairs, place = np.unique(joined["pairs"], return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, place, np.repeat(used, joined["n_links"]))
        lone = [pa.array([x], t) for x, t in ((self.name, pa.int64()), (True, pa.bool_()), (None, kind), *((None, pa.int64()) for _ in COUNTS), (None, pa.string()))]
        csr = [joined["n_links"].astype(np.uint32).tobytes(), place.astype(np.uint32).tobytes()]
        yield pa.RecordBatch.from_arrays([*lone, *(pa.array([x], pa.binary()) for x in csr), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pairs, counts))], FIELDS)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
FIELDS = ["block", "whole", "doc_id", *COUNTS, "groups_sha256", "chunks", "links", "pairs", "counts"]


def _blocks(df: DataFrame, id_col: str, text_col: str, byte_path: str, piece_path: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"block long, whole boolean, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, chunks binary, links binary, pairs array<long>, counts array<long>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, base = Aligner.at(byte_path, piece_path), TaskContext.get().partitionId() << 32
        block = _Block(base)
        for b in batches:
            for part in pieces(b, 1, 1 << 22):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    block.add(doc_id, text, aligner)
                    if block.full():
                        yield from block.rows(aligner, b.schema.field(0).type)
                        block = _Block(block.name + 1)
        if block.ids:
            yield from block.rows(aligner, b.schema.field(0).type)

    ship(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(work), schema)


def _scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block with the sums over the totals of their links; ``right`` has a total for each pair of the block."""
    left = left.sort_by("whole")
    docs, block = left.slice(0, left.num_rows - 1), left.slice(left.num_rows - 1)
    order = np.argsort(right["place"].to_numpy())
    sizes, places = (np.frombuffer(block[c][0].as_py(), np.uint32).astype(np.int64) for c in ("chunks", "links"))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums = {}
    for name, column in (("n_best", "best"), ("count_sum", "total")):
        each = right[column].to_numpy()[order].astype(np.int64)
        by_chunk = np.zeros(len(sizes), np.int64)
        np.add.at(by_chunk, owner, each[places])
        sums[name] = pa.array([int(by_chunk[np.frombuffer(x.as_py(), np.uint32)].sum()) for x in docs["chunks"]], pa.int64())
    return docs.select(["doc_id", *COUNTS]).append_column("n_best", sums["n_best"]).append_column("count_sum", sums["count_sum"]).append_column("groups_sha256", docs["groups_sha256"])


def align(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes the text with a space before it, B adds that space itself; neither adds special tokens, whose names inside
    a text are plain text.  Null and empty texts have no tokens, nor have texts that either tokenizer does not give back
    byte for byte (those with U+2581): zeros and an empty digest, and no part in the totals.  ``n_best`` counts links
    whose pair is the most frequent one of its B id in the corpus, ties included; ``count_sum`` adds up the totals of
    the pairs of a text's links.  Repeated rows count each time; rows with a null id are kept; very long texts are read
    whole, but only their chunks and numbers are held; an empty table gives an empty result; other columns are not read.
    """
    table = written(_blocks(df, id_col, text_col, byte_path, piece_path))
    asked = table.where("whole").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("block", "place", "p.pairs", "p.counts")
    totals = written(asked.groupBy("pairs").agg(F.sum("counts").alias("total")).withColumn("b", F.col("pairs").bitwiseAND(0xFFFFFFFF)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    ranked = totals.join(most, "b").select("pairs", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    back = asked.select("block", "place", "pairs").join(ranked, "pairs").select(F.col("block").alias("of"), "place", "total", "best")
    rows = table.select("block", "whole", "doc_id", *COUNTS, "groups_sha256", "chunks", "links")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'n_best', 'count_sum'))}, groups_sha256 string"
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scored, schema)
