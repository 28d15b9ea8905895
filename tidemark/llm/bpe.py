"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one database in each task.

A text is split by the tokenizer's pattern.  Each distinct piece is encoded once in a worker: its bytes become rows
(word, position, token), and a recursive query joins neighbouring rows with the merge table and contracts, in every
word, the leftmost pair of minimum rank until no pair is left.  All words advance in the same step.  Decoding joins
(text, position, id) rows with the vocabulary and aggregates the bytes in order of position.

In words from ``LONG`` bytes on, one step contracts every pair of the minimum rank from left to right, if the token that
this makes is no part of a merge of a lower rank: then no contraction makes a pair that would come first, and the step is
the same as one pair at a time.  Other ranks (found when the rank file is read) contract one pair in a step.

Memory does not grow with the table or with a word's steps: a recursive query takes few bytes and runs so many steps
that its rows stay below ``ROWS``, then goes on from where it stopped; what a worker keeps is bounded in bytes; a task
closes its database when it ends, and nothing is spilled to disk.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean
from tidemark.shipping import ship

#: Characters of text that are worked on at once, and bytes of words that one recursive query takes.
PIECE = 3 << 19
WORD_BYTES = 60_000
#: Ids that one query decodes.
IDS = 150_000
#: Rows of all steps of a recursive query.
ROWS = 3_000_000
#: Estimated bytes of the pieces whose ids a worker keeps, in two generations.
KEPT = 64 << 20
#: From so many bytes on, all pairs of the minimum rank are contracted in a single step.
LONG = 32

#: One contraction a step in each word.  A row knows the place and token that follow it, so a step is a few joins.
_LEFTMOST = """
    WITH ranked AS MATERIALIZED (
        SELECT s.*, m.rank FROM state s JOIN merges m ON m.pair = ((s.token::BIGINT << 32) | s.next_token)
    ), best AS MATERIALIZED (
        SELECT word, min((rank::BIGINT << 32) | place) AS best FROM ranked GROUP BY word
    ), hit AS MATERIALIZED (
        SELECT b.word, r.place AS hit, r.rank, e.place AS eaten, e.next_place AS after, e.next_token AS after_token
        FROM best b JOIN ranked r ON r.word = b.word AND r.place = (b.best & 4294967295)
        JOIN state e ON e.word = r.word AND e.place = r.next_place
    )
    SELECT step + 1, s.word, s.place, CASE WHEN place = hit THEN rank ELSE token END,
           CASE WHEN place = hit THEN after ELSE next_place END,
           CASE WHEN place = hit THEN after_token WHEN next_place = hit THEN rank ELSE next_token END
    FROM state s JOIN hit USING (word) WHERE place <> eaten
"""
#: All contractions of a word's least rank in one step, of a run of adjacent pairs the first, third, fifth ...; of a rank
#: that is part of a lower one, the first alone.
_RUNS = """
    SELECT step + 1, word, place, new_token, lead(place) OVER w, lead(new_token) OVER w
    FROM (SELECT *, CASE WHEN hit THEN least_rank ELSE token END AS new_token, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY place) AS eaten
          FROM (SELECT *, least AND CASE WHEN single THEN nth = 1 ELSE row_number() OVER (PARTITION BY word, least, run ORDER BY place) % 2 = 1 END AS hit
                FROM (SELECT *, row_number() OVER (PARTITION BY word, least ORDER BY place) AS nth,
                             row_number() OVER (PARTITION BY word ORDER BY place) - row_number() OVER (PARTITION BY word, least ORDER BY place) AS run
                      FROM (SELECT s.*, m.single, coalesce(m.rank = min(m.rank) OVER (PARTITION BY word), false) AS least, min(m.rank) OVER (PARTITION BY word) AS least_rank
                            FROM state s LEFT JOIN merges m ON m.pair = ((s.token::BIGINT << 32) | s.next_token))
                      WHERE least_rank IS NOT NULL)))
    WHERE NOT eaten WINDOW w AS (PARTITION BY word ORDER BY place)
"""
_ENCODE = """
    WITH RECURSIVE state(step, word, place, token, next_place, next_token) AS (
        SELECT 0, word, place, token, lead(place) OVER w, lead(token) OVER w FROM tokens_in WINDOW w AS (PARTITION BY word ORDER BY place)
        UNION ALL (SELECT * FROM ({step}) AS stepped(step, word, place, token, next_place, next_token) WHERE step <= {steps})
    ), steps AS MATERIALIZED (SELECT * FROM state), ends AS (SELECT word, max(step) AS step FROM steps GROUP BY word)
    SELECT word, list(token ORDER BY place) AS ids, max(step) AS last FROM steps JOIN ends USING (word, step) GROUP BY word ORDER BY word
"""
_DECODE = "SELECT text, string_agg(hex, '' ORDER BY place) AS hex FROM ids_in JOIN vocabulary USING (id) GROUP BY text"


class Codec:
    """Encoder and decoder of one rank file.  Use it within ``with``: its database is open only there."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        #: Whether texts may be cut before spaces and plain words need no search: known of this pattern only.
        self.plain = pattern == public_tokenizers.PATTERN
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}
        self.held = 0
        of = self.ranks.get
        pairs = np.array([(l, r, k) for b, k in self.ranks.items() for i in range(1, len(b)) if (l := of(b[:i])) is not None and (r := of(b[i:])) is not None], np.int64).reshape(-1, 3)
        later = pairs[:, :2].max(axis=1)
        single = np.isin(pairs[:, 2], later[later >= pairs[:, 2]])
        self.merges = pa.table({"pair": pairs[:, 0] << 32 | pairs[:, 1], "rank": pairs[:, 2].astype(np.int32), "single": single})
        self.vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": pa.array([b.hex() for b in self.ranks])})
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def __enter__(self) -> Codec:
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for name in ("merges", "vocabulary"):
            self.db.register("loading", getattr(self, name))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
            self.db.unregister("loading")
        return self

    def __exit__(self, *_: object) -> None:
        self.db.close()
        del self.db

    def _contract(self, words: list[bytes], step: str) -> list[bytes]:
        """The ids of words as little-endian unsigned 32-bit integers, from rounds of at most ``ROWS`` rows."""
        out, left = [b""] * len(words), np.arange(len(words))
        lengths, tokens = np.array([len(w) for w in words]), self.byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(left):
            steps = max(2, ROWS // len(tokens))
            rows = {"word": np.repeat(np.arange(len(left), dtype=np.int32), lengths), "place": np.arange(len(tokens), dtype=np.int32), "token": tokens}
            self.db.register("tokens_in", pa.table(rows))
            found = self.db.sql(_ENCODE.format(step=step, steps=steps)).to_arrow_table()
            self.db.unregister("tokens_in")
            ids, goes_on = found.column("ids").combine_chunks(), found.column("last").to_numpy() == steps
            ends, tokens = ids.offsets.to_numpy(), ids.values.to_numpy()
            flat = tokens.astype("<u4").tobytes()
            for k, a, b, on in zip(left.tolist(), ends[:-1].tolist(), ends[1:].tolist(), goes_on.tolist()):
                if not on:
                    out[k] = flat[4 * a : 4 * b]
            lengths = np.diff(ends)
            tokens, lengths, left = tokens[np.repeat(goes_on, lengths)], lengths[goes_on], left[goes_on]
        return out

    def pieces(self, part: str) -> list[str]:
        """The pattern's matches in a part of a text; an empty part has none."""
        if self.plain:
            # letters, with or without a space before them and one stop after them, need no search
            word = part[1:] if part[:1] == " " else part
            if word.isalpha():
                return [part]
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return [part[:-1], part[-1]]
        return self.pattern.findall(part)

    def _keep(self, piece: str, ids: bytes) -> None:
        self.known[piece] = ids
        self.held += 180 + len(piece) + len(ids)

    def learn(self, pieces: set[str]) -> None:
        """Ids of all pieces into ``known``.  When half of what may be kept is full it ages, and what is not asked for again goes."""
        if self.held > KEPT // 2:
            self.aged, self.known, self.held = self.known, {}, 0
        todo = []
        for piece in pieces:
            if piece in self.known:
                continue
            if (ids := self.aged.get(piece)) is not None:
                self._keep(piece, ids)
            elif (rank := self.ranks.get(b := piece.encode())) is not None:
                self._keep(piece, rank.to_bytes(4, "little"))
            else:
                todo.append((piece, b))
        for step, some in ((_LEFTMOST, [x for x in todo if len(x[1]) < LONG]), (_RUNS, [x for x in todo if len(x[1]) >= LONG])):
            first, size = 0, 0
            for i, (_, b) in enumerate(some, 1):
                size += len(b)
                if size >= WORD_BYTES or i == len(some):
                    for (piece, _), ids in zip(some[first:i], self._contract([b for _, b in some[first:i]], step)):
                        self._keep(piece, ids)
                    first, size = i, 0

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = chunks if self.plain else self.pattern.findall
        parts: set[str] = set()
        for t in texts:
            parts.update(cut(t))
        # a part that is a piece itself is looked up as such, others for this call only
        parts.discard("")
        split = {p: found for p in parts if (found := self.pieces(p)) != [p]} if self.plain else {}
        self.learn({p for found in split.values() for p in found} | (parts - split.keys()))
        compounds = {p: b"".join([self.known[x] for x in found]) for p, found in split.items()}
        ids = {p: compounds[p] if p in split else self.known[p] for p in parts} | {"": b""}
        for t in texts:
            yield b"".join(map(ids.__getitem__, cut(t)))

    def decode(self, ids: list[bytes]) -> Iterator[bytes]:
        """The bytes of each list of ids, from queries of about ``IDS`` ids."""
        first, size = 0, 0
        for i, x in enumerate(ids, 1):
            size += len(x) // 4
            if size >= IDS or i == len(ids):
                yield from self._join(ids[first:i])
                first, size = i, 0

    def _join(self, ids: list[bytes]) -> list[bytes]:
        lengths = [len(x) // 4 for x in ids]
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        self.db.register("ids_in", pa.table({"text": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "place": np.arange(len(flat), dtype=np.int32), "id": flat}))
        out = [b""] * len(ids)
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids_in")
        for i, h in zip(found.column(0).to_pylist(), found.column(1)):
            out[i] = bytes.fromhex(h.as_py())
        return out


_UNEVEN = re.compile(r" (?=\s|\Z)")


def chunks(text: str) -> list[str]:
    """Cuts a text before each space that something other than white space follows.

    The pattern never matches across such a place: a space there always starts a match, and white space before it ends
    one.  The parts repeat far more often than texts do.
    """
    parts = text.split(" ")
    if not _UNEVEN.search(text):
        return [p if i == 0 else " " + p for i, p in enumerate(parts)] if text else []
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return [c for c in out if c]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows with about ``PIECE`` characters."""
    texts, first, held = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= PIECE:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


def _apply(df: DataFrame, path: str, pattern: str, kinds: str, work: Callable[[Codec, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in batches:
                yield from work(own, batch)

    return df.mapInArrow(lean(run), kinds)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` (array<int>) in place of its text.

    Null and empty texts have no ids.  A column of ``df`` that is named ``ids_col`` gives way to the new one.  Very long
    texts go through in pieces; repeated rows are kept; an empty table gives an empty result.
    """
    rest = [c for c in df.columns if c not in (text_col, ids_col)]

    def work(own: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in _texts(batch, len(rest)):
            ids = list(own.encode(texts))
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, flat)], [*rest, ids_col])

    return _apply(df.select(*(F.col(_quoted(c)) for c in (*rest, text_col))), path, pattern, f"{_kinds(df, rest)}`{ids_col}` array<int>", work)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``df`` with the decoded bytes (``bytes_col``) in place of its ids.

    Null has no bytes.  A column of ``df`` that is named ``bytes_col`` gives way to the new one.  Repeated rows are kept;
    an empty table gives an empty result.
    """
    rest = [c for c in df.columns if c not in (ids_col, bytes_col)]

    def work(own: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids = [np.array(x.as_py() or [], "<u4").tobytes() for x in part.columns[-1]]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(own.decode(ids)), pa.binary())], [*rest, bytes_col])

    return _apply(df.select(*(F.col(_quoted(c)) for c in (*rest, ids_col))), path, pattern, f"{_kinds(df, rest)}`{bytes_col}` binary", work)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no ids, no bytes.  A null id stays null.  Very long texts and words go through in bounded
    memory.  Repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
    """

    def work(own: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in _texts(batch, 1):
            ids = list(own.encode(texts))
            columns = [
                batch.column(0).slice(first, len(texts)),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return _apply(rows, path, pattern, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
