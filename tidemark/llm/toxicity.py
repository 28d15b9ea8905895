"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt, not given: in a bounded sample of labelled rows, words and word beginnings that toxic documents
hold far more often than others get their log-odds as weights.  The trees learn from features by lexicons that have not
seen the row's own fold; rows that the trees have not seen fit the calibration.  Features are densities of lexicon words, their nearness to
second-person words, capitals, punctuation and obfuscation rates.  Scoring is one pass over the texts with no shuffle;
the model (at most ``TERMS`` weights and a few trees) goes to the tasks as a broadcast variable.

Language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Trees, fit_isotonic, fit_trees, sigmoid
from tidemark.llm.common import bounded_sample, lean, written
from tidemark.shipping import ship

#: Labelled rows that fit the model, at most; those with the least hash of their id.
SAMPLE = 12_000
#: Lexicon entries, and terms looked at, at most.
TERMS, CANDIDATES = 4_000, 50_000
#: Least toxic documents of an entry, as a number and as a share of those there are, and its least log-odds.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 4, 0.01, 2.0
FOLDS = 4
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Words within which a second-person word counts as near.
NEAR = 5
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_RUN = re.compile(r"(.)\1\1")
#: Words whose facts a task keeps.
CACHE = 100_000
FEATURES = 24


def plain(word: str) -> str:
    """The letters of a word in lower case."""
    return _NOT_LETTERS.sub("", word.lower())


def terms(letters: str) -> list[str]:
    """The entries that a word may match: itself and its beginnings, marked."""
    return [letters, *(letters[:n] + "*" for n in BEGINNINGS if len(letters) >= n)]


class Codes(dict):
    """Packed facts of a word, worked out when first asked for: weight x 16 in the low 8 bits, then flags."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def weight(self, letters: str) -> int:
        return min(255, int(16 * max((self.lexicon.get(t, 0.0) for t in terms(letters)), default=0.0))) if len(letters) > 2 else 0

    def __missing__(self, word: str) -> int:
        letters = plain(word)
        weight, hidden = self.weight(letters), 0
        inner = word.strip(".,;:!?\"'()[]{}#*$%&|<>-")
        odd = any(not c.isalpha() for c in inner) and any(c.isalpha() for c in inner)
        if odd and not weight:
            weight = hidden = self.weight(plain(inner.lower().translate(_LEET)))
        code = weight | (letters in SECOND_PERSON) << 8 | odd << 9 | bool(hidden) << 10
        code |= (len(letters) > 2 and inner.isupper()) << 11 | bool(_RUN.search(letters)) << 12
        if len(self) < CACHE:
            self[word] = code
        return code


_DELETE = {name: bytes(chars) for name, chars in {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>@^~", "stop": b".,;:'\"()-"}.items()}


def features(text: str, codes: Codes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    code = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    weight = (code & 255) / 16.0
    hit = np.flatnonzero(weight)
    you = np.flatnonzero(code >> 8 & 1)
    near = 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(hit - you[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    w = np.sort(weight[hit])[::-1]
    data = text.encode("utf-8", "surrogatepass")
    size = len(data)
    rate = {k: (size - len(data.translate(None, d))) / size for k, d in _DELETE.items()}
    rates = [float((code >> b & 1).sum()) / n for b in (8, 9, 10, 11, 12)]
    return [
        float(np.log1p(n)), float(len(hit)), len(hit) / n, float(w.sum()), float(w.sum()) / n,
        float(w[0]) if len(w) else 0.0, float(w[1]) if len(w) > 1 else 0.0, float(w[2]) if len(w) > 2 else 0.0,
        float((w >= 3).sum()), float((w >= 4).sum()), float((w >= 4).sum()) / n, float(len({words[i] for i in hit.tolist()})),
        near / n, float(near), *rates, rate["upper"], rate["digit"] + rate["symbol"], rate["stop"],
        data.count(b"!") / n, data.count(b"?") / n,
    ]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: np.ndarray
    levels: np.ndarray
    #: Score where nothing could be learnt.
    share: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        z = self.trees.margin(x)
        # a little of the margin itself keeps the order within a level of the calibration
        return np.clip(0.98 * np.interp(z, self.knots, self.levels) + 0.02 * sigmoid(z), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _featured(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """(label, x, place, id) of labelled rows, each by the lexicon that has not seen its fold."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [Codes(x) for x in shared.value]
        for b in batches:
            x = [features(t.as_py() or "", codes[f]) for t, f in zip(b.column(2), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(3), b.column(4)], ["label", "x", "place", "id"])

    return rows.select("label", "fold", "text", "place", "id").mapInArrow(lean(work), f"label int, x array<double>, place long, id {kind}")


def _counted(rows: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, f0, f1 ...): documents of each fold that hold a term, summed in each batch before they move."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for b in batches:
            found: Counter = Counter()
            for fold, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = {t for w in {plain(w) for w in (text.as_py() or "").split()} if len(w) > 2 for t in terms(w)}
                found.update((t, fold) for t in own if keep is None or t in keep)
            names, folds = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(folds, pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "fold", "n"])

    counts = rows.select("fold", "text").mapInArrow(lean(work), "term string, fold int, n long")
    return counts.groupBy("term").agg(*(F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"f{i}") for i in range(FOLDS)))


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Log-odds of the words and beginnings that toxic documents favour: without each fold in turn, then from all folds."""
    sizes = np.zeros((2, FOLDS))
    for r in rows.groupBy("label", "fold").count().collect():
        sizes[r["label"], r["fold"]] = r["count"]
    if not sizes.sum(axis=1).all():
        return []
    least = max(LEAST_DOCS, LEAST_SHARE * sizes[1].sum())
    total = sum((F.col(f"f{i}") for i in range(FOLDS)), F.lit(0))
    often = _counted(rows.where("label = 1")).where(total >= least).orderBy(F.desc(total), "term").limit(CANDIDATES).collect()
    names = [r["term"] for r in often]
    other = {r["term"]: list(r)[1:] for r in _counted(rows.where("label = 0"), frozenset(names)).collect()}
    counts = np.array([[list(r)[1:], other.get(r["term"], [0] * FOLDS)] for r in often], float).reshape(-1, 2, FOLDS)
    out = []
    for fold in range(FOLDS + 1):
        use = np.arange(FOLDS) != fold
        toxic, rest = counts[:, 0, use].sum(axis=1), counts[:, 1, use].sum(axis=1)
        odds = np.log((toxic + 0.5) / (sizes[1, use].sum() + 1)) - np.log((rest + 0.5) / (sizes[0, use].sum() + 1))
        best = np.argsort(-odds * np.log1p(toxic), kind="stable")[:TERMS]
        out.append({names[i]: float(odds[i]) for i in best.tolist() if odds[i] >= LEAST_ODDS and toxic[i] >= least * use.sum() / FOLDS})
    return out


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits the model to at most ``sample`` labelled rows that are not held out.

    Without both labels the score is the share of label 1 among the rows (0 without rows).  The lexicon has at most
    ``TERMS`` entries, the best of ``CANDIDATES`` terms that toxic rows hold most often.  Null and empty texts count as
    texts without words; null ids and labels other than 0 and 1 are left out; an id with both labels counts as 1.
    """
    ship(df.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    chosen = known.select("id", "label", order.alias("place"))
    chosen = bounded_sample(chosen, "place", sample)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the sample has a fixed bound: of rows that repeat an id, the least text stands for it
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "place").agg(F.min("text").alias("text"))
    rows = written(found.withColumn("fold", F.pmod(F.shiftright("place", 7), F.lit(FOLDS)).cast("int")))
    lexicons = learn_lexicons(rows)
    # in the order of the hash, so that the fit does not depend on how rows lie in partitions
    fitted = sorted(_featured(rows, lexicons).collect(), key=lambda r: (r["place"], r["id"])) if lexicons else []
    lexicon = lexicons[-1] if lexicons else {}
    y, x = np.array([r["label"] for r in fitted], float), np.array([r["x"] for r in fitted], float).reshape(-1, FEATURES)
    last = np.arange(len(y)) % 10 >= 7
    if min((y[~last] == 1).sum(), (y[~last] == 0).sum(), (y[last] == 1).sum(), (y[last] == 0).sum()) == 0:
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        return Model(lexicon, None, np.empty(0), np.empty(0), float(share))
    trees = fit_trees(x[~last], y[~last])
    return Model(lexicon, trees, *fit_isotonic(trees.margin(x[last]), y[last]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null text counts as empty and gets the score of a text without words.  A null id is not held out.  Very long texts
    are scored whole.  Repeated rows score alike.  An empty table gives an empty result; other columns are not read.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(shared.value.lexicon)
        for b in batches:
            x = np.array([features(t.as_py() or "", codes) for t in b.column(2)], float).reshape(-1, FEATURES)
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(work), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with their own columns, in one pass and without a join.

    Null and empty texts are scored as texts without words, very long ones whole; repeated rows stay or go together; an empty table gives an
    empty result; no column is added, so none can clash.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(shared.value.lexicon)
        for b in batches:
            x = np.array([features(t.as_py() or "", codes) for t in b.column(place)], float).reshape(-1, FEATURES)
            yield b.filter(pa.array(shared.value.score(x) < THRESHOLD))

    return df.mapInArrow(lean(work), df.schema)
