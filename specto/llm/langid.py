"""Language identification by string kernels.

Two texts are as similar as the share of character n-grams (orders 1 to 3, the blended spectrum) that occur in both;
how often one occurs does not matter. A few labelled texts serve as Nystroem landmarks: a text is described by its
kernel with each landmark, and one-versus-rest ridge regression in that space gives a value per language. Scoring a
batch is two matrix products: presence by landmark n-grams, then kernels by coefficients.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, narrow

SYMBOLS = 64
CODES = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


@cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 if no letter, a-z 1 to 26, other letters 27 to 63 by their number."""
    # letters beyond a-z of different scripts share symbols; runs of them still differ
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(len(out)):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + c % 37
    return out


class Grams:
    def __init__(self) -> None:
        self.table = symbol_table()
        self.seen = np.zeros(CODES, bool)

    def presence(self, text: str) -> np.ndarray | None:
        """Marks of the n-grams that occur (the array is used again by the next call); None if no letter occurs."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = self.table[points]
        s = np.concatenate((np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)))
        s = s[np.append(True, (s[1:] | s[:-1]) != 0)].astype(np.int32)  # one mark for a run of other characters
        if len(s) < 2:
            return None
        self.seen[:] = False
        pairs = s[:-1] * SYMBOLS + s[1:]
        self.seen[s] = True
        self.seen[SYMBOLS + pairs] = True
        self.seen[SYMBOLS + SYMBOLS**2 + pairs[:-1] * SYMBOLS + s[2:]] = True
        return self.seen


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # n-grams of the landmarks
    marks: np.ndarray  # n-gram by landmark, divided by the root of the landmark's size
    weights: np.ndarray  # landmark by language


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> list[tuple[str, np.ndarray]]:
    """At most `rows` different labelled texts, as many of each language, those with the smallest hash; as n-gram codes. `und` is no label."""
    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    train = own.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != "und") & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2))
    # counts by ranges of hashes tell which ranges hold the smallest ones of a language, and only those are ranked
    keys = cut(train.select("lang", "h").distinct()).withColumn("range", F.shiftright("h", 52))
    counts = cut(keys.groupBy("lang", "range").count())
    each = max(8, rows // max(1, counts.select("lang").distinct().count()))
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("range")) - F.col("count")
    low = keys.join(F.broadcast(counts.withColumn("before", before).where(F.col("before") < each).select("lang", "range")), ["lang", "range"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = low.withColumn("n", order).where(F.col("n") <= each).select("lang", "h")
    texts = train.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def make():
        grams = Grams()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes = [np.flatnonzero(seen).astype("<i4").tobytes() if (seen := grams.presence(t)) is not None else b"" for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_pydict({"lang": batch.column(0).cast(pa.string()), "codes": pa.array(codes, pa.binary())})

        return work

    found = map_batches(texts.orderBy("lang", "h").select("lang", "text"), make, "lang string, codes binary").collect()
    return [(r["lang"], np.frombuffer(bytes(r["codes"]), "<i4").astype(np.int64)) for r in found if r["codes"]]


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = 128, ridge: float = 1e-3) -> Model | None:
    """Nystroem features of the sample and a ridge regression on them for each language against the rest."""
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    by_lang = [[codes for own, codes in rows if own == lang] for lang in langs]
    each = max(1, landmarks // len(langs))
    marked = [codes for own in by_lang for codes in own[:each]]
    grams = np.unique(np.concatenate(marked))
    marks = np.zeros((len(grams), len(marked)), np.float64)
    for j, codes in enumerate(marked):
        marks[np.searchsorted(grams, codes), j] = 1 / np.sqrt(len(codes))
    at = np.full(CODES, -1)
    at[grams] = np.arange(len(grams))

    def kernel(codes: np.ndarray) -> np.ndarray:
        own = at[codes]
        return marks[own[own >= 0]].sum(0) / np.sqrt(len(codes))

    k = np.array([kernel(codes) for _, codes in rows])
    values, vectors = np.linalg.eigh(np.array([kernel(codes) for codes in marked]))
    good = values > values.max() * 1e-7
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k @ root
    y = np.array([[1.0 if own == lang else -1.0 for lang in langs] for own, _ in rows])
    beta = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(langs, grams, marks.astype(np.float32), (root @ beta).astype(np.float32))


class Scorer:
    def __init__(self, model: Model | None, batch: int = 256) -> None:
        self.model, self.batch, self.grams = model, batch, Grams()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if self.model is None:
            return langs, scores
        x = np.empty((self.batch, len(self.model.grams)), np.float32)
        for start in range(0, len(texts), self.batch):
            rows, sizes = [], []
            for i in range(start, min(len(texts), start + self.batch)):
                if texts[i] and (seen := self.grams.presence(texts[i])) is not None:
                    x[len(rows)] = seen[self.model.grams]
                    rows.append(i)
                    sizes.append(np.count_nonzero(seen))
            if rows:
                kernels = (x[: len(rows)] @ self.model.marks) / np.sqrt(np.array(sizes, np.float32))[:, None]
                values = kernels @ self.model.weights
                for i, best, v in zip(rows, values.argmax(1), np.clip((values.max(1) + 1) / 2, 0, 1), strict=True):
                    langs[i], scores[i] = self.model.langs[best], round(float(v), 4)
        return langs, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 1200, landmarks: int = 128) -> Model | None:
    """Fits on at most `sample_rows` labelled documents (at least 8 of each language) outside the held-out fold."""
    return fit(sample(docs, id_col, text_col, lang_col, sample_rows), landmarks)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row from its whole text; no shuffle.

    A text that is null or has no letter gets `und` and 0, as does every text if nothing is labelled. A null id is not
    held out. Repeated rows give repeated rows, an empty table none. The model (a few MB, bounded by the landmarks and
    the number of codes) travels with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = Scorer(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = score(batch.column(2).to_pylist())
            return pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "held_out": batch.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

        return work

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return map_batches(narrow(docs, id_col, text_col).select("doc_id", held.alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.2) -> DataFrame:
    """The rows whose text is in some language, with all their columns; `lang_col` becomes the predicted language.

    Rejected are texts without a letter, null ones too, and those that no learned language claims with `min_score`. If
    nothing is labelled, all texts with a letter stay as they are. Repeated rows share a fate, a text of any length is
    read whole, an empty table gives no rows, and other columns may have any names.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    lang_at = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def make():
        score = Scorer(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            if score.model is None:
                return batch.filter(pa.array([bool(t) and score.grams.presence(t) is not None for t in texts], pa.bool_()))
            langs, scores = score(texts)
            if lang_at is not None:
                field = batch.schema.field(lang_at)
                batch = batch.set_column(lang_at, field, pa.array(langs, field.type))
            return batch.filter(pa.array([lang != "und" and s >= min_score for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

        return work

    return map_batches(docs, make, docs.schema)
