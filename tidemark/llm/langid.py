"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (1 to 3 letters) that both hold,
over the geometric mean of the numbers that each holds: a blended-spectrum presence kernel.
N-grams are hashed to a fixed number of places. A bounded sample of labelled texts gives the
landmarks of a Nyström map (eigenvectors of the landmarks' own kernel); kernel ridge regression
is fitted on the mapped sample, one language versus the rest. Scoring multiplies a batch's
presence rows with the landmarks' and the result with the weights. Python runs in tasks, on the
text column only; whole texts count, in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 1 << 13
LONGEST_GRAM = 3
LANDMARKS = 256
SAMPLE = 3000  # labelled texts that the model is fitted on, at most
RIDGE = 1e-3
SHARPNESS = 6.0
CHUNK = 1 << 20  # characters looked at together
BATCH = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(0x110000, dtype=bool)
_LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


def presence(text: str | None) -> np.ndarray | None:
    """Which n-grams the whole text holds; None if it has no letter."""
    if not text:
        return None
    held = np.zeros(PLACES, dtype=bool)
    letters = False
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - LONGEST_GRAM + 1) : at + CHUNK]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = _LETTER[code]
        letters = letters or bool(is_letter.any())
        code = np.where(is_letter, code, 32).astype(np.uint64)
        gram = np.zeros(len(code), dtype=np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            gram = (gram[: len(code) - n + 1] * np.uint64(1 << 21) + code[n - 1 :]) if len(code) >= n else gram[:0]
            held[((gram + np.uint64(n)) * _MIX) >> np.uint64(64 - 13)] = True
    return held if letters else None


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # packed presence bits, a row for each
    weights: np.ndarray  # landmarks by languages
    bias: np.ndarray

    def kernel(self, held: np.ndarray) -> np.ndarray:
        """Kernel of presence rows with the landmarks, as one matrix product."""
        marks = np.unpackbits(self.landmarks, axis=1, count=PLACES).astype(np.float32)
        return (held @ marks.T) / np.sqrt(np.outer(np.maximum(held.sum(1), 1), np.maximum(marks.sum(1), 1)))

    def scores(self, held: np.ndarray) -> np.ndarray:
        margin = self.kernel(held.astype(np.float32)) @ self.weights + self.bias
        e = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        return e / e.sum(axis=1, keepdims=True)


def _packed(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in texts:
        rows = [(lang, np.packbits(p).tobytes()) for lang, p in ((a, presence(t)) for a, t in zip(pdf["label"], pdf["text"], strict=True)) if p is not None]
        yield pd.DataFrame(rows, columns=["label", "bits"])


def sampled(labelled: DataFrame, most: int) -> DataFrame:
    """(label, text): about ``most / labels`` distinct texts of each label, drawn by hash."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return labelled.select("label", "text").limit(0)
    each = max(2, most // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * each / n))])
    draw = F.xxhash64("text", F.lit(7))
    few = labelled.withColumn("draw", draw).where(F.col("draw") / 2.0**64 + 0.5 < share[F.col("label")])
    few = few.groupBy("label", "draw").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw"))  # of about 3 * each rows
    return few.withColumn("rank", rank).where(F.col("rank") <= each).select("label", "text")


def fit(labelled: DataFrame, most: int = SAMPLE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on (label, text); rows with a null label or a text without letters are left out.

    ``most`` bounds the sampled texts; the driver holds their presence bits (1 kB each) only.
    """
    rows = sampled(labelled.where("label IS NOT NULL AND text IS NOT NULL"), most).mapInPandas(_packed, "label string, bits binary").toPandas()
    rows = rows.sort_values(["bits", "label"]).reset_index(drop=True)
    languages = sorted(rows["label"].unique())
    if not languages:
        return LanguageModel([], np.zeros((0, PLACES // 8), np.uint8), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint8).reshape(len(rows), -1)
    target = np.array([[1.0 if a == b else -1.0 for b in languages] for a in rows["label"]])
    # Landmarks: as many of each language, spread over the sample's (hash) order.
    turn = rows.groupby("label").cumcount().to_numpy()
    marks = bits[np.lexsort((rows["label"], turn))[:landmarks]]
    model = LanguageModel(languages, marks, np.zeros(0), np.zeros(0))
    # Block by block: the presence rows of the whole sample would take 120 MB of the driver.
    cross = np.vstack([model.kernel(np.unpackbits(bits[i : i + BATCH], axis=1, count=PLACES).astype(np.float32)) for i in range(0, len(bits), BATCH)]).astype(np.float64)
    own = model.kernel(np.unpackbits(marks, axis=1, count=PLACES).astype(np.float32)).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6 * value.max()
    lift = vector[:, keep] / np.sqrt(value[keep])
    z = np.hstack([cross @ lift, np.ones((len(cross), 1))])
    # Languages weigh alike, whatever their share of the sample.
    weight = np.array([1.0 / (rows["label"] == a).sum() for a in rows["label"]])[:, None] * len(rows) / len(languages)
    solved = np.linalg.solve(z.T @ (weight * z) + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ (weight * target))
    return LanguageModel(languages, marks, (lift @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def predicted(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of each whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every text if nothing
    was learned. Equal texts get equal predictions; of equal scores the first language wins.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            for i in range(0, len(texts), BATCH):
                held = [presence(t) for t in texts.iloc[i : i + BATCH]]
                known = [k for k, h in enumerate(held) if h is not None]
                if known and model.languages:
                    p = model.scores(np.array([held[k] for k in known]))
                    best = p.argmax(axis=1)
                    names[[i + k for k in known]] = np.array(model.languages, dtype=object)[best]
                    score[[i + k for k in known]] = p[np.arange(len(best)), best]
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return F.pandas_udf("lang_pred string, score double")(run)(text)
