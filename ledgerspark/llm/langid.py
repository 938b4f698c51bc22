"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a linear classifier on hashed letter n-grams is trained in numpy to tell
the languages whose bit is set from the others. A text gets the language whose codeword is nearest to the outputs,
nearness being the logistic loss summed over the bits, each bit weighted by how well it did on that language in
training. A text whose two nearest codewords are almost equally near is flagged as ambiguous.

Up to ``EXHAUSTIVE`` languages the code has every split of the languages in two parts; beyond that, bits are drawn
from a fixed hash, and more of them the more languages there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import plain_names

BUCKETS = 1 << 12
TRAINING_DOCS = 400  # of each language at most: a bounded sample, as large as that whatever the corpus
EXHAUSTIVE = 6
ROUNDS = 150
AMBIGUOUS = 0.1
UNKNOWN = "und"
PIECE = 1 << 20

_ascii_letter = re.compile("[A-Za-z]").search
#: letters and bytes of letters beyond ASCII; everything else is a border
_LETTERS = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)
_MIX = (np.uint32(2654435761), np.uint32(40503 * 65537 % 2**32 | 1), np.uint32(2246822519), np.uint32(3266489917))


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ascii_letter(text)) or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed 1- to 4-grams of the whole lower-cased text, unit length."""
    counts = np.zeros(BUCKETS)
    data = f" {text} ".lower().encode("utf-8", "replace")
    for at in range(0, len(data), PIECE):  # pieces overlap by the length of an n-gram, so none is lost
        codes = _LETTERS[np.frombuffer(data, np.uint8, min(PIECE + 3, len(data) - at), at)]
        border = codes == 32
        codes = codes[~(border & np.r_[False, border[:-1]])]
        gram = np.zeros(len(codes), np.uint32)
        for n in range(4):
            if len(codes) <= n:
                break
            gram = (gram[: len(codes) - n] + codes[n:] + np.uint32(n + 1)) * _MIX[n]
            counts += np.bincount(gram >> np.uint32(20), minlength=BUCKETS)
    shares = np.sqrt(counts)
    return (shares / max(np.linalg.norm(shares), 1e-9)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits
    doubtful: float = 0.0  # below it, and ambiguous, a text is in none of the languages

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (0 to 1) and whether the two nearest codewords are about equally near."""
        if len(self.languages) == 1:
            return [self.languages[0]] * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        margins = self.outputs(x)[:, None, :] * self.code[None]
        distance = (np.logaddexp(0, -margins) * self.trust[None]).sum(2)
        near = np.exp(distance.min(1, keepdims=True) - distance)
        near /= near.sum(1, keepdims=True)
        best = distance.argmin(1)
        ordered = np.sort(near, axis=1)
        return [self.languages[i] for i in best], near[np.arange(len(x)), best], ordered[:, -1] - ordered[:, -2] < AMBIGUOUS


def codewords(languages: list[str]) -> np.ndarray:
    """Distinct rows of +1 and -1, one per language."""
    n = len(languages)
    if n <= EXHAUSTIVE:
        columns = [[1 if i == 0 or not (split >> (i - 1)) & 1 else -1 for i in range(n)] for split in range(1, 2 ** (n - 1))]
        return np.array(columns, float).T.reshape(n, -1)
    bits = 8 * int(np.ceil(np.log2(n)))
    raw = [np.frombuffer(b"".join(hashlib.sha256(f"{x}:{k}".encode()).digest() for k in range(bits // 256 + 1)), np.uint8) for x in languages]
    return np.array([np.unpackbits(r)[:bits] for r in raw]) * 2.0 - 1


def fit(x: np.ndarray, languages: np.ndarray) -> Model:
    """Train all bits at once by gradient steps with adaptive step size; classes weigh alike."""
    names = sorted(set(languages))
    code = codewords(names)
    which = np.array([names.index(y) for y in languages])
    target = code[which].astype(np.float32)
    share = (1 / np.bincount(which, minlength=len(names)))[which][:, None] / len(names)
    share = share.astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        slope = -target * share / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        grad = x.T @ slope + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * slope.sum(0)
    right = (target * (x @ w + b) > 0).astype(float)
    hits = np.array([right[which == i].mean(0) for i in range(len(names))])
    trust = hits / hits.sum(1, keepdims=True) * code.shape[1] if code.shape[1] else hits
    model = Model(names, code, w.astype(np.float32), b.astype(np.float32), trust)
    if len(names) > 1:
        # half way between chance and the least sure of the labelled texts that are told rightly; a text in two of the
        # languages, which has a score of one half, stays in any case
        told, scores, _ = model.predict(x)
        fine = scores[np.array(told) == np.asarray(languages)]
        model.doubtful = float((1 / len(names) + fine.min(initial=0.5)) / 2)
    return model


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, per_language: int = TRAINING_DOCS) -> Model | None:
    """Fit on at most ``per_language`` documents of each language, those with the smallest hash of their id.

    The languages and their numbers of documents come from the whole table, the sample is filtered where it is read.
    None if no document has a language and a letter.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 40))
    below = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, int(min(1.0, 1.5 * per_language / n) * (1 << 40)))])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            yield pd.DataFrame({"place": batch["place"], "lang": batch["lang"], "vector": [features(t).astype(np.float16).tobytes() for t in batch["text"]]})

    drawn = labelled.select(place.alias("place"), "lang", "text").filter(F.col("place") < below[F.col("lang")])
    sample = (
        drawn.mapInPandas(vectors, "place long, lang string, vector binary")
        .orderBy("place", "lang", "vector").limit(2 * per_language * len(sizes)).toPandas()
    )
    sample = sample.groupby("lang").head(per_language)
    if sample.empty:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in sample["vector"]]).astype(np.float32)
    return fit(x, sample["lang"].to_numpy())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred``, ``score`` and ``ambiguous``; columns of these names are replaced.

    Texts that are null or without a letter are ``und`` with score 0, as is every text if there is no model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def tell(texts: pd.Series) -> pd.DataFrame:
        fitted = shared.value
        known = np.array([fitted is not None and has_letter(t) for t in texts], bool)
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "ambiguous": False})
        where = np.flatnonzero(known)
        for at in range(0, len(where), 512):
            rows = where[at : at + 512]
            x = np.stack([features(texts.iloc[i]) for i in rows])
            names, scores, unsure = fitted.predict(x)
            out.loc[rows, "lang_pred"], out.loc[rows, "score"], out.loc[rows, "ambiguous"] = names, scores.astype(float), unsure
        return out

    kept = docs.drop("lang_pred", "score", "ambiguous")
    return kept.withColumn("_told", tell(F.col(text_col))).select(*kept.columns, "_told.*")


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous; learned from the documents not held out."""
    model = train(docs.filter(~is_held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those that are in no language; nothing else changes, whatever the columns are called.

    A text goes if it is ``und`` (null, or no letter), or if its nearest codewords are about equally near and even the nearest has a score
    below ``Model.doubtful``: it is told neither as one language nor as a mixture of two. If no label allows to fit a model, those without any letter go.
    """
    model = train(docs.filter(~is_held_out()))
    if model is None:
        lettered = F.pandas_udf(lambda texts: texts.map(has_letter).astype(bool), "boolean")
        return docs.filter(lettered(F.col("text")))
    plain, names = plain_names(docs, "text")
    told = identify(plain, model)
    unsure = F.col("ambiguous") & (F.col("score") < model.doubtful)
    return told.filter((F.col("lang_pred") != UNKNOWN) & ~unsure).select(*names).toDF(*docs.columns)
