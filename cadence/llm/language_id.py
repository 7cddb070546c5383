"""Language identification by string kernels on n-gram presence.

Two texts are as alike as the share of n-grams, of one to four letters, that both contain:
k(x, z) = |x and z| / sqrt(|x| |z|).  A sample of labelled texts serves as landmarks (Nystrom
approximation), and kernel ridge regression separates each language from the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.encoding import forget_words

ORDERS = 4
SLOTS = 1 << 17
"""N-grams are hashed to so many places."""
TRAINING_ROWS = 2000
"""Labelled texts learned from, an equal number per language."""
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 4.0
"""Scores are the softmax of this times the regressions' values."""
UNKNOWN = "und"
LANGUAGES = 500
"""Languages learned at most, those with the most labelled texts."""
EVIDENCE, CLAIMED, MISSED = 40, 0.05, 0.001
"""A text with fewer distinct n-grams is too short to be called foreign.  Others are, if no
regression's value reaches a bound: what all but ``MISSED`` of the labelled texts reach when the
regression has not seen them, and ``CLAIMED`` at most (a text of the language has 1, others -1)."""
PREDICTED = "struct<lang_pred:string,score:double,known:boolean>"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Distinct hashed n-grams of a text's words, each word between blanks."""

    def __init__(self) -> None:
        self.letters = letter_table()
        self.last = np.zeros(SLOTS, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Places of the n-grams present; none for a text without letters."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.letters[points]
        if not letter.any():
            return np.empty(0, np.int64)
        symbols = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.uint32)
        blank = symbols == 32
        symbols = symbols[~(blank & np.concatenate([[False], blank[:-1]]))]
        places, grams = [], np.zeros(len(symbols), np.uint32)
        for order in range(1, ORDERS + 1):
            if len(symbols) < order:
                break
            grams = grams[:len(symbols) - order + 1] * np.uint32(0x01000193)
            grams ^= symbols[order - 1:] + np.uint32(order)
            mixed = grams * np.uint32(0x9E3779B1)
            places.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(SLOTS - 1))
        found = np.concatenate(places).astype(np.int64)
        order = np.arange(len(found))
        self.last[found] = order  # the last of equal ones stays
        return found[self.last[found] == order]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    """One row per place of an n-gram, one column per language."""
    least: float = CLAIMED
    """Where no value reaches this, the text is in none of the languages."""

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Values of the regressions, one row per text with n-grams."""
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(self.weights[np.concatenate(texts)], starts, axis=0)
        return sums / np.sqrt(sizes)[:, None]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS) -> LanguageModel:
    """Ridge regression of each language against the rest on the landmarks' features.

    With Z the landmarks' presence rows, each divided by the root of its n-grams, K their
    kernel and X a batch of texts alike, the features are X Z' K^(-1/2) and a score is their
    product with the regression's weights.  Z' K^(-1/2) W is multiplied out once, so scoring
    a batch is one product of its presence matrix with a matrix of places by languages.
    """
    grams = Grams()
    found = [(grams(t), label) for t, label in zip(texts, labels)]
    found = [(g, label) for g, label in found if len(g)]
    languages = sorted({label for _, label in found})
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    by_language = {name: [g for g, label in found if label == name] for name in languages}
    each = -(-landmarks // len(languages))
    chosen = [g for name in languages for g in by_language[name][:each]]
    z = np.zeros((SLOTS, len(chosen)), np.float32)  # a row per place, so that texts pick rows
    for k, g in enumerate(chosen):
        z[g, k] = 1 / np.sqrt(len(g))

    def kernel(rows: list[np.ndarray]) -> np.ndarray:
        return np.stack([z[g].sum(axis=0, dtype=np.float64) / np.sqrt(len(g)) for g in rows])

    values, vectors = np.linalg.eigh(kernel(chosen))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel([g for g, _ in found]) @ root
    target = np.array([[1.0 if label == n else -1.0 for n in languages] for _, label in found])
    gram = features.T @ features + RIDGE * len(found) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ target)
    # values of each text by the regression without it, from its share in its own value
    own = np.einsum("ij,ji->i", features, np.linalg.solve(gram, features.T))[:, None]
    unseen = (features @ solved - own * target) / np.maximum(1 - own, 1e-9)
    enough = np.array([len(g) >= EVIDENCE for g, _ in found])
    least = CLAIMED
    if enough.any():
        least = min(CLAIMED, float(np.quantile(unseen[enough].max(axis=1), MISSED)))
    return LanguageModel(languages, (z @ (root @ solved).astype(np.float32)).astype(np.float32), least)


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = TRAINING_ROWS,
) -> LanguageModel:
    """Fit on at most ``rows`` labelled texts, as many of each language.

    Which rows are taken follows a hash of id and text, so it does not depend on their order;
    rows without a label, a text or a letter are left out, and rows that repeat an id and text
    count once.  One pass counts labels, a second fetches a slice of the hash with some twice the
    rows wanted of each language, of which the first are taken.  The driver holds that sample,
    at most ``LANGUAGES`` counts and the model.
    """
    rated = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("rank"),
    )
    counts = {
        r["lang"]: r["count"]
        for r in rated.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    }
    if not counts:
        return fit([], [])
    share = max(1, rows // len(counts))
    bounds = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (
        lang, min(-(1 << 63) + int((1 << 64) * min(1.0, 2 * share / n)), (1 << 63) - 1))))
    found = rated.where((F.col("rank") <= F.element_at(bounds, F.col("lang"))) & F.col("text").rlike(r"\p{L}"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))
    sample = found.dropDuplicates(["lang", "rank"]).withColumn("at", first).where(F.col("at") <= share)
    taken = sorted((r["lang"], r["at"], r["text"]) for r in sample.select("lang", "at", "text").collect())
    return fit([text for _, _, text in taken], [lang for lang, _, _ in taken])


def language(spark, model: LanguageModel, text: Column) -> Column:
    """A struct ``lang_pred, score, known`` for a text column.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    ``known`` is false where there is no letter, and where a text with evidence enough is claimed
    by none of the languages; if nothing was learned, letters are enough.
    """
    sent = spark.sparkContext.broadcast((model.languages, model.weights, model.least))

    @F.arrow_udf(PREDICTED)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_words()
        names, weights, least = sent.value
        model, grams = LanguageModel(names, weights, least), Grams()
        for batch in batches:
            out = [{"lang_pred": UNKNOWN, "score": 0.0, "known": False}] * len(batch)
            for at in range(0, len(batch), 256):
                found = [grams(t.as_py()) for t in batch.slice(at, 256)]
                rows = [k for k, g in enumerate(found) if len(g)]
                if not rows:
                    continue
                if not names:
                    for k in rows:
                        out[at + k] = {"lang_pred": UNKNOWN, "score": 0.0, "known": True}
                    continue
                values = model.scores([found[k] for k in rows]).astype(np.float64)
                best = values.max(axis=1)
                shares = np.exp(SHARPNESS * (values - best[:, None]))
                shares /= shares.sum(axis=1, keepdims=True)
                for k, place, share, value in zip(rows, shares.argmax(axis=1), shares.max(axis=1), best):
                    known = value >= least or len(found[k]) < EVIDENCE
                    out[at + k] = {
                        "lang_pred": names[place], "score": float(share), "known": bool(known)}
            yield pa.array(out, pa.struct(
                [("lang_pred", pa.string()), ("score", pa.float64()), ("known", pa.bool_())]))

    return predict(text)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id counts as no text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def identify(
    docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", out_col: str = "language",
) -> DataFrame:
    """``docs`` with the struct of :func:`language` in ``out_col``, learned from the rows that
    ``learn_from`` selects.  Rows are kept as they are, in any number; an existing column
    ``out_col`` is replaced; an empty table gives no rows."""
    model = learn(docs.where(learn_from), id_col, text_col, lang_col)
    return docs.withColumn(out_col, language(docs.sparkSession, model, F.col(text_col)))
