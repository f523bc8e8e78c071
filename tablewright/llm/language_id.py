"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Buckets of hashed byte trigrams; the model is one float per language and bucket.
BUCKETS = 1 << 15
SMOOTH = 0.5
EM_STEPS = 12
#: Log-likelihood that a further language must add, per log of the number of trigrams. Trigrams overlap, so more than
#: the 0.5 of independent draws.
PENALTY = 3.0
UNKNOWN = "und"
#: Most languages that are learned: the model is their number times BUCKETS doubles, 128 MB at most, on the driver and in each worker.
MOST_LANGUAGES = 500

_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text; ASCII non-letters are white space, and runs of it one space."""
    b = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_CLEAN).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return ((((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64)


class LanguageModel:
    """Trigram probabilities of each language, and the mixture inference over them."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.probs = ((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float64)

    def mixture(self, text: str | None) -> dict[str, float]:
        """Language to proportion, of the languages selected; empty if the text has no letter or no language was learned."""
        return self.infer(text)[0]

    def infer(self, text: str | None) -> tuple[dict[str, float], float]:
        """The mixture, and how much of the text it explains: its share beside a background that has every bucket alike.

        Expectation-maximisation over all languages orders them by proportion; then for the first, the first two, ... the
        proportions are fitted again, and the set with the greatest log-likelihood less PENALTY * log(n) per language is
        taken, ending with the first set that isn't better than the one before. The background is fitted last, against
        the set taken, and by the same penalty: without that gain the mixture explains all.
        """
        if not text or not self.names or not any(map(str.isalpha, text)):
            return {}, 0.0
        grams = trigrams(text)
        if not len(grams):
            return {}, 0.0
        count = np.bincount(grams, minlength=BUCKETS)
        seen = np.flatnonzero(count)
        p, w = self.probs[:, seen], count[seen].astype(np.float64)
        share = self._fit(p, w, np.full(len(self.names), 1 / len(self.names)), EM_STEPS)[0]
        order = np.argsort(-share, kind="stable")
        penalty, best, found, mixed = PENALTY * np.log(w.sum() + 1), -np.inf, {}, p[order[0]]
        for k in range(1, len(order) + 1):
            some = order[:k]
            s, likelihood = self._fit(p[some], w, share[some] / share[some].sum() if share[some].sum() > 0 else np.full(k, 1 / k), EM_STEPS if k > 1 else 0)
            if likelihood - penalty * k <= best:
                break
            best, found, mixed = likelihood - penalty * k, {self.names[i]: float(x) for i, x in zip(some, s, strict=True)}, s @ p[some]
        beside, likelihood = self._fit(np.stack([mixed, np.full(len(mixed), 1 / BUCKETS)]), w, np.array([0.5, 0.5]), EM_STEPS)
        return found, float(beside[0]) if likelihood - penalty > float(w @ np.log(mixed)) else 1.0

    @staticmethod
    def _fit(p: np.ndarray, w: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        n = w.sum()
        for _ in range(steps):
            total = share @ p
            share = share * (p @ (w / total)) / n
        return share, float(w @ np.log(share @ p))


def count_trigrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Rows (lang, bucket, n) over every text with a language; partial sums are made in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
            found.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                grams, lang = trigrams(text.as_py()), lang.as_py()
                if lang not in found:
                    if len(found) >= 256:
                        yield from flush()
                    found[lang] = np.zeros(BUCKETS, np.int64)
                found[lang] += np.bincount(grams, minlength=BUCKETS)
        yield from flush()

    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all given documents. What comes to the driver is the model: a row per language and bucket. A column of more than MOST_LANGUAGES
    values is no column of languages, and an error."""
    if docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col)).distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    rows = count_trigrams(docs, text_col, lang_col).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[[names.index(x) for x in rows["lang"]] if len(names) > 50 else rows["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["n"]
    return LanguageModel(names, counts)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """docs' columns and a struct `into` (in place of a column of that name) of lang_pred (the language of the greatest proportion, or und),
    score (its proportion; 0 for und), lang_mix (language to proportion) and known (how much of the text these languages explain, beside
    a background of no language; 0 for und).

    Row by row, so repeated rows get the same and an empty table stays empty; only the text goes to Python. Null texts, and texts
    without a letter (Unicode category L; digits, symbols and marks are none), are und; so is every text if no language was learned.
    A text of any length is read whole, in memory proportional to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("lang_mix", pa.map_(pa.string(), pa.float64())), ("known", pa.float64())])

    def infer(texts: pa.Array) -> pa.Array:
        found = [shared.value.infer(t.as_py()) for t in texts]
        top = [max(m.items(), key=lambda x: x[1]) if m else (UNKNOWN, 0.0) for m, _ in found]
        return pa.array([{"lang_pred": name, "score": min(1.0, share), "lang_mix": list(m.items()), "known": known} for (name, share), (m, known) in zip(top, found, strict=True)], kind)

    # not deterministic only in name: Spark would else run it once for a filter and again for its columns
    found = F.arrow_udf(infer, "struct<lang_pred:string,score:double,lang_mix:map<string,double>,known:double>").asNondeterministic()
    return docs.withColumn(into, found(F.col(text_col).cast("string")))


def held_out(id_col: str, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    model = learn(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")
