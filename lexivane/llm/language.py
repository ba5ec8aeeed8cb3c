"""Language identification: known words first, then shorter and shorter character n-grams.

A word seen in training counts with its log frequency in every language. An unseen word is cut into its
character n-grams, with marks at both ends; the longest length of which any n-gram is known scores it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivane.llm.common import sliced, small_batches, third

NO_LANGUAGE = "und"
DOCS_PER_LANGUAGE = 4_000  # labelled documents the model is fitted on, about
LANGUAGES = 256  # the most frequent languages are learnt
WORDS = 30_000  # known words of a language
GRAMS = 10_000  # known n-grams of a language and length
MODEL_CELLS = 16 << 20  # numbers in the model; with many languages each keeps fewer words
LONGEST_GRAM = 4
_LETTERS = re.compile(r"[^\W\d_]+")
_CACHE = 100_000
_CHUNK = 1 << 20


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], dict, np.ndarray]:
    """Fit on rows (doc_id, text, lang): languages, word or n-gram -> row, log frequencies by row and language.

    The sample is bounded: of each of the LANGUAGES most frequent languages about docs_per_language whole
    texts, chosen by a hash of id and text. Words and n-grams are counted by Spark; only the most frequent come
    to the driver. Rows without text or language teach nothing; with none left, every document is `und`.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = sorted(r["lang"] for r in found)
    if not langs:
        return [], {}, np.zeros((0, 0), np.float32)
    share = F.create_map(
        *[F.lit(x) for r in found for x in (r["lang"], min(1.0, docs_per_language / r["count"]) * 2**30)]
    )
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")])
    words = (
        drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("item"))
        .groupBy("lang", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marked = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
    cut = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(LONGEST_GRAM)),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(marked) - size + 1, F.lit(1))),
                lambda i: F.struct(size.alias("size"), F.substring(marked, i, size).alias("item")),
            ),
        )
    )
    pieces = words.select("lang", "n", F.explode(cut).alias("p")).filter(F.length("p.item") == F.col("p.size"))
    counted = pieces.groupBy("lang", "p.size", "p.item").agg(F.sum("n").alias("n"))
    kept = max(64, min(WORDS, MODEL_CELLS // len(langs) ** 2))
    tables = words.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(counted)
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    whole = F.sum("n").over(Window.partitionBy("lang", "size"))
    limit = F.when(F.col("size") == 0, kept).otherwise(min(kept, GRAMS))
    top = tables.withColumns({"at": F.row_number().over(best), "whole": whole}).filter(F.col("at") <= limit)
    index = {lang: i for i, lang in enumerate(langs)}
    at: dict[tuple[int, str], int] = {}
    cells = []
    totals = np.ones((LONGEST_GRAM + 1, len(langs)))
    for r in top.select("lang", "size", "item", "n", "whole").toLocalIterator():
        row = at.setdefault((r["size"], r["item"]), len(at))
        cells.append((row, index[r["lang"]], r["n"]))
        totals[r["size"], index[r["lang"]]] = r["whole"]
    counts = np.full((len(at), len(langs)), 0.5, np.float32)
    if cells:
        row, lang, n = np.array(cells, np.int64).T
        counts[row, lang] += n
    sizes = np.array([size for size, _ in at], np.int64)
    return langs, at, np.log(counts / (totals[sizes] + 0.5 * len(at))).astype(np.float32)


class _Scores(dict):
    """word -> row of the matrix; an unseen word gets a row of its own when it is first met."""

    def __init__(self, at: dict, logs: np.ndarray):
        self.known = {item: row for (size, item), row in at.items() if size == 0}
        self.grams = {key: row for key, row in at.items() if key[0]}
        self.logs, self.base = logs, len(logs)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.known)
        self.used = self.base
        self.rows = np.concatenate([self.logs, np.zeros((_CACHE, self.logs.shape[1]), np.float32)])

    def __missing__(self, word: str) -> int:
        marked = f"^{word}$"
        score = 0.0
        for size in range(LONGEST_GRAM, 0, -1):
            found = [
                row
                for i in range(len(marked) - size + 1)
                if (row := self.grams.get((size, marked[i : i + size]))) is not None
            ]
            if found:
                score = self.logs[found].mean(axis=0)
                break
        self.rows[self.used] = score
        self[word] = self.used
        self.used += 1
        return self.used - 1


def _chunks(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > _CHUNK:
        stop = _LETTERS.match(text, start + _CHUNK)
        end = stop.end() if stop else start + _CHUNK
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _judge(text: str | None, langs: list[str], scores: _Scores) -> tuple[str, float]:
    total, letters = np.zeros(len(langs)), False
    for chunk in _chunks((text or "").lower()):
        words = _LETTERS.findall(chunk)
        letters = letters or any(w.isalpha() or any(map(str.isalpha, w)) for w in words)
        for i in range(0, len(words), _CACHE // 4):
            if scores.used > scores.base + _CACHE // 2:  # what is left has room for all words of a part
                scores.reset()
            part = list(map(scores.__getitem__, words[i : i + _CACHE // 4]))
            total += scores.rows[part].sum(axis=0)
    if not letters or not langs:
        return NO_LANGUAGE, 0.0
    odds = np.exp(total - total.max())
    best = int(odds.argmax())
    return langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: tuple, keep: list[str], lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns in keep of every row, with the predicted language of its whole text and its posterior.

    Null or letterless text gives `und` with score 0; ties go to the first language by name. Equal texts get equal
    answers. Rows stay where they are: no shuffle.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.select(*keep).schema.fields]
    names = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, names)], F.col("text").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, at, logs = sent.value
        scores = _Scores(at, logs)
        for batch in sliced(batches):
            answers = [_judge(t, langs, scores) for t in batch.column("_text").to_pylist()]
            columns = [batch.column(n) for n in names]
            columns += [pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_lang", "_score"])

    schema = ", ".join(
        [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)] + ["_lang string", "_score double"]
    )
    out = source.mapInArrow(work, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], F.col("_lang").alias(lang), F.col("_score").alias(score))


def learnt(docs: DataFrame) -> tuple:
    """The model learnt from the rows that are not held out."""
    return train(docs.filter(third() != 1))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; a missing lang is filled in with the predicted one."""
    names = docs.columns
    judged = identify(docs, learnt(docs), names, "_lang_found", "_lang_score")
    kept = judged.filter(F.col("_lang_found") != NO_LANGUAGE)
    return kept.withColumn("lang", F.coalesce("lang", "_lang_found")).select(*names)
