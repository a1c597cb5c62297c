"""Languages of documents, and of the stretches of documents that change language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlatrace.llm.lang_model import SENTENCES_PER_DOCUMENT, SENTENCES_PER_LANGUAGE, Model, Vocabulary, fit_on_documents, stretches

# Three-letter codes of the languages of the table, in order of their two-letter codes.
THREE_LETTERS = {
    "ar": "ara", "bg": "bul", "ca": "cat", "cs": "ces cze", "cy": "cym wel", "da": "dan", "de": "deu ger", "el": "ell gre", "en": "eng", "es": "spa", "et": "est", "fi": "fin", "fr": "fra fre", "gl": "glg", "he": "heb", "hi": "hin",
    "hr": "hrv", "hu": "hun", "id": "ind", "it": "ita", "ja": "jpn", "ko": "kor", "lv": "lav", "nl": "nld dut", "no": "nor nob", "pl": "pol", "pt": "por", "ro": "ron rum", "ru": "rus", "sk": "slk slo", "sl": "slv", "sv": "swe", "th": "tha",
    "tr": "tur", "uk": "ukr", "vi": "vie", "zh": "zho chi",
}
SAMPLE_DOCUMENTS = 300
SAMPLE_CHARS = 20_000
CHUNK_CHARS = 200_000


def language_names(languages: DataFrame, most: int = 1000) -> dict[str, str]:
    """Every lower-case spelling to its two-letter code. The table holds settings; more than `most` rows end the query."""
    rows = languages.where("name is not null and length(code) = 2").limit(most + 1).collect()
    assert len(rows) <= most, "too many languages"
    known = {r["code"].lower(): r["code"].lower() for r in rows}
    names = {r["name"].lower(): r["code"].lower() for r in rows}
    threes = {t: code for code, ts in THREE_LETTERS.items() if code in known for t in ts.split()}
    return names | threes | known


def label_code(label: Column, names: dict[str, str]) -> Column:
    """The code a label names: a code, a name or a three-letter code, in any case, with or without a region; null for anything else."""
    flat = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, flat), F.try_element_at(table, F.regexp_replace(flat, "[-_].*$", "")))


def fit_model(documents: DataFrame, samples: DataFrame, names: dict[str, str], key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = SAMPLE_DOCUMENTS, max_chars: int = SAMPLE_CHARS, max_samples: int = 100_000, sentences_per_document: int = SENTENCES_PER_DOCUMENT, sentences_per_language: int = SENTENCES_PER_LANGUAGE) -> Model:
    """A model fitted on the sample sentences (code, text) and on a bounded sample of labelled documents.

    The sample: of each language named by labels, the `per_language` documents of up to `max_chars` characters that come first
    by a hash of their key; of each document at most `sentences_per_document` sentences, spread over it, and of each language at most
    `sentences_per_language`. Labels may be wrong; the fit allows for that. More than `max_samples` sample sentences end the query.
    """
    rows = documents.select(F.col(key).alias("_k"), F.col(text).alias("_t"), label_code(F.col(label), names).alias("_l")).where((F.col("_l").isNotNull()) & (F.length("_t").between(20, max_chars)))
    first = Window.partitionBy("_l").orderBy(F.xxhash64("_k"), "_k")
    picked = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).orderBy("_l", "_n").select("_l", "_t").collect()
    sentences = samples.where("code is not null and text is not null").orderBy("code", "sample_id").limit(max_samples + 1).collect()
    assert len(sentences) <= max_samples, "too many sample sentences"
    return fit_on_documents([(r["code"].lower(), r["text"]) for r in sentences], [(r["_l"], r["_t"]) for r in picked], sentences_per_document, sentences_per_language)


def language_stretches(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, carried columns.., n_stretches, start_pos, lang, confidence): the stretches of each document, each in one language.

    The first starts at 0, the others at the first sentence of the new language. Confidence is between 0 and 1. A text too far
    from every centroid has the language null. Documents without a word (null, empty, figures only) have no rows. Documents are
    independent of each other: repeated ones give the same rows again. Extra columns are carried under the names given.
    """
    carried = carry or {}
    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"), *[c.alias(n) for n, c in carried.items()])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for frame in frames:
            size = frame["_t"].str.len().cumsum() // CHUNK_CHARS
            for _, part in frame.groupby(size, sort=False):
                found = stretches(part["_t"].tolist(), model, vocabulary)
                at = [i for i, f in enumerate(found) for _ in f]
                flat = [x for f in found for x in f]
                out = part.drop(columns="_t").iloc[at].reset_index(drop=True)
                out["n_stretches"] = [len(f) for f in found for _ in f]
                out["start_pos"] = [x[0] for x in flat]
                out["lang"] = pd.Series([x[1] for x in flat], dtype="object")
                out["confidence"] = [x[2] for x in flat]
                yield out

    schema = ", ".join([f"_k {kinds['_k']}", *[f"`{n}` {kinds[n]}" for n in carried], "n_stretches int, start_pos int, lang string, confidence double"])
    return rows.mapInPandas(run, schema).withColumnRenamed("_k", key)
