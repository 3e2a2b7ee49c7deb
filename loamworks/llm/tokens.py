"""Exact token counts under a public tokenizer, and their totals by source, language and domain.

A null text has no count (null), an empty one zero; whole texts are encoded. Stored counts, languages
and sources are not trusted: tokens are counted anew, the language is read from the text, and a source that
is null, blank or in other case is cleaned or taken from the document's latest record. Repeated rows of
``documents`` count each; columns not named are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.batches import pieces
from loamworks.llm.language import LanguageModel, clean_language, fit_language_model

#: Where the vocabulary lies on the driver, unless the session's ``loamworks.tokenizer`` names another file; workers are sent a copy.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary was split.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int | None]:
    """Tokens of each whole text; all texts are handed to the encoder at once."""
    counts = iter([len(x) for x in encoding(path).encode_ordinary_batch([t for t in texts if t is not None], num_threads=1)])
    return [None if t is None else next(counts) for t in texts]


def with_token_counts(documents: DataFrame, keep: list[str], tokenizer: str | None = None, languages: LanguageModel | None = None) -> DataFrame:
    """The columns ``keep`` with ``token_count`` and, given profiles, ``text_lang`` (null where the text tells nothing)."""
    spark = documents.sparkSession
    path = tokenizer or spark.conf.get("loamworks.tokenizer", TOKENIZER)
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    wanted = documents.select(*keep, F.col("text").alias("_text"))
    told = languages is not None
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]] + ["token_count bigint"] + ["text_lang string"] * told
    names = [*keep, "token_count"] + ["text_lang"] * told

    def run(batches):
        from pyspark import SparkFiles

        local = SparkFiles.get(name)
        for batch in batches:
            for part in pieces(batch, len(keep), 4096):
                texts = part.column(len(keep)).to_pylist()
                columns = [part.column(k) for k in range(len(keep))] + [pa.array(count_tokens(texts, local), pa.int64())]
                if told:
                    columns.append(pa.array(languages.guess(texts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return wanted.mapInArrow(run, ", ".join(fields))


def clean_name(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def document_tokens(documents: DataFrame, records: DataFrame, catalog: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, token_count, source, language and domain of every document; unknown ones are ``unknown``.

    The language is that of the text's trigrams, where these leave no doubt, else the stored one.
    """
    counted = with_token_counts(documents, ["doc_id", "lang", "source"], tokenizer, fit_language_model(documents))
    known = records.where("doc_id IS NOT NULL").select("doc_id", clean_name(F.col("source")).alias("s"), "fetched_at", "record_id").where("s IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max_by("s", F.struct("fetched_at", "record_id", "s")).alias("record_source"))
    out = counted.join(known, "doc_id", "left").select(
        "doc_id",
        "token_count",
        F.coalesce(clean_name(F.col("source")), "record_source", F.lit("unknown")).alias("source"),
        F.coalesce("text_lang", clean_language(F.col("lang")), F.lit("unknown")).alias("language"),
    )
    domains = catalog.select(clean_name(F.col("source")).alias("source"), clean_name(F.col("domain")).alias("d")).where("source IS NOT NULL")
    domains = domains.groupBy("source").agg(F.max("d").alias("d"))
    out = out.join(domains, "source", "left")
    return out.select("doc_id", "token_count", "source", "language", F.coalesce("d", F.lit("unknown")).alias("domain"))


def token_budget(counted: DataFrame) -> DataFrame:
    """Documents and tokens of every combination of source, language and domain; ``all`` stands for any value."""
    cube = counted.cube("source", "language", "domain").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("n_tokens"), F.count("token_count").alias("n_texts")
    )
    return cube.select(*[F.coalesce(c, F.lit("all")).alias(c) for c in ("source", "language", "domain")], "n_docs", "n_texts", "n_tokens")
