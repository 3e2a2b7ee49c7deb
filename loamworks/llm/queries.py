"""The queries of the training-data problems; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamworks.llm import leaks, mixing, packing, personal, quality, reading, representatives, tokens
from loamworks.llm import near_duplicates as near
from loamworks.session import materialize, table


def _t(*names: str):
    def read(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
        return [table(spark, sf_dir, n) for n in names]

    return read


def p1_found(spark, sf_dir):
    return leaks.leaked_items(leaks.find_leaks(*_t("documents", "eval_items")(spark, sf_dir)))


def p1_removal_spans(spark, sf_dir):
    return leaks.removal_spans(leaks.find_leaks(*_t("documents", "eval_items")(spark, sf_dir)))


def p2_token_budget(spark, sf_dir):
    docs, records, catalog = _t("documents", "doc_records", "source_catalog")(spark, sf_dir)
    return tokens.token_budget(tokens.document_tokens(docs, records, catalog))


def p2_document_tokens(spark, sf_dir):
    docs, records, catalog = _t("documents", "doc_records", "source_catalog")(spark, sf_dir)
    return tokens.document_tokens(docs, records, catalog)


def _personal(spark, sf_dir):
    docs, lexicon = _t("documents", "name_lexicon")(spark, sf_dir)
    return docs, personal.fit_personal_model(docs, lexicon)


def p3_found(spark, sf_dir):
    return personal.find_personal_data(*_personal(spark, sf_dir)).select("doc_id", "kind", "value").distinct()


def p3_redacted(spark, sf_dir):
    return personal.redact(*_personal(spark, sf_dir))


def p4_found(spark, sf_dir):
    return representatives.dominant_records(*_t("doc_records", "source_catalog")(spark, sf_dir))


def p4_survivors(spark, sf_dir):
    return representatives.surviving_records(*_t("doc_records", "source_catalog")(spark, sf_dir))


_P5 = near.NearDuplicateConfig(shingle=3, threshold=0.7)


def p5_found(spark, sf_dir):
    return near.pairs(near.near_duplicates(table(spark, sf_dir, "documents"), _P5))


def p5_members(spark, sf_dir):
    return near.members(near.near_duplicates(table(spark, sf_dir, "documents"), _P5))


def p5_groups(spark, sf_dir):
    return near.groups(near.near_duplicates(table(spark, sf_dir, "documents")))


def _counted(spark, sf_dir):
    return materialize(tokens.with_token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"]))


def p6_text_statistics(spark, sf_dir):
    docs, ratings = _t("documents", "doc_ratings")(spark, sf_dir)
    return quality.text_statistics(docs, quality.fit_line_model(docs, ratings))


def p6_found(spark, sf_dir):
    return quality.not_prose(p6_text_statistics(spark, sf_dir))


def p7_packs(spark, sf_dir):
    return packing.pack(_counted(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p7_pack_report(spark, sf_dir):
    packs = table(spark, sf_dir, "pack_sizes")
    return packing.pack_report(packing.pack(_counted(spark, sf_dir), packs), packs)


def p8_mix(spark, sf_dir):
    return mixing.mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_plans"))


def p8_mix_report(spark, sf_dir):
    return mixing.mix_report(_counted(spark, sf_dir), table(spark, sf_dir, "mix_plans"))


def p9_reading_levels(spark, sf_dir):
    docs, ratings = _t("documents", "doc_ratings")(spark, sf_dir)
    return reading.reading_levels(docs, reading.fit_reading_model(docs, ratings), quality.fit_line_model(docs, ratings))


def p9_found(spark, sf_dir):
    return reading.prose_levels(p9_reading_levels(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_removal_spans, p2_token_budget, p2_document_tokens, p3_found, p3_redacted, p4_found, p4_survivors, p5_found, p5_members, p5_groups, p6_text_statistics, p6_found,
        p7_packs, p7_pack_report, p8_mix, p8_mix_report, p9_reading_levels, p9_found,
    )
}
