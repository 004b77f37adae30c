"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from salesflow.llm import decontaminate as decon, near_dup
from salesflow.llm.bit_scatter import whiten
from salesflow.llm.dialogue_repair import repair
from salesflow.llm.html_wrapper import extract
from salesflow.llm.kneser_ney import quality_scores
from salesflow.llm.mixture import mix
from salesflow.llm.phrase_automata import remove_phrases
from salesflow.llm.pii import pii_report
from salesflow.llm.quality_rules import quality_rules
from salesflow.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from salesflow.llm.secret_scan import secret_report
from salesflow.llm.suffix_levels import remove_repeats
from salesflow.llm.token_counts import token_counts


@query("op1_quality_rules")
def op1(spark, folder):
    return quality_rules(table(spark, folder, "documents")).drop("removed", "text_hash")


@query("op2_secret_scan")
def op2(spark, folder):
    return secret_report(table(spark, folder, "documents"))


@query("op3_html_wrapper")
def op3(spark, folder):
    return extract(table(spark, folder, "pages"))


@query("op6_remove_repeats")
def op6(spark, folder):
    return remove_repeats(table(spark, folder, "documents")).drop("spans")


@query("op7_pii")
def op7(spark, folder):
    return pii_report(table(spark, folder, "documents"))


@query("op4_kneser_ney_quality")
def op4(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_near_duplicates", near_dup.SQL)
def op5(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op8_decontaminate", decon.SQL)
def op8(spark, folder):
    found = decon.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("hits", "text_hash")


@query("op9_mix_sources")
def op9(spark, folder):
    return mix(table(spark, folder, "documents"))


@query("op10_token_counts")
def op10(spark, folder):
    import public_tokenizers

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_dialogue_repair")
def op11(spark, folder):
    return repair(table(spark, folder, "conversations"))


@query("op12_whiten")
def op12(spark, folder):
    return whiten(table(spark, folder, "embeddings"))


@query("op13_repeated_phrases")
def op13(spark, folder):
    return remove_phrases(table(spark, folder, "documents")).drop("spans")
