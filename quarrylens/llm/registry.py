"""The queries of this subpackage: name -> builder, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import collocations, embedding_dedup, language_id, lexical_search, url_filters
from quarrylens.llm.collocations import op11_collocations
from quarrylens.llm.decontamination import op8_decontamination
from quarrylens.llm.embedding_dedup import op7_embedding_dedup
from quarrylens.llm.html_extraction import op9_html_extraction
from quarrylens.llm.language_id import op10_language_id
from quarrylens.llm.lexical_search import op12_lexical_search
from quarrylens.llm.quality import op2_quality
from quarrylens.llm.sentencepiece_wfst import op3_sentencepiece
from quarrylens.llm.simhash import op4_simhash
from quarrylens.llm.token_counts import op5_token_counts
from quarrylens.llm.token_ids import op6_token_ids
from quarrylens.llm.url_filters import op1_url_filters
from quarrylens.llm.word_bpe import op13_word_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_quality": op2_quality,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_simhash": op4_simhash,
        "op5_token_counts": op5_token_counts,
        "op6_token_ids": op6_token_ids,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_html_extraction": op9_html_extraction,
        "op10_language_id": op10_language_id,
        "op11_collocations": op11_collocations,
        "op12_lexical_search": op12_lexical_search,
        "op13_word_bpe": op13_word_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filters.ORACLE_SQL, "op7_embedding_dedup": embedding_dedup.ORACLE_SQL, "op10_language_id": language_id.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_lexical_search": lexical_search.ORACLE_SQL}
