"""The numbered queries, with their check SQL where SQL can follow."""

from __future__ import annotations

from riskloom.llm import (
    conversations,
    decontaminate,
    embedding_join,
    fill_middle,
    jaccard_join,
    langid,
    lm,
    packing,
    quality,
    sharding,
    substring,
    suffix_array,
    warc,
)

ALL = {
    **packing.QUERIES, **substring.QUERIES, **embedding_join.QUERIES, **langid.QUERIES, **quality.QUERIES,
    **jaccard_join.QUERIES, **lm.QUERIES, **sharding.QUERIES, **suffix_array.QUERIES, **decontaminate.QUERIES,
    **fill_middle.QUERIES, **warc.QUERIES,
    **conversations.QUERIES,
}
