"""Imports every operator of the subpackage, which registers its query."""

from poolsight.llm import (  # noqa: F401
    alignment,
    chat,
    decontamination,
    jaccard,
    language,
    lexical,
    mixing,
    neighbours,
    quality,
    sharding,
    token_scan,
    url_filter,
    warc,
)
from poolsight.llm.catalog import ORACLES, QUERIES  # noqa: F401
