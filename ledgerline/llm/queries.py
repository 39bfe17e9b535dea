"""All queries of this subpackage."""

from ledgerline.llm import (  # noqa: F401
    classifier_queries,
    document_queries,
    join_queries,
    native_queries,
    text_queries,
    vector_queries,
)
from ledgerline.llm.registry import ORACLES, QUERIES  # noqa: F401
