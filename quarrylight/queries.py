"""All queries of the engine itself, with their oracles."""

from __future__ import annotations

from quarrylight.plans import answers, catalog, documents, evaluate, focus, pages, records, relational, retrieval, structure, vectors, wording

FLAGSHIP = "retrieve_minimal"
QUERIES, ORACLES = {}, {}
for _module in (answers, vectors, relational, retrieval, documents, catalog, structure, focus, pages, evaluate, records, wording):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
