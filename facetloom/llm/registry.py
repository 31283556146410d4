"""All queries of the subpackage and the SQL that gives the same rows, where SQL can express it."""

from importlib import import_module

MODULES = ["license_scan", "sharding", "ngram_join", "mixing", "toxicity", "quality_rules", "packing", "pii", "mtree", "token_counts"]
QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _module = import_module(f"facetloom.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
