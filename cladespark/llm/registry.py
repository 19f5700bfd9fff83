"""All queries of the training-data operators, and their SQL."""

from cladespark.llm import bpe, chat, decontamination, near_dup, periodic_runs, quality_classifier, quality_rules, repeats, secrets, spelling, token_counts, toxicity, warc

MODULES = (toxicity, decontamination, warc, chat, secrets, quality_rules, bpe, near_dup, periodic_runs, quality_classifier, token_counts, spelling, repeats, periodic_runs)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
