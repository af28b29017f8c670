"""Training-data operators: packing, decontamination, licences, toxicity, sharding, set
joins, line and substring deduplication, web archives, exact vector search, tokenizer alignment,
SimHash and source divergence.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is
present.
"""
