"""Training-data operators: formatting, dedup, filtering, tokenising.

Nothing outside this folder imports it; ``__spark_entry__`` adds its
queries when the folder is there."""
