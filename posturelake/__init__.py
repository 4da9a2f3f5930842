"""Fleet exposure analytics on Spark: evidence tables in, findings, scores, identities and summaries out."""
