"""Training-data operators: filtering, deduplication, extraction and tokenisation at corpus scale."""
