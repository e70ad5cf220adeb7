"""Training-data operators: packing, tokenizers, PII, near-duplicates, quality, extraction, chat. Nothing outside imports this."""
