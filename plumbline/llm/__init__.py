"""Training-data operators: media chunks, chat repair, quality, dedup, decontamination, PII, tokens and LM scores."""
