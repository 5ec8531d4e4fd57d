"""Training-data operators: licences, toxicity, BPE, deduplication, mixing, chat, media, top-k, URL filters, token counts, tokenizer alignment and whitening."""
