"""Training-data operators: packing, URL filters, token output, toxicity, licences, quality, dedup, extraction, decontamination."""
