"""Training-data operators: personal data, conversations, toxicity, duplicates, packing, pages, licences."""
