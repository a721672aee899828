"""Training-data operators: quality, packing, byte-level BPE, deduplication, WARC, chat, ANN, secrets, sharding."""
