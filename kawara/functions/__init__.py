"""Column functions: text normalisation, extraction, classification, HTML."""
