"""Training-data operators over a document corpus: quality rules, line and
document deduplication, source mixing, tokenisation, toxicity scores, page
text extraction, vector search, sharding and token files.

Nothing outside this subpackage imports it."""
