"""Training-data operators: HTML, WARC, media, tokens, quality, PII, URLs, language, copies, leaks."""
