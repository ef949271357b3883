"""Column builders: text, scores, filters, tokens, HTML."""
