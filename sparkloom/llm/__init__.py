"""Training-data operators (ANN, HTML, language id, dedup, media, tokens, packing).

Nothing outside this subpackage imports it.
"""
