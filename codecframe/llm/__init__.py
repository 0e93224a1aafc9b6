"""Training-data operators: decontamination, scoring, fingerprints, language ID,
quality sampling, WARC, line dedup, chat parsing, near duplicates and mixing.

Nothing outside this subpackage imports it.
"""
