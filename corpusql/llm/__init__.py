"""Training-data operators: secret scans, HTML extraction, token files, language-model
scores, packing, quality rules, decontamination, near-duplicates, WARC and line dedup.

Nothing outside this folder imports it.  Each module holds one operator with a general
interface; ``queries`` derives the result tables of the query catalogue from them.
"""
