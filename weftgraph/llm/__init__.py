"""Training-data operators: secret scans, toxicity, quality, deduplication, decontamination and BPE.

Nothing outside this folder imports it.  A document is a row: rows that repeat are documents of
their own, and a null ``doc_id`` or ``text`` is a value like any other (the text counts as empty).
Operators read the columns they name and ignore all others, whatever those are called.
"""
