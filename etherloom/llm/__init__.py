"""Training-data operators: toxicity, decontamination, quality, BPE, secrets, dedup, language and licenses.

Nothing outside this subpackage imports it.
"""
