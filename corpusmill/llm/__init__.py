"""Training-data operators: token counts, secret scans, language id, decontamination,
substring and near-duplicate removal, personal data, URL filters, quality rules, BPE.

Nothing else in the library imports this subpackage.
"""
