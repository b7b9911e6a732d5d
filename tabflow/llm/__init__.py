"""Training-data operators: archives, toxicity, near duplicates, tokens, secrets,
personal data, packing and benchmark decontamination.

Nothing else in the library imports this subpackage.
"""
