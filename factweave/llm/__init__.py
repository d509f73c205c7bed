"""Operators for training data from text: linkage, spellings, survivors, packing, mixing, subjects."""
