"""Production parameters of the registered queries and the pipeline."""

import public_tokenizers

#: Key of the surrogates; a deployment passes its own secret.
PII_KEY = "test-data-key"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_TOKENS = 2048
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
COSINE = 0.95
#: The pipeline drops texts whose language is unknown or less certain than this.
LANGUAGE_SCORE = 0.4
