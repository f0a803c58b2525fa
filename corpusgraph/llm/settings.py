"""Production parameters of the registered queries and of the pipeline."""

#: Source, language and topic shares of the mix, and the share of all tokens it keeps. Other values keep their share of the corpus.
MIX = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {f"topic{i}": 0.25 for i in range(4)},
}
KEEP = 0.5


def _tokenizer(name: str) -> str:
    """Path of a tokenizer file (installed on every machine)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def word_bpe() -> str:
    return _tokenizer("word_bpe_49k.json")


def byte_bpe() -> str:
    return _tokenizer("byte_bpe_50k.json")


def piece_bpe() -> str:
    return _tokenizer("piece_bpe_32k.model")
