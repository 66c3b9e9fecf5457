"""Where the public vocabulary files lie; they are never copied here."""

from __future__ import annotations

import os

DEFAULT = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT) -> str:
    """Path of a vocabulary file, the same on every machine: the installed package of files, or TOKENIZER_DIR."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
