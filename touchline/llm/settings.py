"""Settings of this installation."""

from __future__ import annotations

import public_tokenizers

#: The tokenizer files; only the driver reads them.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
