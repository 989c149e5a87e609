"""Readers of public tokenizer vocabularies; nothing is trained or copied here, the files' folder is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken

#: Where the vocabulary files lie on the driver and on each executor.
FOLDER = "/opt/tokenizers"
#: Byte-level BPE for many languages.
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
#: BPE over characters with byte fallback.
PIECE_BPE = "piece_bpe_32k.model"
# Fixed value: the public pattern that cuts a text into pieces before the byte merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def byte_bpe(folder: str = FOLDER, name: str = BYTE_BPE) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and for each id whether its bytes are no UTF-8 text by themselves (a byte fallback)."""
    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fallback = np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            fallback[rank] = True
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), fallback


@lru_cache(maxsize=4)
def piece_bpe(folder: str = FOLDER, name: str = PIECE_BPE) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """The encoder of a piece model, and for each id whether it is a byte piece (a byte fallback)."""
    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])
