"""Ids of a public byte-level BPE vocabulary, as the tokenizers library gives them with its special token unsplit."""

import base64
import functools

import numpy as np

#: The name of the vocabulary in public_tokenizers; a parameter of the operators that use it.
VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Characters of a text encoded at once; longer ones are cut where a word surely ends.
BLOCK = 1 << 18


@functools.cache
def fast(vocabulary: str = VOCABULARY):
    """tiktoken's encoding of the vocabulary: the same ids as its JSON file gives with the tokenizers library."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    for line in open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


@functools.cache
def library(vocabulary: str = VOCABULARY):
    """The tokenizers library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    t.no_truncation()
    t.no_padding()
    return t


def blocks(text: str, size: int = BLOCK):
    """``text`` in parts of about ``size`` characters that can be encoded alone: each cut is between an ASCII
    letter and a space with an ASCII letter after it, where a word always ends and the next begins. Where
    there is no such place, a part is longer."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut + 1 < len(text) and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1].isascii() and text[cut + 1].isalpha()):
            cut += 1
        if cut + 1 >= len(text):
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Unsigned 32-bit ids of a whole text. What the fast encoder can't do (it gives up on very long runs) the library does."""
    encoding, parts = fast(vocabulary), []
    for part in blocks(text):
        if len(part) > 4 * BLOCK:
            parts.append(np.array(library(vocabulary).encode(part, add_special_tokens=False).ids, np.uint32))
        else:
            parts.append(encoding.encode_to_numpy(part, allowed_special={SPECIAL}, disallowed_special=()))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
