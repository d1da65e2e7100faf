"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary (lines of a token in base64 and its rank) of the byte-level BPE that sizes are measured in. The file, and beside
#: it an __init__.py that names the PATTERN that splits texts, must exist on every executor.
TOKENIZER = os.environ.get("INKFIELD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Blanks in a row from which the pattern engine of the first library may run out of stack.
LONG_RUN = 5_000
_RUN = re.compile(r"\s{%d}" % LONG_RUN)
_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file, loaded once per process. Special tokens' strings are ordinary text."""
    if path not in _loaded:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(path).parent / "__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _loaded[path] = tiktoken.Encoding(Path(path).stem, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _plain_encoder(path: str):
    """The same vocabulary in another library, which takes runs of blanks of any length."""
    path = str(Path(path).with_suffix(".json"))
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


def counts(texts: list[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text; 0 for null and empty ones. Texts with runs of blanks too long for the first library's pattern
    engine go through the other one, whose counts are the same."""
    encode = encoder(path).encode_ordinary
    return [0 if not t else len(_plain_encoder(path).encode(t, add_special_tokens=False)) if len(t) > LONG_RUN and _RUN.search(t) else len(encode(t)) for t in texts]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    def batches(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series(counts(texts.tolist(), path), dtype="int64")

    return F.pandas_udf(batches, "bigint")(text)
