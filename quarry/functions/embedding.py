"""Text vectors: a feature-hash encoder that stands in for a sentence model, with the same shape and norm (x14)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimensions of a vector and characters of a text that are encoded.
DIMENSIONS = 384
MAX_CHARS = 1024


@F.pandas_udf("array<float>")
def _hashed(texts: pd.Series) -> pd.Series:
    import re
    from zlib import crc32

    out = []
    for text in texts:
        vector = np.zeros(DIMENSIONS, np.float32)
        hashes = [crc32(word.encode()) for word in re.findall(r"\w+", (text or "").lower())]
        for h in hashes:
            vector[h % DIMENSIONS] += 1 if h >> 16 & 1 else -1
        if not vector.any():
            for h in hashes:
                vector[h % DIMENSIONS] += 1
        norm = float(np.linalg.norm(vector))
        out.append(vector / norm if norm else vector)
    return pd.Series(out)


def embed(text: Column) -> Column:
    """A unit vector of the text's words, each hashed to a place and a sign; without signs where these cancel all words out; all 0 where there is no word."""
    return _hashed(F.substring(text, 1, MAX_CHARS))
