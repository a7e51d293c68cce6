"""First occurrences of words in documents, as hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd

from corpusloom.llm import text


def in_document(w: text.Words) -> np.ndarray:
    """Places of the first occurrence of each word in its document."""
    pair = text.mix(w.hash + np.uint64(0x9E3779B97F4A7C15) * w.doc.astype(np.uint64))
    return np.flatnonzero(~pd.Series(pair).duplicated().to_numpy())
